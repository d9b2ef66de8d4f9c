"""Secret scan over a trigram index.

Each rule's regex yields a Boolean query over trigrams that any match must hold.
The index has a column of bits for each trigram, one bit a row: its postings, which
lie with the rows that they stand for. A query intersects the columns of a clause
and unites the clauses; rows that meet it are candidates and are verified with the
regex. A rule without a mandatory trigram (a run of hex digits) scans every text.

The bits of a clause are only looked up where its lead trigram is posted: fewest
leads that reach all clauses are tested first, the others seldom.

Defined results: a null text counts as empty; an empty text has no spans; rows
with the same or a null doc_id are each judged on their own text; an empty
table gives an empty result; columns other than doc_id and text are ignored.

Scale: one pass over the texts, no shuffle and no join, whatever key is hot; the
work is linear in a text and its matches.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import regex_spans, span_digest, whole_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read alike in Java and Python; matches whose ``group`` is
    shorter than ``least`` characters are dropped, without another try."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds and formats that a scan must find.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # No run below 16 digits holds a longer one, so the bound may sit in the regex.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Formats of public services' tokens that the base kinds miss.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + EXTRA_RULES

#: A query in disjunctive form; ``ANY`` is met by every text.
Query = frozenset
ANY: Query = frozenset({frozenset()})
MOST_STRINGS = 32


def _absorb(clauses) -> Query:
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _all_of(a: Query, b: Query) -> Query:
    both = _absorb(x | y for x, y in product(a, b))
    return both if len(both) <= MOST_STRINGS else min(a, b, key=len)


def _of_strings(strings) -> Query:
    return _absorb(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The finite set of strings that ``nodes`` match, if small, and a query that
    every match meets."""
    strings, query, finite = {""}, ANY, True
    for op, arg in nodes:
        name, exact, need = str(op), None, ANY
        if name == "LITERAL":
            exact = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            exact = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            exact, need = _walk(arg[-1])
        elif name == "BRANCH":
            ways = [_walk(x) for x in arg[1]]
            need = _absorb(c for _, q in ways for c in q)
            if all(e is not None for e, _ in ways):
                exact = set().union(*(e for e, _ in ways))
        elif name == "MAX_REPEAT":
            least, most, inner = arg
            found, inner_need = _walk(inner)
            need = inner_need if least else ANY
            if (least, most) == (0, 1) and found is not None:
                exact = found | {""}
        elif name == "AT":
            exact = {""}
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, exact)}
        else:
            # What is not a small set of strings ends the literal run.
            query = _all_of(_all_of(query, _of_strings(strings)), need if exact is None else _of_strings(exact))
            strings, finite = {""}, False
    query = _all_of(query, _of_strings(strings))
    return (strings if finite else None), query


def trigram_query(pattern: str) -> Query:
    """Lower-cased trigrams that any match of ``pattern`` holds: a set of clauses,
    of which one must be met in full. The empty clause stands for no demand."""
    return _walk(re._parser.parse(pattern))[1]


def leads(queries: list[Query]) -> list[str]:
    """Trigrams of which each clause holds one: greedily the one that most clauses hold."""
    clauses, chosen = {c for q in queries for c in q}, []
    while clauses:
        counts = Counter(t for c in clauses for t in c)
        best = min(counts, key=lambda t: (-counts[t], t))
        chosen.append(best)
        clauses = {c for c in clauses if best not in c}
    return chosen


def index(rows: DataFrame, queries: list[Query], text: str = "text") -> DataFrame:
    """``rows`` with ``postings``: an array of trigrams, those of the queries that the
    text holds, as far as their clause's lead is posted, too."""
    low, first = F.col("_low"), leads(queries)
    held = lambda names: F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in names]).cast("array<string>"))
    behind = {t: sorted({x for q in queries for c in q if t in c for x in c} - set(first)) for t in first}
    more = [F.when(F.array_contains("_leads", t), held(names)).otherwise(F.array().cast("array<string>")) for t, names in behind.items() if names]
    rows = rows.withColumn("_low", F.lower(text)).withColumn("_leads", held(first))
    some = F.when(F.size("_leads") > 0, F.array_distinct(F.concat("_leads", *more))).otherwise(F.col("_leads"))
    return rows.withColumn("postings", some).drop("_low", "_leads")


def met(query: Query, postings: str = "postings") -> Column:
    """Whether a row's postings meet the query: intersected by clause, clauses united."""
    clauses = [reduce(Column.__and__, [F.array_contains(postings, t) for t in sorted(c)]) for c in sorted(query, key=sorted)]
    return (F.size(postings) > 0) & reduce(Column.__or__, clauses)


def _kept(spans: Column, rank: int, rule: Rule) -> Column:
    return F.transform(
        F.filter(spans, lambda s: F.length(s["value"]) >= rule.least),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"), s["match"].alias("match"),
        ),
    )


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, text, spans): every row of ``docs`` with its secrets.

    ``spans``: array of struct(start, end, rank, kind, match), unordered; ``rank``
    is the kind's place in ``rules``.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    rows = index(docs.select("doc_id", whole_text().alias("text")), list(queries.values()))

    none = F.array().cast("array<string>")
    for i, r in enumerate(rules):
        # Verification: the regex runs on candidates, or on all where no trigram is mandatory.
        asked = met(queries[r.kind]) if r.kind in queries else F.lit(True)
        take = lambda g, p=r.pattern: F.regexp_extract_all("text", F.lit(p), F.lit(g))
        rows = rows.withColumn(f"m{i}", F.when(asked, take(0)).otherwise(none))
        if r.group:
            rows = rows.withColumn(f"v{i}", F.when(asked, take(r.group)).otherwise(none))
    parts = [
        _kept(regex_spans(F.col("text"), r.pattern, F.col(f"m{i}"), F.col(f"v{i}" if r.group else f"m{i}")), i, r)
        for i, r in enumerate(rules)
    ]
    return rows.select("doc_id", "text", F.concat(*parts).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Digest of ``scan``: counts and the hashed list of base spans, and all spans."""
    base = len(BASE_RULES)
    of = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)],
        F.sha2(span_digest(F.filter("spans", lambda s: s["rank"] < base), by_kind=False), 256).alias("base_sha256"),
        span_digest(F.col("spans"), by_kind=False).alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    # RE2 has no bound-free difference here: the base forms are used as dealt.
    forms = [(r.kind, "[0-9a-f]+" if r.kind == "hex" else r.pattern, r.group, r.least) for r in RULES]
    found = "\nUNION ALL ".join(
        f"SELECT n, '{k}' AS kind, {i} AS rank, {least} AS least, regexp_extract_all(t, {quoted(p)}, 0) AS w, "
        f"regexp_extract_all(t, {quoted(p)}, {g}) AS v, string_split_regex(t, {quoted(p)}) AS gaps FROM d"
        for i, (k, p, g, least) in enumerate(forms)
    )
    base = len(BASE_RULES)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
x AS (SELECT n, kind, rank, least, unnest(range(1, len(w) + 1)) AS i, w, v, gaps FROM m WHERE len(w) > 0),
p AS (SELECT n, kind, rank,
        list_sum(list_transform(gaps[1:i], lambda a: length(a)))
          + coalesce(list_sum(list_transform(w[1:i - 1], lambda a: length(a))), 0) AS s, length(w[i]) AS k
      FROM x WHERE length(v[i]) >= least),
q AS (SELECT n, kind, rank, s::BIGINT AS s, (s + k)::BIGINT AS e FROM p),
a AS (SELECT n, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
        {joined} FILTER (WHERE rank < {base}) AS base, {joined} AS spans FROM q GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (n)"""


ORACLE_SQL = _oracle()
