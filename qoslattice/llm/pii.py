"""Personal data by candidate generation and boosted trees.

Generators propose spans with high recall, overlapping ones included. Spans of the
base forms that fit their rule are settled. All other candidates are judged by
boosted trees over format and context features. The trees are fitted to texts made
up by a seed, in which it is known what is personal and what only looks like it
(``examples``): order numbers, sums, versions and the like take the same shapes, so that
cues and other words around a candidate have to decide. Contexts that no tree has seen are
held out, and give each generator the threshold at which its accepted candidates are
personal at PRECISION. So a text's spans depend
on the text alone, not on the corpus or the shard that it lies in. Candidates that
pass, and overlap no settled span, are added: a phone number without its country
code, an address with a bracketed "at", a defanged ip, a card in dots.

Defined results: a null text counts as empty and has no spans; rows of equal or
null doc_id are judged on their own text, equal rows each get a row; an empty
table gives an empty result; other columns are ignored, or kept by ``redact``.

Scale: texts are read once and never shuffled; the work is linear in a text and its
candidates. What is fitted has a fixed size.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import bound, gaps_of, replaced, running, span_digest, spans_between, whole_text, with_text

#: The kinds in their order, and what a base match must be.
KINDS = ("email", "ip", "card", "phone")
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)
MOST_IN_PART = 255


@dataclass(frozen=True)
class Generator:
    """``hints``: texts with matches hold one of these, none if empty: a cheap test."""

    kind: str
    base: bool
    pattern: str
    hints: tuple[str, ...] = ()


# The base forms as dealt, written so that no run is scanned twice: quantifiers
# are possessive where nothing after them could take a character back, and a
# run is entered at its start only, or where the last match ended.
GENERATORS = (
    Generator("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",)),
    Generator("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",)),
    Generator("card", True, r"[0-9](?:[\x20-]?[0-9])++"),
    Generator("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
    Generator("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[({]at[\])}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]++)++", ("@", "at)", "at]", "at}")),
    Generator("phone", False, r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    Generator("ip", False, r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])", (".]", ".)")),
    Generator("card", False, r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
)
#: Words before a candidate that speak for its kind, and words around it that speak against any.
CUES = {
    "email": r"(?i)\b((?:e-?)?mails?|mailto|contact|write|reach|address|reply)\b", "ip": r"(?i)\b(ip|ips|hosts?|from|address|server|login|client)\b",
    "card": r"(?i)\b(cards?|visa|mastercard|paid|charged?|debit|credit|payment)\b", "phone": r"(?i)\b(phones?|tel|telephone|calls?|called|fax|mobile|cell|dial|text|whatsapp|contact|reach)\b",
}
AGAINST = (
    r"(?i)\b(order|orders|invoice|isbn|issn|build|built|version|release|v|part|parts|sku|serial|item|items|units?|sum|total|list|lot|batch|ref|reference|ticket|case|id|ids|no|nr|number|code"
    r"|model|volume|pages?|rows?|lines?|section|chapter|sample|example|range|ratio|steps?|test|log|tracking|shipment|account|sold|euros?|dollars?|pieces|kg|mm)\b"
)
CONTEXT = 24
FEATURES = ["generator", "digits", "groups", "luhn", "parts", "brackets", "cue", "against", "joined", "run"]
#: Digits from which a number, with those around it, is too long for a phone.
TOO_LONG = 16
#: Accepted candidates of a generator are positive at this rate.
PRECISION = 0.98
#: Made-up texts: the trees are fitted to those of two in three contexts, the others set thresholds.
EXAMPLES = 6000
#: Of HELD_OUT contexts one is held out, with all its texts.
HELD_OUT = 3


def _luhn_digits(rnd: random.Random, valid: bool) -> str:
    """16 digits whose checksum fits, or doesn't."""
    d = [4, *(rnd.randrange(10) for _ in range(14))]
    total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
    last = -total % 10
    return "".join(map(str, [*d, last if valid else (last + rnd.randrange(1, 10)) % 10]))


def _form(rnd: random.Random, kind: str, valid: bool) -> str:
    number = lambda n: "".join(str(rnd.randrange(10)) for _ in range(n))
    if kind == "phone":
        a, b, c, sep = number(3), number(3), number(4), rnd.choice(" .-")
        return rnd.choice([f"({a}) {b}-{c}", f"{a}{sep}{b}{sep}{c}"])
    if kind == "email":
        at, dot = rnd.choice([(" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("{at}", "."), (" (at) ", " (dot) ")])
        return f"{rnd.choice(['bob', 'ann.lee', 'k_ito', 'info'])}{at}{rnd.choice(['x', 'mail-one', 'firm'])}{dot}{rnd.choice(['com', 'org', 'de'])}"
    if kind == "ip":
        parts = [rnd.randrange(256) if valid else rnd.randrange(100, 1000) for _ in range(4)]
        if not valid:
            parts[rnd.randrange(4)] = rnd.randrange(256, 1000)
        return rnd.choice(["[.]", "(.)"]).join(map(str, parts))
    digits = _luhn_digits(rnd, valid)
    return rnd.choice("./_").join(digits[i : i + 4] for i in range(0, 16, 4))


#: Contexts: what stands before and after a candidate. Personal ones by kind, and those of
#: numbers and words that only look like it, for all kinds.
PERSONAL = {
    "phone": (("call", ""), ("tel:", ""), ("fax", ""), ("my phone is", ""), ("mobile", "please"), ("dial", "now"), ("reach me at", "after six"), ("text", ""), ("cell:", "")),
    "email": (("mail", ""), ("contact", ""), ("e-mail to", ""), ("write to", "soon"), ("reach us at", ""), ("reply to", "")),
    "ip": (("ip", ""), ("from host", ""), ("address", ""), ("login from", "failed"), ("server", "is down"), ("client", "")),
    "card": (("card", ""), ("visa", ""), ("paid by card", ""), ("charged to", ""), ("credit card", "ends"), ("payment with", "")),
}
IMPERSONAL = (
    ("order", "shipped"), ("invoice no", "is due"), ("isbn", ""), ("build", "is out"), ("sum", "units sold"), ("list", "items"), ("version", "fixes it"), ("part", "fits"), ("ticket", "closed"),
    ("serial", ""), ("lot", "was bad"), ("tracking", "arrives"), ("sku", "sells"), ("ref", ""), ("rows", "were read"), ("a total of", "pieces"), ("sample", ""), ("code", "opens it"),
)


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, str | None, int]]:
    """(text, kind or None, context): texts with one candidate each, personal if a kind is
    named. What is not: the same shapes in other contexts or in none, forms joined to a
    word, parts of longer numbers, wrong checksums and parts."""
    rnd, out = random.Random(seed), []
    words = "the new report came late and all of them read it in May".split()
    some = lambda: " ".join(rnd.choices(words, k=rnd.randrange(1, 6)))
    for _ in range(n):
        kind, draw = rnd.choice(KINDS), rnd.random()
        shape = _form(rnd, kind, True)
        gaps, context, truth = (" ", " "), ("", ""), kind
        spot = rnd.randrange(HELD_OUT)  # texts without a context are shared out
        if draw < 0.45:  # personal, told by its context
            spot = rnd.randrange(len(PERSONAL[kind]))
            context = PERSONAL[kind][spot]
        elif draw < 0.55:  # personal by its form, where nothing speaks against it; four dotted groups are no card by themselves
            truth = None if kind == "card" else kind
        elif draw < 0.8:  # the same shape elsewhere
            truth, spot = None, rnd.randrange(len(IMPERSONAL))
            context = IMPERSONAL[spot]
        elif kind in ("ip", "card"):
            truth, shape = None, _form(rnd, kind, False)
            context = rnd.choice([("", ""), rnd.choice(PERSONAL[kind])])
        else:
            truth, way = None, rnd.randrange(3) if kind == "phone" else 0
            if way == 0:
                gaps = rnd.choice([(" ", "é"), (" ", "漢")]) if kind == "email" or rnd.random() < 0.5 else ("x", " ")
            elif way == 1:
                gaps = (f" {rnd.randrange(10**4, 10**6)} ", f" {rnd.randrange(10**4, 10**6)} ")
            else:
                gaps = (" ", f" {rnd.randrange(10**4, 10**6)} ")
        before, after = " ".join(x for x in (some(), context[0]) if x), " ".join(x for x in (context[1], some()) if x)
        out.append((f"{before}{gaps[0]}{shape}{gaps[1]}{after}", truth, spot))
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + doubled

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _small_parts(match: Column) -> Column:
    """No dotted part above 255, however many zeros it starts with."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(part(p).try_cast("int") <= MOST_IN_PART))


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    card = F.when(F.length(digits).between(*CARD_DIGITS), _luhn(digits)).otherwise(False)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", _small_parts(match))
        .when(kind == "card", card)
        .otherwise(F.length(digits).between(*PHONE_DIGITS))
    )


def _signless(match: Column) -> Column:
    """``match`` with bracketed signs as plain ones, so that features don't tell them apart."""
    at = F.regexp_replace(match, r"\x20?[\[({]at[\])}]\x20?", "@")
    return F.regexp_replace(at, r"\x20?[\[({](?:dot|\.)[\])}]\x20?", ".")


def _features(kind: Column, base: Column, match: Column, before: Column, after: Column) -> list[Column]:
    digits = _digits(match)
    count = F.length(digits)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return [
        F.when(count < 9, 0).when(count < 13, count).when(count < 16, 13).when(count == 16, 16).when(count < 20, 17).otherwise(20).alias("digits"),
        F.least(F.lit(4), F.size(F.split(match, r"[^0-9A-Za-z]+"))).alias("groups"),
        flag(F.when(count.between(*CARD_DIGITS), _luhn(digits))).alias("luhn"),
        flag(F.when(kind == "ip", _small_parts(match))).alias("parts"),
        flag(match.contains("(")).alias("brackets"),
        flag(reduce(Column.__or__, [(kind == k) & before.rlike(cue) for k, cue in CUES.items()])).alias("cue"),
        flag(before.rlike(AGAINST) | after.rlike(AGAINST)).alias("against"),
        flag(before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")).alias("joined"),
        flag(~base & (F.length(_digits(F.concat(F.regexp_extract(before, r"(?:[0-9][\x20-]?)++$", 0), match, F.regexp_extract(after, r"^(?:[\x20-]?[0-9])++", 0)))) >= TOO_LONG)).alias("run"),
    ]


def propose(rows: DataFrame) -> DataFrame:
    """``rows`` with ``found``: an array of the text's candidates with validity and
    features, and ``settled``: the array of its valid base spans."""
    text, columns = whole_text(), rows.columns
    matches = [F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0)) for g in GENERATORS]
    hinted = lambda g: reduce(Column.__or__, [text.contains(h) for h in g.hints])
    matches = [F.when(hinted(g), m).otherwise(F.array().cast("array<string>")) if g.hints else m for g, m in zip(GENERATORS, matches)]
    rows = rows.select(*columns, *[m.alias(f"_m{i}") for i, m in enumerate(matches)])
    each = F.array(*[F.struct(F.lit(i).alias("generator"), gaps_of(text, g.pattern, F.col(f"_m{i}")).alias("gaps"), F.col(f"_m{i}").alias("whole")) for i, g in enumerate(GENERATORS)])
    spans = F.flatten(F.transform(each, lambda x: F.transform(spans_between(x["gaps"], x["whole"], x["whole"], CONTEXT), lambda s: s.withField("generator", x["generator"]))))
    of = lambda values: lambda i: F.array(*[F.lit(v) for v in values])[i]
    rank, kind, base = of([KINDS.index(g.kind) for g in GENERATORS]), of([g.kind for g in GENERATORS]), of([g.base for g in GENERATORS])

    def described(s: Column) -> Column:
        i = s["generator"]
        signless = F.when(kind(i).isin("email", "ip") & ~base(i), _signless(s["match"])).otherwise(s["match"])
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), rank(i).alias("rank"), kind(i).alias("kind"), base(i).alias("base"), i.alias("generator"),
            _valid(kind(i), s["match"]).alias("valid"), *_features(kind(i), base(i), signless, s["before"], s["after"]),
        )

    rows = rows.select(*columns, F.transform(spans, described).alias("found"))
    return rows.select("*", F.filter("found", lambda c: c["base"] & c["valid"]).alias("settled"))


def fit(spark: SparkSession) -> tuple[list[boosting.Node], dict[int, float], dict[int, tuple[int, int, int]]]:
    """Trees, the threshold of each generator that isn't of a base form, and how they
    do on the texts held out: (accepted, of these personal, personal)."""
    made = spark.createDataFrame(examples(), "text string, truth string, context int").withColumn("held", F.col("context") % HELD_OUT == 1)
    seen = propose(made).select("held", "truth", F.explode(F.filter("found", lambda c: ~c["base"])).alias("c"))
    personal = F.coalesce(F.col("truth") == F.col("c.kind"), F.lit(False))
    counted = seen.groupBy("held", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.count_if(personal).alias("positives"))
    cells = sorted((r.asDict() for r in counted.collect()), key=lambda c: [c[k] for k in FEATURES])
    trees = boosting.boost([c for c in cells if not c["held"]], FEATURES)
    limits, figures = {}, {}
    for i, g in enumerate(GENERATORS):
        if not g.base:
            kept = [c for c in cells if c["held"] and c["generator"] == i]
            limits[i] = boosting.threshold(kept, trees, PRECISION)
            passed = [c for c in kept if boosting.predict(trees, c) >= limits[i]]
            figures[i] = (sum(c["n"] for c in passed), sum(c["positives"] for c in passed), sum(c["positives"] for c in kept))
    return trees, limits, figures


def with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with ``spans``: the personal data of their texts, by start. Nothing is
    joined or shuffled."""
    trees, limits, _ = fit(rows.sparkSession)

    def accepted(c: Column) -> Column:
        passed = F.lit(False)
        for i, limit in limits.items():
            if limit < float("inf"):
                # Scores of equal cells are equal sums; the slack only covers their rounding.
                passed = passed | ((c["generator"] == i) & (boosting.expression(trees, lambda f: c[f]) >= limit - 1e-9))
        return ~c["base"] & passed

    plain = lambda spans: F.transform(spans, lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "rank", "kind", "base")]))
    rows = propose(rows).withColumn("_added", plain(F.filter("found", accepted))).withColumn("_settled", plain(F.col("settled"))).drop("found", "settled")
    spans = F.when(F.size("_added") > 0, F.array_sort(_apart(F.concat("_settled", "_added")))).otherwise(F.array_sort("_settled"))
    return rows.withColumn("spans", spans).drop("_added", "_settled")


def _apart(spans: Column) -> Column:
    """``spans`` without those that are not of a base form and overlap one that is. By start,
    the furthest end of the base spans so far and the next one's start tell."""
    by_start = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (~s["base"]).alias("added"), s.alias("span")))), lambda x: x["span"])
    last = F.lit(2**31 - 1)

    def of(x: Column) -> Column:
        upto = running(F.transform(x, lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.greatest)
        coming = F.reverse(running(F.reverse(F.transform(x, lambda s: F.when(s["base"], s["start"]).otherwise(last))), F.least))
        both = bound(upto, lambda u: bound(coming, lambda c: F.filter(x, lambda s, i: s["base"] | ((u[i] <= s["start"]) & (c[i] >= s["end"])))))
        return both

    return bound(by_start, of)


def pii_report(docs: DataFrame) -> DataFrame:
    rows = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda i: F.size(F.filter(base, lambda s: s["rank"] == i)).cast("long")
    return rows.select(
        "doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(span_digest(base, by_kind=True), 256).alias("base_sha256"), span_digest(F.col("spans"), by_kind=True).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; of
    overlapping spans the first names the whole. ``n_chars`` follows the text;
    texts without spans stay as they are."""
    rows = with_spans(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    clean = F.size("spans") == 0
    return with_text(rows, docs.columns, F.when(clean, F.col("text")).otherwise(replaced(F.col("text"), F.col("spans"))), clean)


ORACLE_SQL = None
