"""Spelling variants, line rules and fill-in-the-middle against brute force, and their edges."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import pytest

from qoslattice.llm import fill_middle, line_rules, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in texts], DOCS)


def edits(w, letters):
    """All strings one edit away, over ``letters``."""
    cuts = [w[:i] + w[i + 1 :] for i in range(len(w))]
    swaps = [w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters]
    more = [w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters]
    return {*cuts, *swaps, *more} - {w}


def brute_variants(words, times_more=5):
    letters = sorted({c for w in words for c in w})
    near = {w: sorted((-words[e], e) for e in edits(w, letters) if e in words) for w in words}
    form = {w: n[0][1] if n and -n[0][0] >= times_more * words[w] else None for w, n in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


@pytest.mark.parametrize("block", [2048, 4])
def test_variants_against_all_edits(spark, block, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(1)
    # Few letters: repeated bigrams, ties in frequency, and shifted places; é takes two bytes.
    words = {"".join(rng.choices("abé", k=rng.randint(6, 8))) for _ in range(400)} | {"a" * k for k in (6, 7, 8, 40, 41)} | {"a" * 5000, "a" * 5001, "a" * 4999 + "b"}
    words = {w: rng.choice([5, 5, 6, 25, 125, 700]) for w in words}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    small = {w for w in words if len(w) < 100}
    want = brute_variants({w: words[w] for w in small})
    assert {tuple(r) for r in got if r["word"] in small} == want and len(got) == len(words)
    assert {r["word"]: r["n_near"] for r in got if r["word"] not in small} == {"a" * 5000: 2, "a" * 5001: 1, "a" * 4999 + "b": 1}


def test_variants_of_texts(spark):
    rng = random.Random(2)
    stock = ["Straße", "strasse", "running", "runing", "été", "Éclairs", "eclairs", "éclairs", "x", "×÷×÷×÷", "colour", "colours"]
    texts = [(rng.choice([None, 1, 2, 3, 700]), " ".join(rng.choices(stock, k=rng.randint(0, 60)))) for _ in range(120)] + [(1, None), (1, ""), (None, None), (9, "running," * 3000)]
    words = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            words[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    rows = docs(spark, texts).selectExpr("*", "'x' AS word", "1 AS n", "'y' AS id", "'z' AS gram")
    assert {tuple(r) for r in spelling.variants_report(rows).collect()} == brute_variants(words)
    assert "runing" in words and spelling.group_variants(rows).filter("word = 'running'").first()["root"] == "running"
    assert spelling.variants_report(docs(spark, [])).count() == 0 == spelling.variants_report(docs(spark, [(1, None), (None, "a b c")])).count()


def test_misspelt_runs(spark):
    rows = [(i, f"word{chr(97 + i % 26)}é") for i in range(3000)]
    got = spark.createDataFrame(rows, "i long, w string").select("i", "w", spelling.misspelt(spelling.F.col("w"), spelling.F.col("i")).alias("m")).collect()
    for i, w, m in got:
        h = zlib.crc32(f"{i}:{w}".encode())
        assert m == (w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w)
    assert sum(w != m for _, w, m in got) > 5


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(100)]
    assert {r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w100"}


def brute_rules(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def test_base_rules_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["a", "b", "cd", " ", " ", "\n", "\n", "\t", "#", "<>", "é", " ", "\x1c", "\U0001f600", ".", "漢"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 200))) for _ in range(300)] + [None, "", "\n\n", "a " * 300]
    got = line_rules.rules_report(docs(spark, list(enumerate(texts)))).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert len(got) == len(texts) and line_rules.repeated("x y " * 30_000) == 60_000


PROSE = "The river rose for three days, and the people of the valley moved their herds to the hills. Nobody had seen such a flood before, though the old songs spoke of one."
MORE = "When the water fell at last, fields lay under grey mud, and each family went down to look for its own stones. By spring the barley stood higher than in any year that they could recall."
FAILING = ["Home | About us | Products | Contact", "Read more", "Log in", "© 2020 Example Ltd. All rights reserved.", "This site uses cookies.", "BUY!! NOW!! IT!! IS!! GOOD!!", "wo### rd$$$ li*** ke### th%%% is&&&", "word " * 60]
PASSING = ["", "  ", "A heading without a stop", "She asked: why?", "5 * 4 = 20, and 3 < 4 in the ring of whole numbers.", "We met at home.", "• an item of a list", "Read more books than last year."]


def test_lines_are_judged_by_themselves(spark):
    rows = spark.createDataFrame([(x,) for x in FAILING + PASSING], "line string").select("line", line_rules.passes(line_rules.F.col("line")).alias("ok")).collect()
    assert {r["line"] for r in rows if r["ok"]} == set(PASSING)


def test_clean_removes_lines_and_rejects_texts(spark):
    good = "\n".join([FAILING[0], PROSE, "", MORE, FAILING[3]])
    rows = docs(spark, [(1, good), (2, "\n".join(FAILING * 3)), (3, "too short"), (4, None), (5, " ".join(f"w{i}." for i in range(20_000)))]).selectExpr("*", "'x' AS kept", "'y' AS row", "'z' AS cleaned")
    kept = {r["doc_id"]: r for r in line_rules.clean(rows).collect()}
    assert set(kept) == {1, 5} and kept[1]["text"] == "\n".join(good.split("\n")[1:4]) and kept[1]["n_chars"] == len(kept[1]["text"])
    assert line_rules.clean(rows).columns == rows.columns and kept[1]["kept"] == "x" and kept[1]["row"] == "y"


def brute_middle(i, t, seed=1):
    t = t or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in range(0, 32, 8)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, t
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_against_brute_force(spark):
    rng = random.Random(4)
    bits = ["ab", "c", " ", "\n", "é", "<", "P>", "S", ">", "<S", "M>", "漢", "\U0001f600", "1"]
    texts = [(None if i % 17 == 0 else i % 150, "".join(rng.choices(bits, k=rng.randint(0, 40)))) for i in range(600)] + [(1, None), (2, ""), (3, "x" * 60_000), (4, "- " * 60_000), (5, "a <M> b")]
    rows = docs(spark, texts).selectExpr("*", "'x' AS row", "'y' AS form", "7 AS n", "'z' AS output", "'k' AS key")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *brute_middle(i, t), t or "") for i, t in texts]
    got = [tuple(r) for r in fill_middle.fill_middle_report(rows).collect()]
    assert Counter(got) == Counter((*w[:5], sha(w[5]), sha(w[6])) for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    out = fill_middle.fill_in_middle(rows, seed=5)
    assert out.columns == rows.columns and fill_middle.fill_in_middle(docs(spark, [])).count() == 0
    assert Counter((r["doc_id"], r["text"], r["n_chars"], r["row"], r["n"]) for r in out.collect()) == Counter((i, x := brute_middle(i, t, 5)[4], len(x), "x", 7) for i, t in texts)


def test_results_leave_in_portions(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK", 50)
    texts = [(i, "ab cd " * (i % 9)) for i in range(100)]
    assert {(r["doc_id"], r["n"], r["output_sha256"]) for r in fill_middle.fill_middle_report(docs(spark, texts)).collect()} == {(i, (x := brute_middle(i, t))[0], hashlib.sha256(x[4].encode()).hexdigest()) for i, t in texts}


def test_matching_takes_no_memory():
    text = "a-" * 200_000
    tracemalloc.start()
    n = fill_middle.count_units(text)
    assert n == 400_000 and fill_middle.cut_points(text, 100_001, 399_999) == (100_001, 399_999) and fill_middle.cut_points(text, 0, 0) == (0, 0)
    assert tracemalloc.get_traced_memory()[1] < 20_000
    tracemalloc.stop()
