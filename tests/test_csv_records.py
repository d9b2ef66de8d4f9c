"""CSV records over line breaks, against Python's own reader, with splits of a few bytes."""

import csv
import io
import random

import pytest

from qoslattice.sources import ingest
from qoslattice.sources.workspace import Workspace


@pytest.fixture(params=[40, 1000])
def small_splits(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], 0)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def staged(spark, folder, columns):
    rows = ingest.stage_csv(spark, f"file://{folder}")
    good, bad = ingest.split_rejects(rows.orderBy("line"))
    return [tuple(r[c] for c in columns) for r in good.collect()], bad.count()


def test_fields_over_lines_and_splits(spark, tmp_path, small_splits):
    rng = random.Random(7)
    bits = ["a", "b c", "\n", "\n\n", '"', ",", "é", "x" * 30, "", "1.5"]
    want = []
    for name in ("a.csv", "b.csv", "c.csv"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["Date", "Cell", "Remark"])
        for i in range(60):
            # Files without a line break in a field, with some, and with nearly nothing else.
            field = "".join(rng.choices(bits, k=rng.randint(0, 6))) if name != "a.csv" and (name == "c.csv" or i % 9 == 0) else f"r{i}"
            row = (f"2026-01-{i % 28 + 1:02d}", f"{name[0]}{i}", field.strip(" ") or "-")
            writer.writerow(row)
            want.append(row)
        (tmp_path / name).write_text(out.getvalue())
    got, bad = staged(spark, tmp_path, ["Date", "Cell", "Remark"])
    assert bad == 0 and got == want


def test_a_quote_that_nothing_closes_spoils_its_line_alone(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('Date,Cell\n2026-01-01,A\n2026-01-02,"B\nb"\n2026-01-03,"C\n' + "".join(f"2026-01-{d:02d},D\n" for d in range(4, 20)))
    got, bad = staged(spark, tmp_path, ["Date", "Cell"])
    assert got[:2] == [("2026-01-01", "A"), ("2026-01-02", "B\nb")] and len(got) + bad == 2 + 1 + 16 and got[-1] == ("2026-01-19", "D")


def test_header_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,"Cell\nName","4G ""peak"""\n2026-01-01,"A\nA",3\n')
    assert ingest.header_of(spark, f"file://{tmp_path}") == ["Date", "Cell\nName", '4G "peak"']
    assert staged(spark, tmp_path, ["Date", "Cell\nName", '4G "peak"']) == ([("2026-01-01", "A\nA", "3")], 0)


def test_import_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Cell,Site,District,Region,PRB utilization\n2026-01-05,"C\n1",S,D,R,10\n2026-01-05,C2,S,D,R,20\n')
    ws = Workspace(spark, f"file://{tmp_path}/ws")
    result = ws.import_csv(f"file://{tmp_path}/a.csv")
    assert (result.inserted, result.rejected) == (2, 0)
    assert {r["cell"] for r in ws.table("cells").collect()} == {"C\n1", "C2"}
