from datetime import date

from qoslattice.operators import reports
from qoslattice.sources.star import from_orders


def test_pack_renders_everywhere(spark, sf_dir):
    tables = reports.pack(from_orders(spark, sf_dir), sections=("summary", "severity"))
    assert [t.title for t in tables] == ["Summary", "Severity"] and len(tables[0].rows) == 1
    assert reports.as_markdown(tables).startswith("## Summary")
    assert reports.as_csv(tables).count("# ") == 2
    assert "<table>" in reports.as_html(tables)


def test_cells_are_escaped():
    t = [reports.Table("T", ["a"], [("<x>|",), (None,)])]
    assert "&lt;x&gt;|" in reports.as_html(t) and "<x>\\|" in reports.as_markdown(t)


def test_due():
    assert reports.due("weekly", date(2026, 7, 1), date(2026, 7, 10)) == (date(2026, 7, 8), 2)
    assert reports.due("monthly", None, date(2026, 7, 10)) == (date(2026, 7, 10), 0)
