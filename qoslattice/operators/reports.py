"""Report packs: sections as small tables, rendered as Markdown, CSV or HTML.

A section is a DataFrame with a bounded number of rows; only those reach the
driver, to be rendered. Packs that are published leave a record in a history of
JSON lines, which anyone can read and which writers only append to.
"""

from __future__ import annotations

import csv
import html
import io
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.star import Star
from . import forecast, intelligence, overview, views

MOST_ROWS = 200
#: Days after which a report of a schedule is due again.
SCHEDULES = {"weekly": 7, "monthly": 30, "quarterly": 91}

SECTIONS: dict[str, Callable[[Star], DataFrame]] = {
    "summary": views.summary,
    "executive": views.executive_health,
    "kpi_cards": views.executive_cards,
    "nc_movement": intelligence.nc_movement,
    "nc_lifecycle": lambda s: intelligence.histogram(s, "lifecycle"),
    "severity": lambda s: intelligence.histogram(s, "severity"),
    "priority": lambda s: intelligence.priority_queue(s, limit=20),
    "health": lambda s: intelligence.health_network(s).orderBy("period", ascending=False).limit(12),
    "worst_cells": lambda s: intelligence.health_snapshot(s, 20),
    "worst_districts": views.worst_districts,
    "comparison": lambda s: views.compare_periods(s, "region"),
    "risk": forecast.risk_counts,
    "technologies": overview.technology_cards,
    "recommendations": overview.recommendations,
}
#: Report type: its sections.
TYPES = {
    "executive": ("summary", "executive", "technologies", "kpi_cards", "worst_districts", "nc_movement", "recommendations"),
    "operations": ("summary", "priority", "severity", "worst_cells", "comparison"),
    "planning": ("summary", "health", "nc_movement", "risk"),
}


@dataclass
class Table:
    title: str
    columns: list[str]
    rows: list[tuple]


def section(star: Star, name: str) -> Table:
    df = SECTIONS[name](star).limit(MOST_ROWS)
    return Table(name.replace("_", " ").capitalize(), df.columns, [tuple(r) for r in df.collect()])


def pack(star: Star, kind: str = "executive", sections: tuple[str, ...] | None = None) -> list[Table]:
    return [section(star, s) for s in sections or TYPES[kind]]


def _text(v) -> str:
    return "" if v is None else str(v)


def as_markdown(tables: list[Table]) -> str:
    cell = lambda v: _text(v).replace("|", "\\|")
    out = []
    for t in tables:
        out += [f"## {t.title}", "", "| " + " | ".join(t.columns) + " |", "|" + "---|" * len(t.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in t.rows] + [""]
    return "\n".join(out)


def as_csv(tables: list[Table]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for t in tables:
        writer.writerow([f"# {t.title}"])
        writer.writerow(t.columns)
        writer.writerows([[_text(v) for v in r] for r in t.rows])
    return out.getvalue()


def as_html(tables: list[Table], title: str = "Report") -> str:
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(_text(v))}</{tag}>" for v in values) + "</tr>"
    body = "".join(f"<h2>{html.escape(t.title)}</h2><table>{row('th', t.columns)}{''.join(row('td', r) for r in t.rows)}</table>" for t in tables)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{body}</body></html>"


def due(schedule: str, last: date | None, today: date) -> tuple[date, int]:
    """(next due date, days overdue); a report never made is due today."""
    following = today if last is None else last + timedelta(days=SCHEDULES[schedule])
    return following, max(0, (today - following).days)


RENDERERS = {"md": as_markdown, "csv": as_csv, "html": as_html}
HISTORY = "id string, kind string, schedule string, made_at timestamp, sections int, rows long, formats array<string>"


def publish(star: Star, folder: str, kind: str, made_at: datetime, formats: tuple[str, ...] = ("md",), schedule: str | None = None) -> str:
    """Render a pack into ``folder`` (any Hadoop path), one text a format, and append its
    record; returns the pack's id. The record comes last, so what it names is there."""
    tables, name = pack(star, kind), uuid.uuid4().hex
    for f in formats:
        star.spark.createDataFrame([(RENDERERS[f](tables),)], "value string").coalesce(1).write.text(f"{folder}/packs/{name}.{f}")
    record = (name, kind, schedule, made_at, len(tables), sum(len(t.rows) for t in tables), list(formats))
    star.spark.createDataFrame([record], HISTORY).coalesce(1).write.mode("append").json(f"{folder}/history")
    return name


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Records (HISTORY), newest first. Lines that are no record are left out."""
    lines = spark.read.schema(HISTORY + ", broken string").option("columnNameOfCorruptRecord", "broken").json(f"{folder}/history")
    return lines.filter("broken IS NULL AND id IS NOT NULL").drop("broken").orderBy(F.desc("made_at"), "id")


def due_reports(records: DataFrame, today: date) -> DataFrame:
    """(kind, schedule, last, next_due, days_overdue) of everything that has a schedule."""
    newest = Window.partitionBy("kind", "schedule").orderBy(F.desc("made_at"))
    last = records.filter(F.col("schedule").isin(*SCHEDULES)).withColumn("rn", F.row_number().over(newest)).filter("rn = 1")
    days = F.create_map(*[F.lit(x) for pair in SCHEDULES.items() for x in pair])[F.col("schedule")]
    rows = last.select("kind", "schedule", F.col("made_at").cast("date").alias("last"), F.date_add(F.col("made_at").cast("date"), days).alias("next_due"))
    return rows.withColumn("days_overdue", F.greatest(F.lit(0), F.datediff(F.lit(today), "next_due")))
