"""Column expressions that the operators share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIFECYCLES = ("Chronic", "Persistent", "Recurring", "New", "Recovering", "Healthy")
SEVERITIES = ("Critical", "High", "Watch", "Normal")
BANDS = (("Critical", 90), ("High", 75), ("Medium", 50), ("Watch", 25))


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x, digits: int = 4) -> Column:
    """Half up, with a slack for halves that binary fractions or the order of
    additions put a hair below: every engine and every plan gives the same."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.500001) / scale


def clamp(x, low=0.0, high=100.0) -> Column:
    """Nulls count as ``low``: least and greatest skip them."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(x)))


def clamp_round(x, low=0.0, high=100.0, digits=1) -> Column:
    return rounded(clamp(x, low, high), digits)


def breach(value, target, worse_is_higher) -> Column:
    """Strictly past the target in the bad direction; null values or targets don't breach."""
    value, target = col(value), col(target)
    past = F.when(col(worse_is_higher), value > target).otherwise(value < target)
    return F.coalesce(past, F.lit(False))


def severity_pct(value, target, worse_is_higher) -> Column:
    """How far past the target, in percent of it, within 0 and 100; null for a target of 0."""
    value, target = col(value), col(target)
    away = F.when(col(worse_is_higher), value - target).otherwise(target - value)
    share = away / F.when(target != 0, target) * 100
    return F.when(share.isNotNull(), clamp(share))


def by_agg(agg, avg="avg", total="sum", most="max", least="min") -> Column:
    """The column that a KPI's own aggregation names."""
    return F.when(col(agg) == "sum", col(total)).when(col(agg) == "max", col(most)).when(col(agg) == "min", col(least)).otherwise(col(avg))


def band(score) -> Column:
    score = col(score)
    out = F.when(score >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("Low")


def pct_change(now, before) -> Column:
    """In percent; null unless ``before`` is positive."""
    now, before = col(now), col(before)
    return F.when(before > 0, (now - before) / before * 100)


def per_day(total, days) -> Column:
    days = col(days)
    return col(total) / F.when(days != 0, days)


def delta(now, before, digits=2) -> Column:
    return rounded(col(now) - col(before), digits)


def delta_pct(now, before, digits=1) -> Column:
    before = col(before)
    return rounded((col(now) - before) / F.when(before != 0, F.abs(before)) * 100, digits)


def rank_of(value, order) -> Column:
    """Place of ``value`` in ``order``, for sorting by meaning."""
    value = col(value)
    out = F.when(value == order[0], 0)
    for i, name in enumerate(order[1:], 1):
        out = out.when(value == name, i)
    return out.otherwise(len(order))


def compliance(value, target, warning, critical, worse_is_higher) -> Column:
    bad = lambda limit: breach(value, limit, worse_is_higher)
    return (
        F.when(col(value).isNull(), "unavailable")
        .when(col(target).isNull() | ~bad(target), "compliant")
        .when(bad(critical), "non_compliant")
        .when(bad(warning), "warning")
        .otherwise("non_compliant")
    )


def quadrant(prb, throughput, threshold, median) -> Column:
    busy, fast = col(prb) >= col(threshold), col(throughput) >= col(median)
    return F.when(busy & ~fast, "congested").when(busy, "busy").when(~fast, "quiet").otherwise("healthy")


def dual_quadrant(x_bad, y_bad) -> Column:
    return F.when(col(x_bad) & col(y_bad), "critical").when(col(x_bad), "x_impaired").when(col(y_bad), "y_impaired").otherwise("optimal")


def nc_transition(now, before) -> Column:
    """By the counts of non-compliant cells in both periods; nulls count as 0."""
    now, before = F.coalesce(col(now), F.lit(0)), F.coalesce(col(before), F.lit(0))
    return F.when((now > 0) & (before > 0), "nc").when(now > 0, "new").when(before > 0, "recovered").otherwise("ok")


def card_trend(key, now, change, warning, target, worse_is_higher, least=0.001) -> Column:
    """Direction of a change; a load (``prb`` in the key) below its warning level only grows, it doesn't worsen."""
    now, change = col(now), col(change)
    calm = col(key).contains("prb") & ~F.coalesce(now >= F.coalesce(col(warning), 0.88 * col(target), F.lit(70.0)), F.lit(False))
    worse = F.when(col(key).contains("prb") | col(worse_is_higher), change > 0).otherwise(change < 0)
    return F.when(change.isNull() | (F.abs(change) < least) | calm, "stable").when(worse, "worsening").otherwise("improving")


def numbered(rows: DataFrame, bucket: Column, order: list, name: str) -> DataFrame:
    """``rows`` with their number from 1 on in ``order``. ``bucket`` rises with the
    order: rows are numbered within their bucket, after all rows of earlier ones, so
    no task sees more than a bucket, or a count for each."""
    keyed = rows.withColumn("_bucket", bucket)
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return keyed.withColumn("_place", place).join(starts, "_bucket").withColumn(name, F.col("_before") + F.col("_place")).drop("_bucket", "_before", "_place")


def magnitude(x) -> Column:
    """A whole number that rises with ``x``: sixteenths of powers of two, so there are few. Null for null."""
    x = col(x)
    return F.signum(x).cast("int") * F.ceil(16 * F.log2(1 + F.abs(x))).cast("int")


def period_start(date, grain: str) -> Column:
    date = col(date)
    return date if grain == "daily" else F.trunc(date, "week" if grain == "weekly" else "month")


def period_label(start, grain: str) -> Column:
    """A period's short name: month and day, ISO week as W31, or year and month."""
    start = col(start)
    if grain == "weekly":
        return F.concat(F.lit("W"), F.weekofyear(start).cast("string"))
    return F.date_format(start, "MM-dd" if grain == "daily" else "yyyy-MM")


def add_periods(start, steps, grain: str) -> Column:
    """The start of the period ``steps`` further on, or back if negative."""
    start, steps = col(start), col(steps) if isinstance(steps, str) else steps if isinstance(steps, Column) else F.lit(steps)
    if grain == "monthly":
        return F.add_months(start, steps)
    return F.date_add(start, (steps * (7 if grain == "weekly" else 1)).cast("int"))


#: Unit, the next larger one, and how many make one of it.
LARGER_UNITS = {"kbps": ("Mbps", 1000), "MB": ("GB", 1024)}


def in_words(value, unit, digits: int = 1) -> Column:
    """A value with its unit for people: large rates and volumes in the larger unit, percents
    without a space, "-" as no unit, nothing at all as a dash."""
    value, unit = col(value), col(unit)
    number = lambda x: F.regexp_replace(F.format_number(x, digits), ",", "")
    out = F.when(value.isNull(), "\u2014")
    for small, (large, factor) in LARGER_UNITS.items():
        out = out.when((unit == small) & (F.abs(value) >= factor), F.concat(number(rounded(value / factor, digits)), F.lit(f" {large}")))
    plain = number(rounded(value, digits))
    return out.when(unit.isNull() | (unit == "-") | (unit == ""), plain).when(unit == "%", F.concat(plain, F.lit("%"))).otherwise(F.concat(plain, F.lit(" "), unit))


def contains_folded(needle: str, *columns) -> Column:
    """Any of ``columns`` holds ``needle``, whatever the case; nulls don't."""
    found = [F.coalesce(F.contains(F.lower(col(c)), F.lit(needle.lower())), F.lit(False)) for c in columns]
    return reduce(Column.__or__, found)


def header_key(name) -> Column:
    """A header's comparable form: one spelling of utilization, words of letters and digits."""
    low = F.regexp_replace(F.lower(col(name)), "utilisation", "utilization")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def place_key(name) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(name))), r"\s+", " ")


def token_overlap(a, b) -> Column:
    """Jaccard overlap of the words of two header keys."""
    x, y = F.array_distinct(F.split(col(a), " ")), F.array_distinct(F.split(col(b), " "))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def name_similarity(a, b) -> Column:
    """1 less the edit distance over the longer length."""
    longest = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(col(a), col(b)) / longest)


#: Accepted date patterns, in the order in which they are tried.
DATE_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss",
    "d/M/yy HH:mm:ss", "d/M/yy HH:mm", "d/M/yy",
    "d-M-yy HH:mm:ss", "d-M-yy HH:mm", "d-M-yy",
    "d.M.yy HH:mm:ss", "d.M.yy HH:mm", "d.M.yy",
    "d-MMM-yy", "M/d/yy",
    "yyyy-M-d HH:mm:ss", "yyyy-M-d",
    "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy",
    "d-M-yyyy HH:mm:ss", "d-M-yyyy HH:mm", "d-M-yyyy",
    "d.M.yyyy HH:mm:ss", "d.M.yyyy HH:mm", "d.M.yyyy",
    "d-MMM-yyyy", "M/d/yyyy", "yyyy/M/d", "yyyyMMdd",
)


_SHAPES = (
    ("'T'", "T"), ("XXX", r"(?:Z|[+-]\d\d:\d\d)"), ("yyyy", r"\d{4}"), ("yy", r"\d{2}"), ("MMM", "[A-Za-z]{3}"), ("MM", r"\d{2}"), ("dd", r"\d{2}"),
    ("HH", r"\d{2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}"), ("M", r"\d{1,2}"), ("d", r"\d{1,2}"), (".", r"\."),
)


def date_shape(pattern: str) -> str:
    """A regex for the texts that ``pattern`` could parse."""
    out = ""
    while pattern:
        part, shape = next(((p, s) for p, s in _SHAPES if pattern.startswith(p)), (pattern[0], pattern[0]))
        out, pattern = out + shape, pattern[len(part) :]
    return f"^{out}$"


def _lead(pattern: str) -> str:
    """A regex for how texts of ``pattern`` begin: their first number and what follows it."""
    return date_shape(re.match(r"[A-Za-z]+[^A-Za-z']?", pattern)[0]).rstrip("$") if re.search(r"[^A-Za-z]", pattern) else date_shape(pattern)


def _one(x: Column, of) -> Column:
    """``of(x)`` with ``x`` worked out once. A lambda's body is not compiled: as part of
    compiled code, long chains outgrow what the JVM optimizes, and slow all beside them."""
    return F.transform(F.array(x), of)[0]


def _tried(text: Column, pattern: str) -> Column:
    date = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    if "yy" in pattern and "yyyy" not in pattern:
        date = _one(date, lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
    return F.when(text.rlike(date_shape(pattern)), date)


def parsed_date(text, likely: str | None = None) -> Column:
    """The date by the first pattern that fits, else by a cast, else null. A failed
    parse is dear, so a pattern is tried on texts of its shape only, and shapes are looked
    at among patterns of one beginning, which no text shares with another. Two-digit
    years from 69 on are of the last century."""
    groups = {}
    for p in DATE_PATTERNS:
        groups.setdefault(_lead(p), []).append(p)

    def of(text: Column) -> Column:
        by_lead = None
        for lead, patterns in groups.items():
            tries = F.coalesce(*[_tried(text, p) for p in patterns])
            by_lead = F.when(text.rlike(lead), tries) if by_lead is None else by_lead.when(text.rlike(lead), tries)
        # Spreadsheets write days since the end of 1899.
        serial = F.when(text.rlike(r"^[1-9][0-9]{4}(\.[0-9]+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), text.try_cast("double").cast("int")))
        return F.coalesce(*([_tried(text, likely)] if likely else []), by_lead, serial, text.try_cast("date"))

    return _one(F.trim(col(text)), of)
