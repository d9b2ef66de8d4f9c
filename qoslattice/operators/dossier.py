"""Investigation as a whole: what is known about any number of entities of any scope.

Entities that are asked for are rows (ASKED). Cells are unfolded to the entities they
belong to and only the asked ones kept, so every part is one aggregation by entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import delta, delta_pct, rounded
from ..sources.star import Star
from .aggregates import ENTITY, cell_weekly
from .intelligence import health_last, last_week
from .investigate import diagnosis, findings
from .views import AVERAGED, METRICS

#: Entities to look at; the network's id is 0 or null.
ASKED = "scope string, id long"
#: The entity above, whose other entities are the peers.
PARENT = {"cell": "district_id", "site": "district_id", "district": "region_id", "region": None}
#: Names on the way down to an entity.
PATH = {"cell": ("region", "district", "site", "cell"), "site": ("region", "district", "site"), "district": ("region", "district"), "region": ("region",), "network": ()}


def _asked(asked: DataFrame) -> DataFrame:
    return asked.select("scope", F.coalesce("id", F.lit(0).cast("long")).alias("id")).distinct()


def unfolded(star: Star) -> DataFrame:
    """(cell_id, scope, id, name, path, parent): each cell under every entity it belongs to."""
    entities = []
    for scope, (key, name) in ENTITY.items():
        parent = PARENT.get(scope)
        entities.append(F.struct(
            F.lit(scope).alias("scope"), (F.col(key) if key else F.lit(0)).cast("long").alias("id"), (F.col(name) if name else F.lit("Network")).alias("name"),
            F.concat_ws(" > ", F.lit("Network"), *PATH[scope]).alias("path"), (F.col(parent) if parent else F.lit(0)).cast("long").alias("parent"),
        ))
    return star.cells.select("cell_id", F.explode(F.array(*entities)).alias("e")).select("cell_id", "e.*")


def members(star: Star, asked: DataFrame) -> DataFrame:
    """(cell_id, scope, id): the cells of the asked entities."""
    return unfolded(star).join(_asked(asked), ["scope", "id"], "left_semi").select("cell_id", "scope", "id")


def identities(star: Star, asked: DataFrame) -> DataFrame:
    """(scope, id, name, path, cells): unknown entities have no row. Of several names
    of one id the first in order counts."""
    rows = unfolded(star).join(_asked(asked), ["scope", "id"], "left_semi")
    return rows.groupBy("scope", "id").agg(F.min("name").alias("name"), F.min("path").alias("path"), F.countDistinct("cell_id").alias("cells"))


def entity_weeks(star: Star, asked: DataFrame) -> DataFrame:
    """(scope, id, period, cells, nc_cells, metrics) of the asked entities."""
    figures = [rounded((F.avg if m in AVERAGED else F.sum)(m)).alias(m) for m in METRICS]
    return cell_weekly(star).join(members(star, asked), "cell_id").groupBy("scope", "id", "period").agg(F.count("*").alias("cells"), F.count_if("is_nc").alias("nc_cells"), *figures)


def entity_evidence(star: Star, asked: DataFrame, weeks: DataFrame | None = None) -> DataFrame:
    """(scope, id, metric, current, previous, delta, delta_pct): each entity's last two
    weeks with data. ``weeks``: rows of ``entity_weeks`` that are there already."""
    weeks = entity_weeks(star, asked) if weeks is None else weeks
    ranked = weeks.withColumn("rn", F.row_number().over(Window.partitionBy("scope", "id").orderBy(F.desc("period")))).filter("rn <= 2")
    at = lambda m, rn: F.max(F.when(F.col("rn") == rn, F.col(m)))
    wide = ranked.groupBy("scope", "id").agg(*[at(m, 1).alias(f"c_{m}") for m in METRICS], *[at(m, 2).alias(f"p_{m}") for m in METRICS])
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"c_{m}").alias("current"), F.col(f"p_{m}").alias("previous")) for m in METRICS])
    long = wide.select("scope", "id", F.explode(items).alias("x")).select("scope", "id", "x.*")
    return long.select("*", delta("current", "previous").alias("delta"), delta_pct("current", "previous").alias("delta_pct"))


def entity_findings(star: Star, asked: DataFrame) -> DataFrame:
    """(scope, id, finding, cells): how many cells of the entity show it in the last week."""
    return findings(star).join(members(star, asked), "cell_id").groupBy("scope", "id", "finding").agg(F.countDistinct("cell_id").alias("cells"))


def entity_hypotheses(star: Star, asked: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(scope, id, hypothesis, score, cells, place): the highest score among the entity's
    cells, how many reach 45, and the hypothesis' place, likeliest first."""
    rows = diagnosis(star, rules).join(members(star, asked), "cell_id").groupBy("scope", "id", "hypothesis").agg(F.max("score").alias("score"), F.count_if(F.col("score") >= 45).alias("cells"))
    order = Window.partitionBy("scope", "id").orderBy(F.desc("score"), F.desc("cells"), "hypothesis")
    return rows.withColumn("place", F.row_number().over(order))


def entity_peers(star: Star, asked: DataFrame, limit: int = 10) -> DataFrame:
    """(scope, id, peer_id, peer, health_score, place): the least healthy ``limit`` others under
    the same parent; the network has none. A parent's entities are ranked once and its first
    ``limit`` + 1 met with the asked ones, so no pair beyond those is formed."""
    levels = unfolded(star).filter("scope <> 'network'")
    known = last_week(star).select("cell_id").join(health_last(star).select("cell_id", "score"), "cell_id", "left")
    health = levels.join(known, "cell_id").groupBy("scope", "parent", F.col("id").alias("peer_id")).agg(F.min("name").alias("peer"), rounded(F.avg("score"), 1).alias("health_score"))
    order = Window.partitionBy("scope", "parent").orderBy(F.asc_nulls_last("health_score"), "peer_id")
    worst = health.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit + 1)
    here = levels.join(_asked(asked), ["scope", "id"], "left_semi").select("scope", "id", "parent").distinct()
    met = here.join(worst, ["scope", "parent"]).filter("peer_id <> id")
    place = F.row_number().over(Window.partitionBy("scope", "id").orderBy("nth"))
    return met.withColumn("place", place).filter(F.col("place") <= limit).select("scope", "id", "peer_id", "peer", "health_score", "place")


def investigation(star: Star, asked: DataFrame, rules: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """All parts in one shape: (scope, id, section, item, period, value, reference, note).

    identity: path, value cells. series: a metric's week, and nc_cells against cells.
    evidence: a metric now, reference before. finding: cells that show it, reference all
    cells. hypothesis: highest score, reference cells from 45 on. peer: its health.
    note: notes (investigate.NOTES) on the entity's cells. ``asked``: ASKED; repeated rows
    count once, unknown entities yield nothing."""
    weeks, who = entity_weeks(star, asked), identities(star, asked)
    none = {"period": F.lit(None).cast("date"), "value": F.lit(None).cast("double"), "reference": F.lit(None).cast("double"), "note": F.lit(None).cast("string")}

    def part(rows: DataFrame, section: str, item, **given) -> DataFrame:
        typed = {"period": "date", "value": "double", "reference": "double", "note": "string"}
        columns = [(F.col(given[c]).cast(t) if c in given else none[c]).alias(c) for c, t in typed.items()]
        return rows.select("scope", "id", F.lit(section).alias("section"), item.alias("item"), *columns)

    series = weeks.unpivot(["scope", "id", "period"], list(METRICS), "metric", "value")
    out = [
        part(who, "identity", F.col("name"), value="cells", note="path"),
        part(series, "series", F.col("metric"), period="period", value="value"),
        part(weeks, "series", F.lit("nc_cells"), period="period", value="nc_cells", reference="cells"),
        part(entity_evidence(star, asked, weeks), "evidence", F.col("metric"), value="current", reference="previous"),
        part(entity_findings(star, asked).join(who.select("scope", "id", F.col("cells").alias("of")), ["scope", "id"]), "finding", F.col("finding"), value="cells", reference="of"),
        part(entity_hypotheses(star, asked, rules), "hypothesis", F.col("hypothesis"), value="score", reference="cells"),
        part(entity_peers(star, asked), "peer", F.col("peer"), value="health_score"),
    ]
    if notes is not None:
        told = notes.withColumn("told", F.concat_ws(": ", "author", "note")).join(members(star, asked), "cell_id")
        out.append(part(told, "note", F.col("cell_id").cast("string"), period="at", note="told"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows
