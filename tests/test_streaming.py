from pyspark.sql import functions as F

from qoslattice.sources.workspace import Workspace
from qoslattice.streaming import windows


def test_sessions_close_after_a_gap(spark):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert sorted((r["user_id"], r["n"]) for r in windows.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_stream_ingest_merges_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"date":"2026-07-05","cell":"A1","site":"S","prb":"88"}\n{"date":"2026-07-05","cell":"A1","site":"S","prb":"1"}\n')
    ws = Workspace(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema("date string, cell string, site string, prb string").json(str(source))
    mapping = {"date": "date", "cell": "cell", "site": "site", "prb": "prb"}
    for _ in range(2):
        windows.ingest(stream, lambda b: ws.import_rows(b, mapping), str(tmp_path / "cp")).awaitTermination()
    assert [(r["prb"], r["users"]) for r in ws.table("facts").collect()] == [(88.0, None)]


def feed(spark, folder, name, rows):
    (folder / f"{name}.json").write_text("".join(f'{{"id":{i},"user_id":{u},"ts":"{t}","kind":"{k}"}}\n' for i, u, t, k in rows))


def test_streams_join_with_late_and_repeated_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    at = lambda m: f"2024-01-01 {10 + m // 60:02d}:{m % 60:02d}:00"
    batches = [
        [(1, 1, at(0), "fact"), (2, 2, at(1), "fact"), (1, 1, at(0), "fact"), (10, 1, at(5), "breach")],
        # The second user's breach comes after it; a repeated fact and a repeated breach add nothing.
        [(11, 2, at(9), "breach"), (10, 1, at(5), "breach"), (2, 2, at(1), "fact"), (3, 3, at(8), "fact")],
        # Late, but within the watermark: the fact that a breach has waited for.
        [(12, 4, at(20), "breach"), (13, 3, at(40), "breach")],
        [(4, 4, at(15), "fact"), (5, 5, at(200), "fact"), (15, 9, at(200), "breach")],
        # Beyond it: dropped.
        [(6, 5, at(10), "fact"), (14, 5, at(12), "breach")],
    ]
    schema, found = "id long, user_id long, ts timestamp, kind string", set()
    out = str(tmp_path / "out")
    for n, rows in enumerate(batches):
        feed(spark, source, f"b{n}", rows)
        events = lambda kind: windows.once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)).filter(F.col("kind") == kind), ["id"], "30 minutes")
        pairs = windows.followed(events("fact"), events("breach"), "user_id", "15 MINUTES")
        windows.to_files(pairs, out, str(tmp_path / "cp"), "append").awaitTermination()
    found = sorted((r["user_id"], r["first_id"], r["second_id"]) for r in windows.from_files(spark, out, pairs.schema).collect())
    batch = spark.read.schema(schema).json(str(source))
    side = lambda kind: windows.once(batch.filter(F.col("kind") == kind), ["id"], "")
    whole = sorted((r["user_id"], r["first_id"], r["second_id"]) for r in windows.followed(side("fact"), side("breach"), "user_id", "15 MINUTES").collect())
    assert whole == [(1, 1, 10), (2, 2, 11), (4, 4, 12), (5, 6, 14)] and found == whole[:3]


def test_updated_windows_hold_their_last_row(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "ts timestamp, event_type string, value double"
    out = str(tmp_path / "out")
    for n, hour in enumerate((10, 10, 11)):
        (source / f"b{n}.json").write_text(f'{{"ts":"2024-01-01 {hour}:00:00","event_type":"a","value":1.5}}\n')
        rows = windows.tumbling(spark.readStream.schema(schema).json(str(source)), "1 hour", "1 day")
        windows.to_files(rows, out, str(tmp_path / "cp"), "update").awaitTermination()
    got = {(str(r["window_start"]), r["n"], r["value"]) for r in windows.from_files(spark, out, rows.schema, ["window_start", "event_type"]).collect()}
    assert got == {("2024-01-01 10:00:00", 2, 3.0), ("2024-01-01 11:00:00", 1, 1.5)}
