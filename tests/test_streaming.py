import datetime

from pyspark.sql import functions as F

from wicker.streaming import changes as stream

T0 = datetime.datetime(2026, 7, 22, 12, 0, 0)


def changes(spark, rows):
    return spark.createDataFrame([(b, T0 + datetime.timedelta(milliseconds=ms), k, u, None) for b, ms, k, u in rows], stream.CHANGES)


def test_churn_is_capped(spark):
    df = changes(spark, [("b", ms, "change", f"{ms}.md") for ms in range(0, 1201, 200)])
    got = stream.capped_batches(df).groupBy("batch_start").count().orderBy("batch_start").collect()
    assert [r["count"] for r in got] == [5, 2] and stream.sessions(df).count() == 1


def test_capped_batches_match_a_plain_walk(spark):
    import random

    rng = random.Random(4)
    rows = sorted((b, ms, "change", f"{ms}.md") for b in "abc" for ms in rng.sample(range(20_000), 90))
    expected, bundle, first, last = {}, None, 0, 0
    for b, ms, _, _ in rows:
        if b != bundle or ms - last >= 250 or ms - first >= 1000:
            bundle, first = b, ms
        last = ms
        expected[b, ms] = first
    base = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    for kind in ("timestamp", "timestamp_ntz"):
        df = changes(spark, rows).withColumn("ts", F.col("ts").cast(kind))
        got = stream.capped_batches(df).select("bundle_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "batch_start").collect()
        assert {(r["bundle_id"], r["ms"] - base): r["batch_start"] - base for r in got} == expected


def test_overflow_becomes_a_rescan(spark):
    for n, rescan in ((512, False), (513, True)):
        df = stream.capped_batches(changes(spark, [("b", 0, "change", f"{k}.md") for k in range(n)] * 2))
        r = stream.coalesced(df, "bundle_id", "batch_start").first()
        assert (r["rescan"], r["changes"], r["paths"]) == (rescan, 1 if rescan else n, n)


def test_stale_messages_are_dropped(spark):
    df = spark.createDataFrame([("b", k, r) for k, r in enumerate([1, 3, 2, 3, 4])], "bundle_id string, nth int, revision int")
    assert [r["revision"] for r in stream.newest(df, "bundle_id", "nth").orderBy("nth").collect()] == [1, 3, 3, 4]


def test_stream_matches_batch(spark, tmp_path):
    rows = [("b", ms, "change", u) for ms, u in ((0, "x"), (100, "x"), (200, "y"), (900, "z"))] + [("c", 0, "rescan", "q"), ("b", 600_000, "change", "late")]
    source = tmp_path / "in"
    batch = changes(spark, rows)
    batch.coalesce(1).write.parquet(str(source))
    query = stream.coalesce_stream(spark.readStream.schema(batch.schema).parquet(str(source))).writeStream.format("memory").queryName("refreshes").outputMode("append").start()
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    got = {(r["bundle_id"], r["start"]): (r["rescan"], len(r["changes"])) for r in spark.table("refreshes").collect()}
    at = lambda ms: T0 + datetime.timedelta(milliseconds=ms)
    assert got == {("b", at(0)): (False, 2), ("b", at(900)): (False, 1), ("c", at(0)): (True, 0)}


def test_capped_stream_matches_batches(spark, tmp_path):
    rows = [("b", ms, "change", f"{ms % 3}.md") for ms in range(0, 2600, 200)] + [("b", 9000, "change", "x"), ("c", 0, "change", "y"), ("c", 100, "context", "y"), ("c", 150, "change", "z"), ("b", 600_000, "change", "late"), ("c", 600_000, "change", "late")]
    df = changes(spark, rows)
    plain = stream.coalesced(stream.capped_batches(df.where("bundle_id = 'b'")), "bundle_id", "batch_start")
    expected = {(r["batch_start"], r["changes"], r["paths"], r["rescan"]) for r in plain.collect()}
    df.where("ts < timestamp'2026-07-22 12:05:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.capped_stream(source).writeStream.format("memory").queryName("capped").outputMode("append").start()
    query.processAllAvailable()
    df.where("ts > timestamp'2026-07-22 12:05:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.processAllAvailable()
    query.stop()
    got = [tuple(r) for r in spark.table("capped").collect()]
    late = max(e[0] for e in expected)
    assert {g[1:] for g in got if g[0] == "b"} == {e for e in expected if e[0] != late} and len(expected) == 5
    assert sorted(g[2:] for g in got if g[0] == "c") == [(1, 1, False), (1, 2, True)]


def test_publish_clears_views_of_failed_roots(spark, tmp_path):
    df = changes(spark, [("b", 0, "change", "x"), ("c", 0, "change", "z")])
    df.write.parquet(str(tmp_path / "in"))
    seen = {}
    views = {"ids": lambda touched, k: touched.withColumn("id", F.concat("bundle_id", F.lit("/1")))}
    write = lambda name, rows, k: seen.update({(name, k): sorted(r["id"] for r in rows.collect())})
    query = stream.publish(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), views, write, str(tmp_path / "cp"), lambda touched: touched.where("bundle_id = 'c'"))
    query.processAllAvailable()
    query.stop()
    assert seen == {("ids", 0): ["b/1"]}


def test_refresh_runs_per_batch(spark, tmp_path):
    df = changes(spark, [("b", 0, "change", "x"), ("b", 1, "change", "y"), ("c", 0, "change", "z")])
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    query = stream.refresh(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda touched, k: seen.append(sorted(r["bundle_id"] for r in touched.select(F.col("bundle_id")).collect())), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert seen == [["b", "c"]]
