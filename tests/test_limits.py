"""Budgets of bundles and of documents, and accepted deliveries in batch and stream."""

import random

from pyspark.sql import functions as F

from wicker.operators import graph, limits, parse, rules
from wicker.streaming import changes


def test_budgets_cut_at_the_first_row_that_does_not_fit(spark):
    rng = random.Random(5)
    rows = [(b, f"{k:03}.md", rng.choice([None, 3, 5, -4]), rng.randrange(4)) for b in ("m", "n", None) for k in range(60)] + [("z", "a.md", 1, 1)]
    df = spark.createDataFrame(rows, "bundle_id string, path string, a int, b int")
    budgets = [limits.Budget("a", F.col("a"), 40), limits.Budget("b", F.col("b"), 50)]
    want = {}
    for bundle in ("m", "n", None, "z"):
        a = b = 0
        over = False
        for _, path, x, y in sorted((r for r in rows if r[0] == bundle), key=lambda r: r[1]):
            a, b = a + (x or 0), b + y
            broken = None if over else "a" if a > 40 else "b" if b > 50 else None
            want[bundle, path] = ("skipped" if over else "over" if broken else "kept", broken, a, b)
            over = over or broken is not None
    got = {(r["bundle_id"], r["path"]): (r["state"], r["budget"], *r["spent"]) for r in limits.spent(df, budgets).collect()}
    assert got == want and {v[0] for v in want.values()} == {"kept", "over", "skipped"}
    assert limits.spent(df.limit(0), budgets).count() == 0


def test_documents_beyond_a_budget_fail_and_keep_their_names(spark):
    text = "---\ntype: note\ntags: [a, b]\n---\n[x](b.md) [y](c.md)\n"
    rows = [(b, f"mem://{b}/{p}", p, text.encode()) for b in ("one", "two") for p in ("a.md", "b.md", "c.md", "d.md")[: 4 if b == "one" else 2]]
    parsed = parse.parse(spark.createDataFrame(rows, "bundle_id string, uri string, bundle_path string, content binary"))
    cut = limits.limited(parsed, limits.parser_budgets(links=4))
    got = {(r["bundle_id"], r["path"]): (r["failure"], r["scope"], len(r["marks"])) for r in cut.collect()}
    assert got == {("one", "a.md"): (None, None, 2), ("one", "b.md"): (None, None, 2), ("one", "c.md"): ("resource-limit", "bundle", 0), ("one", "d.md"): ("resource-limit", "document", 0), ("two", "a.md"): (None, None, 2), ("two", "b.md"): (None, None, 2)}
    assert {(r["uri"], r["code"]) for r in rules.failed_documents(cut).collect()} == {(f"mem://one/{p}.md", "okf.conformance.resource-limit") for p in "cd"}
    assert graph.all_links(cut).where("bundle_id = 'one' AND classification = 'internal'").count() == 4
    assert cut.columns == [*parsed.columns, "scope"]


def test_documents_beyond_their_own_limits(spark):
    texts = {"big.md": "---\ntype: x\n---\n" + "word " * 70_000, "signs.md": "---\ntype: x\n---\n" + "*" * 20_001, "front.md": "---\nnote: " + "n" * 66_000 + "\n---\n", "fine.md": "---\ntype: x\n---\n" + "word\n" * 19_000}
    parsed = parse.parse(spark.createDataFrame([("b", p, p, t.encode()) for p, t in texts.items()], "bundle_id string, uri string, bundle_path string, content binary"))
    assert {r["path"]: r["failure"] for r in parsed.collect()} == {"big.md": "resource-limit", "signs.md": "resource-limit", "front.md": "resource-limit", "fine.md": None}


def test_deliveries_of_one_revision(spark, tmp_path):
    rows = [("u", 1, 5, 1), ("u", 2, 5, 1), ("u", 3, 5, 3), ("u", 4, 5, 2), ("u", 5, 4, 9), ("u", 6, 6, 1), ("v", 1, 0, 1), ("v", 2, 0, 2)]
    schema = "key string, at int, revision bigint, delivery_id bigint"
    want = {("u", 1), ("u", 3), ("u", 6), ("v", 1), ("v", 2)}
    assert {(r["key"], r["at"]) for r in changes.newest(spark.createDataFrame(rows, schema), "key", "at").collect()} == want
    for n, part in enumerate((rows[:3] + rows[6:7], rows[3:6] + rows[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        run = changes.newest_stream(source, "key", "at").writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
    finally:
        spark.conf.set(provider, before)
    assert {(r["key"], r["at"]) for r in spark.table("accepted").collect()} == want
