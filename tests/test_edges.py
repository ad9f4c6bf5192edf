from pyspark.sql import functions as F

from wicker import catalog
from wicker.functions.text import utf16_key
from wicker.operators import graph


def test_positions_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(f"b{k % 2}", ("\U0001f600" if k % 5 == 0 else "�" if k % 5 == 1 else "") + f"same/long/prefix/of/all/sources/{k * 7919 % 1000}", k) for k in range(3000)]
        df = spark.createDataFrame(rows, "bundle_id string, source string, nth int")
        placed, _ = graph.dense_position(df, ["bundle_id"], [utf16_key(F.col("source")), F.col("nth")])
        assert placed.select("position").distinct().count() == 1500
        found = {(r.bundle_id, r.source, r.nth): r.position for r in placed.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for b in ("b0", "b1"):
        inside = sorted((r for r in rows if r[0] == b), key=lambda r: (r[1].encode("utf-16-be"), r[2]))
        assert [found[r] for r in inside] == list(range(1500))


def test_no_window_over_rows_of_a_bundle(spark, sf_dir):
    """Only the ranges' counts are summed in order."""
    resolved = spark.createDataFrame([("b", f"s{k}", "internal", "t", k, None) for k in range(50)], "bundle_id string, source_id string, classification string, target_id string, nth int, range struct<start:int>")
    plan = graph.edges(resolved)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.index("Aggregate [") > plan.index("Window [")


def test_invariants_are_of_the_whole_concept_graph(spark, sf_dir):
    lines, orders, customers, suppliers, nations = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders", "customer", "supplier", "nation"))
    edges = lines.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey")).count() + sum(t.count() for t in (orders, customers, suppliers, nations))
    found = catalog.queries()["graph_invariants"](spark, sf_dir).first()
    # Of 36 numbers in a row, the last is written as the one before.
    assert found.repeated_edge_ids == edges // 36
    assert min(found.repeated_ids, found.dangling_edges, found.wrong_orphans) > 0
