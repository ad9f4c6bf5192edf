"""Link resolution and the concept graph: nodes, edges, backlinks, broken links, counts, subgraphs, invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions import paths
from wicker.functions.text import base36, utf16_key
from wicker.operators.parse import at, concepts, has_field, links, mappings
from wicker.sources import store


def resolve(raw_links: DataFrame, parsed: DataFrame) -> DataFrame:
    """Adds classification, target_id, query, fragment. The inventory is every document path, parsed or failed, and the folders that hold one."""
    known = parsed.where("path IS NOT NULL").select("bundle_id", F.col("path").alias("resolved"), F.when(F.col("reserved").isNull(), "concept").otherwise(F.col("reserved")).alias("what"))
    folders = parsed.where("path IS NOT NULL").select("bundle_id", F.explode(paths.directories_of(F.col("path"))).alias("resolved")).distinct().withColumn("what", F.lit("folder"))
    places = known.unionByName(folders).groupBy("bundle_id", "resolved").agg(F.max(F.when(F.col("what") == "folder", 1).otherwise(0)).alias("is_folder"), F.max(F.when(F.col("what") != "folder", F.col("what"))).alias("what"))
    said = raw_links.withColumn("t", paths.target_parts(F.col("raw_target"), F.col("path"))).select(*raw_links.columns, "t.*")
    joined = said.join(places, ["bundle_id", "resolved"], "left")
    kind = (
        F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("is_folder") == 1, "directory").when(F.col("what") == "concept", "internal").when(F.col("what") == "index", "directory")
        .when(F.col("what") == "log", "invalid").when(F.col("resolved").endswith(".md") | F.col("ends_with_slash"), "broken").otherwise("invalid")
    )
    return joined.withColumn("classification", kind).select(*raw_links.columns, "classification", F.when(kind == "internal", paths.concept_id(F.col("resolved"))).alias("target_id"), "query", "fragment")


def dense_position(df: DataFrame, within: list[str], order: list[Column]) -> tuple[DataFrame, str]:
    """df with position: 0, 1, ... in order in each `within`; and where the rows lie, written in ranges of their order. A row's number is its place in its range after the counts of the ranges before, so no task holds all rows of a bundle, and what is summed is one row a range."""
    ordered = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    placed, path = store.written(ordered.select(*df.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    sizes = placed.groupBy(*within, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*within, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, [*within, "_range"]).withColumn("position", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift"), path


def internal(resolved: DataFrame) -> DataFrame:
    """bundle_id, source, target, nth, range: one per internal link occurrence; edges without their numbers."""
    return resolved.where("classification = 'internal'").select("bundle_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "nth", "range")


def numbered_edges(resolved: DataFrame) -> tuple[DataFrame, str]:
    """edges, and where the rows they are read from lie."""
    placed, path = dense_position(internal(resolved), ["bundle_id"], [utf16_key(F.col("source")), F.col("nth"), utf16_key(F.col("target"))])
    return placed.select("bundle_id", F.concat(F.lit("edge:"), base36(F.col("position"))).alias("edge_id"), "source", "target", "nth", "range"), path


def edges(resolved: DataFrame) -> DataFrame:
    """bundle_id, edge_id, source, target, nth, range: one per internal link occurrence, in order of source, place, target."""
    return numbered_edges(resolved)[0]


def broken_links(resolved: DataFrame) -> DataFrame:
    return resolved.where("classification = 'broken'").select("bundle_id", "source_id", "label", "raw_target", "nth", "range")


def connected(internal: DataFrame) -> DataFrame:
    return internal.select("bundle_id", F.col("source").alias("id")).unionByName(internal.select("bundle_id", F.col("target").alias("id"))).distinct()


def backlinks(internal: DataFrame) -> DataFrame:
    """bundle_id, target, source: distinct pairs; a list per target is left to the reader, as a hub may have any number."""
    return internal.select("bundle_id", "target", "source").distinct()


def nodes(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per concept with defaults. Failed sources keep their id only and count as no orphan."""
    internal = resolved.where("classification = 'internal'").select("bundle_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    broken = resolved.where("classification = 'broken'").groupBy("bundle_id", F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("broken_link_count"))
    joined = concepts(parsed).join(connected(internal).withColumn("linked", F.lit(True)), ["bundle_id", "id"], "left").join(broken, ["bundle_id", "id"], "left")
    failed, own = F.col("failure").isNotNull(), lambda c: F.when(F.col("failure").isNull(), c)
    return joined.select(
        "bundle_id", "id", "uri", failed.alias("source_failed"), F.when(failed, "").otherwise(F.coalesce("type", F.lit(""))).alias("type"), own(F.col("title")).alias("title"), own(F.col("description")).alias("description"), own(F.col("resource")).alias("resource"),
        F.when(failed, F.array().cast("array<string>")).otherwise(F.col("tags")).alias("tags"), own(F.when(~has_field("generated"), F.col("timestamp"))).alias("timestamp"), own(F.col("generated_by")).alias("generated_by"), own(F.col("trust_tier")).alias("trust_tier"),
        own(F.coalesce("status", F.when(~has_field("status"), "stable"))).alias("status"), own(F.col("stale_after")).alias("stale_after"), (~failed & F.col("linked").isNull()).alias("orphan"), F.coalesce("broken_link_count", F.lit(0)).alias("broken_link_count"),
        F.coalesce(at("/type")["range"], F.col("front_range")).alias("place"),
        own(F.col("generated_at")).alias("generated_at"), own(F.col("runtime")).alias("runtime"), own(F.col("computation")).alias("computation"), own(F.when(at("/sources")["kind"] == "seq", F.size(F.filter(mappings("sources"), lambda m: m.isNotNull()))).otherwise(0)).alias("source_count"),
    )


def names(parsed: DataFrame) -> DataFrame:
    """bundle_id, id, title of the rows of nodes(), for which links are not needed."""
    return concepts(parsed).select("bundle_id", "id", F.when(F.col("failure").isNull(), F.col("title")).alias("title"))


def statistics(node_rows: DataFrame, edge_rows: DataFrame, broken: DataFrame) -> DataFrame:
    """bundle_id, concept_count, edge_count, orphan_count, broken_link_count."""
    per_edge = edge_rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("edge_count"))
    per_broken = broken.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("broken_count"))
    per_node = node_rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("concept_count"), F.count_if("orphan").alias("orphan_count"))
    joined = per_node.join(per_edge, "bundle_id", "left").join(per_broken, "bundle_id", "left")
    return joined.select("bundle_id", "concept_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "orphan_count", F.coalesce("broken_count", F.lit(0)).alias("broken_link_count"))


def type_counts(node_rows: DataFrame) -> DataFrame:
    return node_rows.where("NOT source_failed").groupBy("bundle_id", "type").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(node_rows: DataFrame) -> DataFrame:
    return node_rows.where("NOT source_failed").select("bundle_id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("bundle_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def induced(edge_rows: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges with both ends among visible (bundle_id, id)."""
    ends = visible.select("bundle_id", "id").distinct()
    first = edge_rows.join(ends.withColumnRenamed("id", "source"), ["bundle_id", "source"], "left_semi")
    return first.join(ends.withColumnRenamed("id", "target"), ["bundle_id", "target"], "left_semi")


def invariants(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Counts of what a sound graph has none of: repeated_ids, dangling_edges, wrong_orphans, repeated_edge_ids."""
    ids = node_rows.groupBy("bundle_id", "id").count()
    dangling = connected(edge_rows).join(node_rows.select("bundle_id", "id"), ["bundle_id", "id"], "left_anti")
    wrong = node_rows.where("orphan").join(connected(edge_rows), ["bundle_id", "id"], "left_semi")
    again = edge_rows.groupBy("bundle_id", "edge_id").count().where("count > 1")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(ids.where("count > 1"), "repeated_ids").crossJoin(one(dangling, "dangling_edges")).crossJoin(one(wrong, "wrong_orphans")).crossJoin(one(again, "repeated_edge_ids"))


def all_links(parsed: DataFrame) -> DataFrame:
    return resolve(links(parsed), parsed)


def message_faults(node_rows: DataFrame, edge_rows: DataFrame, back: DataFrame, stated: DataFrame) -> DataFrame:
    """bundle_id, fault, n: what in a graph as it was received disagrees with itself; a sound graph has no rows.

    back is (bundle_id, target, source); stated (bundle_id, concept_count, edge_count, orphan_count, broken_link_count).
    Edge numbers must be 0, 1, ... in base 36, ends must be nodes, and backlinks, orphans and counts must be what edges
    and nodes give.
    """
    faults = lambda rows, name: rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n")).select("bundle_id", F.lit(name).alias("fault"), "n")
    ids = node_rows.select("bundle_id", "id")
    number = F.conv(F.regexp_extract("edge_id", "^edge:([0-9a-z]+)$", 1), 36, 10).try_cast("long")
    numbered = edge_rows.withColumn("_k", number)
    total = edge_rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("_n"))
    canonical = F.col("edge_id") == F.concat(F.lit("edge:"), base36(F.col("_k")))
    outside = numbered.join(total, "bundle_id").where(F.col("_k").isNull() | (F.col("_k") >= F.col("_n")) | ~canonical)
    pairs = edge_rows.select("bundle_id", "target", "source").distinct()
    said = back.select("bundle_id", "target", "source")
    counted = node_rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("_nodes"), F.count_if("orphan").alias("_orphans"), F.sum("broken_link_count").alias("_broken")).join(total, "bundle_id", "left")
    wrong = stated.join(counted, "bundle_id", "left").where(
        (F.col("concept_count") != F.coalesce("_nodes", F.lit(0))) | (F.col("edge_count") != F.coalesce("_n", F.lit(0))) | (F.col("orphan_count") != F.coalesce("_orphans", F.lit(0))) | (F.col("broken_link_count") != F.coalesce("_broken", F.lit(0)))
    )
    orphaned = node_rows.where("NOT source_failed").join(connected(edge_rows).withColumn("_linked", F.lit(True)), ["bundle_id", "id"], "left").where(F.col("orphan") == F.coalesce("_linked", F.lit(False)))
    parts = [
        faults(ids.groupBy("bundle_id", "id").count().where("count > 1"), "repeated-id"), faults(edge_rows.groupBy("bundle_id", "edge_id").count().where("count > 1"), "repeated-edge"), faults(outside, "edge-number"),
        faults(connected(edge_rows).join(ids, ["bundle_id", "id"], "left_anti"), "dangling-end"), faults(pairs.exceptAll(said), "backlink-missing"), faults(said.exceptAll(pairs), "backlink-unfounded"),
        faults(orphaned, "orphan-mark"), faults(node_rows.where("source_failed AND (orphan OR broken_link_count > 0 OR type <> '' OR size(tags) > 0)"), "failed-source"), faults(wrong, "counts"),
    ]
    return reduce(DataFrame.unionByName, parts)
