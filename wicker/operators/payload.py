"""A bundle's graph as one JSON message: what its parts look like, and how many octets the whole has, without putting it together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.text import json_quote

#: Fixed value: the most octets that one message may have.
MOST_BYTES = 16 << 20


def source_range(c: Column) -> Column:
    point = lambda at, line, character: F.struct(c[at].alias("offset"), c[line].alias("line"), c[character].alias("character"))
    return F.struct(point("start", "line", "character").alias("start"), point("end", "end_line", "end_character").alias("end"))


def node_json(nodes: DataFrame) -> Column:
    """A node's JSON; a failed source has its id, empty fields and a mark."""
    keys = {"generatedBy": "generated_by", "generatedAt": "generated_at", "trustTier": "trust_tier", "status": "status", "staleAfter": "stale_after", "sourceCount": "source_count", "runtime": "runtime", "computation": "computation"}
    failed = F.struct("id", F.lit(True).alias("sourceFailed"), F.lit("").alias("type"), F.array().cast("array<string>").alias("tags"), F.lit(False).alias("orphan"), F.lit(0).alias("brokenLinkCount"))
    whole = F.struct("id", "type", "title", "description", "resource", "tags", "timestamp", *[F.col(c).alias(n) for n, c in keys.items()], "orphan", F.col("broken_link_count").alias("brokenLinkCount"))
    return F.when(F.col("source_failed"), F.to_json(failed)).otherwise(F.to_json(whole))


def edge_json() -> Column:
    return F.to_json(F.struct(F.col("edge_id").alias("id"), "source", "target", source_range(F.col("range")).alias("sourceRange")))


def broken_json() -> Column:
    return F.to_json(F.struct(F.col("source_id").alias("sourceId"), "label", F.col("raw_target").alias("rawTarget"), source_range(F.col("range")).alias("sourceRange")))


def sizes(nodes: DataFrame, edges: DataFrame, broken: DataFrame, revision: int) -> DataFrame:
    """bundle_id, octets of the message {protocolVersion, revision, nodes, edges, backlinks, brokenLinks, statistics}: sums over its parts, commas between them, and the fixed text around them.

    Each part is measured as JSON by itself; no list of a bundle is ever gathered.
    """
    octets = lambda c: F.octet_length(c).cast("long")
    digits = lambda c: F.length(c.cast("string")).cast("long")
    zero = F.lit(0).cast("long")

    def part(rows: DataFrame, size: Column, **more: Column) -> DataFrame:
        """Sum and number of pieces; each is followed by a comma but the last."""
        return rows.groupBy("bundle_id").agg((F.sum(size + 1) - 1).alias("size"), F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in more.items()])

    names = ("size", "concepts", "edges", "orphans", "broken")
    row = lambda df, **given: df.select("bundle_id", *[given.get(n, zero).alias(n) for n in names])
    node_part = part(nodes, octets(node_json(nodes)), orphans=F.count_if("orphan"))
    edge_part, broken_part = part(edges, octets(edge_json())), part(broken, octets(broken_json()))
    # A node's entry of backlinks is "id":[...]; its sources are different strings with commas between.
    entries = part(nodes, octets(json_quote(F.col("id"))) + 3)
    sources = edges.select("bundle_id", "target", "source").distinct().groupBy("bundle_id", "target").agg((F.sum(octets(json_quote(F.col("source"))) + 1) - 1).alias("s")).groupBy("bundle_id").agg(F.sum("s").alias("size"))
    sound = nodes.where("NOT source_failed")
    counted = lambda df, key: part(df.groupBy("bundle_id", key).agg(F.count(F.lit(1)).alias("c")), octets(json_quote(F.col(key))) + 1 + digits(F.col("c")))
    types = counted(sound, "type")
    tags = counted(sound.select("bundle_id", F.explode(F.array_distinct("tags")).alias("tag")), "tag")
    parts = [
        row(node_part, size=F.col("size"), concepts=F.col("n"), orphans=F.col("orphans")), row(edge_part, size=F.col("size"), edges=F.col("n")), row(broken_part, size=F.col("size"), broken=F.col("n")),
        *[row(p, size=F.col("size")) for p in (entries, sources, types, tags)],
    ]
    total = reduce(DataFrame.unionByName, parts).groupBy("bundle_id").agg(*[F.sum(n).alias(n) for n in names])
    around = '{"protocolVersion":1,"revision":,"nodes":[],"edges":[],"backlinks":{},"brokenLinks":[],"statistics":{"conceptCount":,"edgeCount":,"orphanCount":,"brokenLinkCount":,"typeCounts":{},"tagCounts":{}}}'
    fixed = len(around) + len(str(revision))
    return total.select("bundle_id", (F.lit(fixed) + F.col("size") + reduce(lambda a, b: a + b, [digits(F.col(n)) for n in names[1:]])).alias("octets"))
