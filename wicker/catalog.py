"""The library's queries over the driver's tables, and the SQL that recomputes each from those tables directly.

The SQL never sees the documents: it states what rendering, parsing and resolving them must give back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.functions import paths, text
from wicker.functions.dates import explicit_zone_epoch, is_iso_date
from wicker.operators import graph, limits, parse, payload, query, reports, rules
from wicker.plans import indexes, migration, templates
from wicker.sources import guarded, store, tables
from wicker.streaming import changes as stream

#: The reference time of all rules: 2026-07-22T12:00:00Z.
NOW, TODAY = 1784721600, "2026-07-22"
Query = Callable[[SparkSession, str], DataFrame]


_HELD: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}


def _held(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Parsed documents, resolved links, nodes and edges are written once per input, as tables in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _HELD:
        _HELD[key] = store.written(make())
    return _HELD[key][0]


def release() -> None:
    """Delete what queries keep; needed when a table's files change under its path."""
    for df, path in _HELD.values():
        if df.sparkSession.sparkContext._jsc is not None:
            store.delete(df.sparkSession, path)
    _HELD.clear()


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "parsed", lambda: parse.parse(tables.documents(spark, sf_dir)))


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parse.outline keeps of the documents, from the parsed ones where these are written already."""
    if (spark.sparkContext.applicationId, sf_dir, "parsed") in _HELD:
        return _parsed(spark, sf_dir)
    return _held(spark, sf_dir, "outline", lambda: parse.outline(tables.documents(spark, sf_dir)))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    return _held(spark, sf_dir, "links", lambda: graph.all_links(parsed))


def _internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges for queries that do not give their numbers."""
    return graph.internal(_links(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, resolved = _parsed(spark, sf_dir), _links(spark, sf_dir)
    return _held(spark, sf_dir, "nodes", lambda: graph.nodes(parsed, resolved))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "edges")
    if key not in _HELD:
        _HELD[key] = graph.numbered_edges(_links(spark, sf_dir))
    return _HELD[key][0]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        parsed, resolved, nodes = _parsed(spark, sf_dir), _links(spark, sf_dir), _nodes(spark, sf_dir)
        return rules.all_findings(parsed, resolved, nodes, NOW, TODAY)

    return _held(spark, sf_dir, "findings", make)


def prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all that the queries keep."""
    _edges(spark, sf_dir)
    return _findings(spark, sf_dir)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "nations", lambda: parse.parse(tables.nation_bundles(spark, sf_dir)))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir, "notes", lambda: parse.parse(tables.notes(spark, sf_dir)))


FACTS = r"""
WITH lines AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nth, l_partkey FROM lineitem
), sizes AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1
), c AS (
  SELECT 'region/' || r_name AS id, 'region' AS type, r_name AS title, 'A region of the world.' AS description, NULL::VARCHAR AS resource, ['geo'] AS tags, NULL::VARCHAR AS status, NULL::VARCHAR AS generated_by, NULL::VARCHAR AS verified_by, NULL::VARCHAR AS stale_after, NULL::VARCHAR AS stamp FROM region
  UNION ALL SELECT 'nation/' || n_name, 'nation', n_name, NULL, NULL, ['geo'], NULL, NULL, NULL, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier/' || s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN 'supplier' ELSE '' END, s_name, NULL, NULL, [], CASE WHEN s_suppkey % 5 = 0 THEN 'retired' WHEN s_suppkey % 3 = 0 THEN 'draft' END, CASE WHEN s_suppkey % 4 = 0 THEN 'process:loader' END, NULL, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer/' || c_mktsegment || '/' || c_custkey, 'customer', CASE WHEN c_custkey % 61 = 0 THEN '' ELSE c_name END, NULL, NULL, [c_mktsegment], NULL, NULL, CASE WHEN c_custkey % 10 IN (0, 3) THEN 'human:ann' WHEN c_custkey % 10 = 5 THEN 'process:check' WHEN c_custkey % 10 = 7 THEN 'invalid' END, CASE WHEN c_custkey % 13 = 0 THEN '2026-01-31' WHEN c_custkey % 17 = 0 THEN '2026-02-31' END, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part/' || p_partkey, p_type, p_name, 'Part of brand ' || p_brand, 'urn:brand:' || p_brand, [p_brand, 'size-' || p_size], NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'order/' || o_orderpriority || '/' || o_orderkey, 'order', 'Order ' || o_orderkey, NULL, NULL, [o_orderstatus], NULL, NULL, NULL, NULL, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' FROM orders JOIN customer ON o_custkey = c_custkey
), defects AS (
  SELECT * FROM (VALUES (97, 0, './missing.md', 'broken'), (89, 1, '../../../outside.md', 'out-of-bundle'), (83, 2, 'https://example.com/a?b#c', 'external'), (79, 3, '#frag', 'fragment'), (73, 4, '../', 'directory'), (71, 5, './%zz.md', 'invalid')) d(modulus, k, target, class)
), o AS (
  SELECT 'order/' || o_orderpriority || '/' || o_orderkey AS id, o_orderkey, c_custkey, c_mktsegment, coalesce(n, 0) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN sizes ON l_orderkey = o_orderkey
), l AS (
  SELECT 'nation/' || n_name AS source, 0::BIGINT AS nth, '../region/' || replace(r_name, ' ', '%20') || '.md#top' AS raw_target, 'internal' AS class, 'region/' || r_name AS target, 'region' AS label FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier/' || s_suppkey, 0, '/nation/' || replace(n_name, ' ', '%20') || '.md', 'internal', 'nation/' || n_name, 'nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer/' || c_mktsegment || '/' || c_custkey, 0, '../../nation/' || replace(n_name, ' ', '%20') || '.md', 'internal', 'nation/' || n_name, 'home nation' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT id, 0, '/customer/' || replace(c_mktsegment, ' ', '%20') || '/' || c_custkey || '.md?from=order', 'internal', 'customer/' || c_mktsegment || '/' || c_custkey, 'customer' FROM o
  UNION ALL SELECT id, nth, '/part/' || l_partkey || '.md', 'internal', 'part/' || l_partkey, 'part' FROM o JOIN lines ON l_orderkey = o_orderkey
  UNION ALL SELECT id, n + row_number() OVER (PARTITION BY id ORDER BY k), target, class, NULL, 'odd' FROM o JOIN defects ON o_orderkey % modulus = 0
), e AS (SELECT source, target, nth FROM l WHERE class = 'internal'
), node AS (
  SELECT c.*, c.id NOT IN (SELECT source FROM e UNION SELECT target FROM e) AS orphan, coalesce(b.n, 0) AS broken FROM c LEFT JOIN (SELECT source, count(*) AS n FROM l WHERE class = 'broken' GROUP BY 1) b ON b.source = c.id
), f AS (
  SELECT 'okf.conformance.concept-type' AS code, 'conformance' AS category, 'error' AS severity, id, '' AS subject FROM c WHERE type = ''
  UNION ALL SELECT 'okf.curation.' || class || '-link', 'curation', 'warning', source, raw_target FROM l WHERE class IN ('broken', 'invalid', 'out-of-bundle')
  UNION ALL SELECT 'okf.curation.orphan-concept', 'curation', 'warning', id, '' FROM node WHERE orphan
  UNION ALL SELECT 'okf.curation.missing-title', 'curation', 'warning', id, '' FROM c WHERE coalesce(trim(title), '') = ''
  UNION ALL SELECT 'okf.curation.missing-description', 'curation', 'warning', id, '' FROM c WHERE description IS NULL
  UNION ALL SELECT 'okf.curation.future-timestamp', 'curation', 'warning', id, '' FROM c WHERE stamp > '2026-07-22T12:05:00Z'
  UNION ALL SELECT 'okf.curation.invalid-status', 'curation', 'warning', id, '' FROM c WHERE status NOT IN ('draft', 'stable', 'deprecated')
  UNION ALL SELECT 'okf.curation.invalid-verified', 'curation', 'warning', id, '' FROM c WHERE verified_by = 'invalid'
  UNION ALL SELECT CASE stale_after WHEN '2026-02-31' THEN 'okf.curation.invalid-stale-after' ELSE 'okf.curation.stale-concept' END, 'curation', 'warning', id, stale_after FROM c WHERE stale_after IS NOT NULL
  UNION ALL SELECT 'okf.curation.duplicate-resource', 'curation', 'warning', id, subject FROM dup
), dup AS (
  SELECT c.id, array_to_string(list_filter(r.first, lambda x: x <> c.id)[1:8], ', ') || CASE WHEN r.n - 1 > 8 THEN ', and ' || (r.n - 9) || ' more' ELSE '' END AS subject
  FROM c JOIN (SELECT resource, count(*) AS n, list(id ORDER BY id)[1:9] AS first FROM c WHERE resource IS NOT NULL GROUP BY 1 HAVING count(*) > 1) r ON c.resource = r.resource
)
"""


def _with(tail: str) -> str:
    """FACTS with the findings after what they read, then the query's own part."""
    head, dup = FACTS.split("), dup AS (")
    body, findings = head.split("), f AS (")
    return f"{body}), dup AS ({dup.rstrip().removesuffix(')')}), f AS ({findings})\n{tail}"


REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None, facts: bool = True):
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql and (_with(sql) if facts else sql))
        return fn

    return add


@register("graph_statistics", "SELECT count(*) AS concept_count, (SELECT count(*) FROM e) AS edge_count, count(*) FILTER (WHERE orphan) AS orphan_count, (SELECT count(*) FROM l WHERE class = 'broken') AS broken_link_count FROM node")
def graph_statistics(spark, sf_dir):
    resolved, nodes = _links(spark, sf_dir), _nodes(spark, sf_dir)
    return graph.statistics(nodes, _internal(spark, sf_dir), graph.broken_links(resolved)).drop("bundle_id")


@register("type_counts", "SELECT type, count(*) AS n FROM c GROUP BY 1")
def type_counts(spark, sf_dir):
    return graph.type_counts(_nodes(spark, sf_dir)).drop("bundle_id")


@register("tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS tag FROM c) GROUP BY 1")
def tag_counts(spark, sf_dir):
    return graph.tag_counts(_nodes(spark, sf_dir)).drop("bundle_id")


@register("link_classification", "SELECT source AS source_id, nth, label, raw_target, class AS classification, target AS target_id FROM l")
def link_classification(spark, sf_dir):
    return _links(spark, sf_dir).select("source_id", F.col("nth").cast("long").alias("nth"), "label", "raw_target", "classification", "target_id")


@register("link_class_counts", "SELECT class AS classification, count(*) AS n FROM l GROUP BY 1")
def link_class_counts(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@register("target_components", "SELECT source AS source_id, nth, raw_target, CASE WHEN class = 'external' THEN 'b' WHEN contains(raw_target, '?') THEN 'from=order' END AS query, CASE WHEN contains(raw_target, '#') THEN split_part(raw_target, '#', 2) END AS fragment FROM l WHERE contains(raw_target, '?') OR contains(raw_target, '#')")
def target_components(spark, sf_dir):
    return _links(spark, sf_dir).where("query IS NOT NULL OR fragment IS NOT NULL").select("source_id", F.col("nth").cast("long").alias("nth"), "raw_target", "query", "fragment")


@register("graph_edges", "SELECT 'edge:' || lower(to_base(row_number() OVER (ORDER BY source, nth) - 1, 36)) AS edge_id, source, target FROM e")
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select("edge_id", "source", "target")


@register("backlinks", "SELECT DISTINCT target, source FROM e")
def backlinks(spark, sf_dir):
    return graph.backlinks(_internal(spark, sf_dir)).drop("bundle_id")


@register("broken_links", "SELECT source AS source_id, label, raw_target FROM l WHERE class = 'broken'")
def broken_links(spark, sf_dir):
    return graph.broken_links(_links(spark, sf_dir)).select("source_id", "label", "raw_target")


@register("orphans", "SELECT 'nation-' || n_nationkey AS bundle_id, s_suppkey::VARCHAR AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'nation-' || n_nationkey, 'hub' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0)", facts=False)
def orphans(spark, sf_dir):
    parsed = _nations(spark, sf_dir)
    return graph.nodes(parsed, graph.all_links(parsed)).where("orphan").select("bundle_id", "id")


@register("graph_nodes", "SELECT id, type, title, description, resource, array_to_string(tags, '|') AS tags, CASE WHEN generated_by IS NULL THEN stamp END AS timestamp, generated_by, CASE WHEN verified_by LIKE 'human:%' THEN 'human-reviewed' WHEN verified_by LIKE 'process:%' THEN 'machine-confirmed' ELSE 'unverified' END AS trust_tier, coalesce(status, 'stable') AS status, stale_after, orphan, broken AS broken_link_count FROM node")
def graph_nodes(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    type_or_blank = F.coalesce("type", F.lit("")).alias("type")
    return nodes.select("id", type_or_blank, "title", "description", "resource", F.array_join("tags", "|").alias("tags"), "timestamp", "generated_by", "trust_tier", "status", "stale_after", "orphan", "broken_link_count")


@register("graph_invariants", """, got AS (SELECT CASE WHEN id LIKE '%7' THEN id || '~' WHEN id LIKE '%3' THEN left(id, length(id) - 1) || '2' ELSE id END AS id, orphan OR id LIKE '%5' AS orphan FROM node
), sent AS (SELECT regexp_replace('edge:' || lower(to_base(row_number() OVER (ORDER BY source, nth) - 1, 36)), 'z$', 'y') AS edge_id, source, target FROM e
), ends AS (SELECT source AS id FROM sent UNION SELECT target FROM sent)
SELECT (SELECT count(*) FROM (SELECT 1 FROM got GROUP BY id HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM ends WHERE id NOT IN (SELECT id FROM got)) AS dangling_edges,
  (SELECT count(*) FROM got WHERE orphan AND id IN (SELECT id FROM ends)) AS wrong_orphans, (SELECT count(*) FROM (SELECT 1 FROM sent GROUP BY edge_id HAVING count(*) > 1)) AS repeated_edge_ids""")
def graph_invariants(spark, sf_dir):
    """The whole concept graph, with faults of each kind put in by the ends of its ids."""
    node_id = F.col("id")
    named = F.when(node_id.endswith("7"), F.concat(node_id, F.lit("~"))).when(node_id.endswith("3"), F.regexp_replace(node_id, "3$", "2")).otherwise(node_id)
    got = _nodes(spark, sf_dir).select("bundle_id", named.alias("id"), (F.col("orphan") | node_id.endswith("5")).alias("orphan"))
    return graph.invariants(got, _edges(spark, sf_dir).withColumn("edge_id", F.regexp_replace("edge_id", "z$", "y")))


@register("graph_faults", """WITH n AS (SELECT c_mktsegment AS bundle_id, 'n' || (c_custkey % 997) AS id, 't' AS type, c_custkey % 5 = 0 AS orphan, c_custkey % 11 = 0 AS failed, c_custkey % 2 AS broken FROM customer
), g AS (SELECT c_mktsegment AS bundle_id, o_orderkey % 4093 AS k, 'edge:' || CASE WHEN o_orderkey % 13 = 0 THEN '0' ELSE '' END || lower(to_base(o_orderkey % 4093, 36)) AS edge_id, 'n' || (o_custkey % 997) AS source, 'n' || (o_orderkey % 1009) AS target, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
), t AS (SELECT bundle_id, count(*) AS n FROM g GROUP BY 1), ends AS (SELECT bundle_id, source AS id FROM g UNION SELECT bundle_id, target FROM g
), pairs AS (SELECT DISTINCT bundle_id, target, source FROM g), said AS (SELECT DISTINCT bundle_id, target, source FROM g WHERE o_orderkey % 3 <> 0 UNION SELECT c_mktsegment, 'n' || (c_custkey % 997), 'q' FROM customer WHERE c_custkey % 50 = 0
), f AS (
  SELECT bundle_id, 'repeated-id' AS fault, count(*) AS n FROM (SELECT bundle_id, id FROM n GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT bundle_id, 'repeated-edge', count(*) FROM (SELECT bundle_id, edge_id FROM g GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT g.bundle_id, 'edge-number', count(*) FROM g JOIN t USING (bundle_id) WHERE k >= t.n OR o_orderkey % 13 = 0 GROUP BY 1
  UNION ALL SELECT bundle_id, 'dangling-end', count(*) FROM ends WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.bundle_id = ends.bundle_id AND n.id = ends.id) GROUP BY 1
  UNION ALL SELECT bundle_id, 'backlink-missing', count(*) FROM (SELECT * FROM pairs EXCEPT SELECT * FROM said) GROUP BY 1
  UNION ALL SELECT bundle_id, 'backlink-unfounded', count(*) FROM (SELECT * FROM said EXCEPT SELECT * FROM pairs) GROUP BY 1
  UNION ALL SELECT bundle_id, 'orphan-mark', count(*) FROM n WHERE NOT failed AND orphan = EXISTS (SELECT 1 FROM ends WHERE ends.bundle_id = n.bundle_id AND ends.id = n.id) GROUP BY 1
  UNION ALL SELECT bundle_id, 'failed-source', count(*) FROM n WHERE failed GROUP BY 1
  UNION ALL SELECT DISTINCT bundle_id, 'counts', 1 FROM n WHERE bundle_id < 'C'
) SELECT bundle_id, fault, n::BIGINT AS n FROM f""", facts=False)
def graph_faults(spark, sf_dir):
    """Customers and orders as a message whose parts disagree in every way."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    name = lambda c, by: F.concat(F.lit("n"), (c % by).cast("string"))
    bundle = F.col("c_mktsegment").alias("bundle_id")
    node_rows = table("customer").select(bundle, name(key, 997).alias("id"), F.lit("t").alias("type"), F.array().cast("array<string>").alias("tags"), (key % 5 == 0).alias("orphan"), (key % 11 == 0).alias("source_failed"), (key % 2).alias("broken_link_count"))
    placed = table("orders").join(table("customer"), F.col("o_custkey") == key)
    edge_id = F.concat(F.lit("edge:"), F.when(order % 13 == 0, "0").otherwise(""), text.base36(order % 4093))
    edge_rows = placed.select(bundle, edge_id.alias("edge_id"), name(F.col("o_custkey"), 997).alias("source"), name(order, 1009).alias("target"), "o_orderkey")
    back = edge_rows.where("o_orderkey % 3 <> 0").select("bundle_id", "target", "source").unionByName(table("customer").where("c_custkey % 50 = 0").select(bundle, name(key, 997).alias("target"), F.lit("q").alias("source"))).distinct()
    counted = node_rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("concept_count"), F.count_if("orphan").alias("orphan_count"), F.sum("broken_link_count").alias("broken_link_count"))
    edge_count = F.col("edge_count") + F.when(F.col("bundle_id") < "C", 1).otherwise(0)
    stated = counted.join(edge_rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("edge_count")), "bundle_id").withColumn("edge_count", edge_count)
    return graph.message_faults(node_rows, edge_rows, back, stated)


@register("induced_subgraph", "SELECT source, target, count(*) AS n FROM e JOIN c a ON a.id = source JOIN c b ON b.id = target WHERE a.type IN ('nation', 'customer', 'region') AND b.type IN ('nation', 'customer', 'region') GROUP BY 1, 2")
def induced_subgraph(spark, sf_dir):
    resolved, nodes = _links(spark, sf_dir), _nodes(spark, sf_dir)
    seen = query.visible(nodes, query.View(types=["nation", "customer", "region"]))
    return graph.induced(_internal(spark, sf_dir), seen).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@register("node_details", "SELECT id, (SELECT count(*) FROM e WHERE source = id) AS outgoing, (SELECT count(DISTINCT target) FROM e WHERE source = id) AS targets, (SELECT count(DISTINCT source) FROM e WHERE target = id) AS backlinks, broken FROM node")
def node_details(spark, sf_dir):
    resolved, nodes = _links(spark, sf_dir), _nodes(spark, sf_dir)
    return query.details(_internal(spark, sf_dir), nodes, graph.broken_links(resolved)).drop("bundle_id")


@register("findings_all", "SELECT DISTINCT code, category, severity, 'mem://tables/' || id || '.md' AS uri, subject FROM f")
def findings_all(spark, sf_dir):
    return rules.distinct_findings(_findings(spark, sf_dir)).drop("bundle_id", "range")


@register("findings_by_uri", "SELECT 'mem://tables/' || id || '.md' AS uri, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'information') AS infos FROM f WHERE code <> 'okf.curation.orphan-concept' GROUP BY 1")
def findings_by_uri(spark, sf_dir):
    return rules.by_uri(_findings(spark, sf_dir)).drop("bundle_id")


@register("bundle_summary", "SELECT category, count(*) AS n FROM f GROUP BY 1")
def bundle_summary(spark, sf_dir):
    if (spark.sparkContext.applicationId, sf_dir, "findings") in _HELD:
        return rules.summary(_findings(spark, sf_dir)).drop("bundle_id")
    # Only counts are asked for, so neither the nodes nor the findings are written first.
    parsed, resolved = _parsed(spark, sf_dir), _links(spark, sf_dir)
    return rules.summary(rules.all_findings(parsed, resolved, graph.nodes(parsed, resolved), NOW, TODAY)).drop("bundle_id")


@register("duplicate_resources", "SELECT 'mem://tables/' || id || '.md' AS uri, subject FROM dup")
def duplicate_resources(spark, sf_dir):
    return rules.duplicate_resources(_parsed(spark, sf_dir)).select("uri", "subject")


@register("lifecycle_rules", "SELECT code, 'mem://tables/' || id || '.md' AS uri, subject FROM f WHERE code IN ('okf.curation.invalid-status', 'okf.curation.invalid-stale-after', 'okf.curation.stale-concept')")
def lifecycle_rules(spark, sf_dir):
    return rules.lifecycle(_parsed(spark, sf_dir), TODAY).select("code", "uri", "subject")


@register("search_terms", "SELECT id FROM c WHERE (contains(lower(id), 'order') OR contains(lower(title), 'order') OR len(list_filter(tags, lambda t: contains(lower(t), 'order'))) > 0) AND (contains(lower(id), '7') OR contains(lower(title), '7') OR len(list_filter(tags, lambda t: contains(lower(t), '7'))) > 0)")
def search_terms(spark, sf_dir):
    return query.visible(_nodes(spark, sf_dir), query.View(text="  ORDER ７ ")).select("id")


@register("filter_type_tag_folder", "SELECT id FROM c WHERE type = 'order' AND list_contains(tags, 'F') AND id LIKE 'order/1-URGENT/%'")
def filter_type_tag_folder(spark, sf_dir):
    return query.visible(_nodes(spark, sf_dir), query.View(types=["order"], tags=["F", "none"], folder="order/1-URGENT")).select("id")


_FOLDERS = "up AS (SELECT id, unnest(list_transform(range(0, len(string_split(id, '/'))::BIGINT), lambda k: array_to_string(string_split(id, '/')[1:k], '/'))) AS folder FROM c)"


@register("folder_hierarchy", f", {_FOLDERS} SELECT folder, CASE WHEN folder <> '' THEN regexp_replace(folder, '/?[^/]+$', '') END AS parent, regexp_extract(folder, '[^/]*$') AS label, CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS depth, count(*) FILTER (WHERE regexp_replace(id, '/?[^/]*$', '') = folder) AS direct, count(*) AS descendants FROM up GROUP BY 1")
def folder_hierarchy(spark, sf_dir):
    return query.folders(_nodes(spark, sf_dir)).drop("bundle_id").withColumn("depth", F.col("depth").cast("long"))


@register("sidebar_rollup", f", {_FOLDERS}, per AS (SELECT id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM f WHERE code <> 'okf.curation.orphan-concept' GROUP BY 1) SELECT folder, count(*) AS concepts, coalesce(sum(errors), 0)::BIGINT AS errors, coalesce(sum(warnings), 0)::BIGINT AS warnings FROM up LEFT JOIN per USING (id) GROUP BY 1")
def sidebar_rollup(spark, sf_dir):
    return query.sidebar(_nodes(spark, sf_dir), rules.by_uri(_findings(spark, sf_dir))).drop("bundle_id")


@register("vocabulary", "SELECT DISTINCT 'type' AS kind, type AS value FROM c UNION SELECT DISTINCT 'tag', unnest(tags) FROM c")
def vocabulary(spark, sf_dir):
    return query.vocabulary(_nodes(spark, sf_dir)).drop("bundle_id")


@register("type_colors", "SELECT DISTINCT type, ['#4c78a8', '#f58518', '#e45756', '#72b7b2', '#54a24b', '#eeca3b', '#b279a2', '#ff9da6', '#9d755d', '#bab0ac'][(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(type, ''), lambda x: ascii(x)::HUGEINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 10)::BIGINT + 1] AS color FROM c WHERE type <> ''")
def type_colors(spark, sf_dir):
    return _parsed(spark, sf_dir).where("length(type) > 0").select("type").distinct().select("type", text.color_for_type(F.col("type")).alias("color"))


@register("content_hashes", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, strlen(text) AS bytes, length(text) AS points FROM documents", facts=False)
def content_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("points"))


@register("headings", "SELECT path, level, heading FROM (SELECT 'region/' || r_name || '.md' AS path, 1 AS level, r_name AS heading FROM region UNION ALL SELECT 'nation/' || n_name || '.md', 1, n_name FROM nation UNION ALL SELECT 'part/' || p_partkey || '.md', 2, 'Size' FROM part UNION ALL SELECT 'index.md', 1, 'Tables')", facts=False)
def headings(spark, sf_dir):
    return parse.headings(_parsed(spark, sf_dir)).select("path", "level", "heading")


@register("frontmatter_tags", "SELECT id, unnest(tags) AS tag FROM c")
def frontmatter_tags(spark, sf_dir):
    return parse.concepts(_parsed(spark, sf_dir)).select("id", F.explode("tags").alias("tag"))


@register("canonical_paths", "SELECT user_id, event_type || '/' || (user_id % 7) || '.md' AS path, count(*) AS n FROM events GROUP BY 1, 2", facts=False)
def canonical_paths(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = F.concat(F.lit("./x//../"), "event_type", F.lit("\\.\\"), (F.col("user_id") % 7).cast("string"), F.lit(".md"))
    return events.select("user_id", paths.canonical_path(raw).alias("path")).groupBy("user_id", "path").agg(F.count(F.lit(1)).alias("n"))


@register("page_href_classification", r"SELECT class AS classification, count(*) AS n FROM (SELECT CASE WHEN h = '' THEN 'invalid' WHEN regexp_matches(h, '^([A-Za-z][A-Za-z0-9+.-]*:|//)') THEN 'external' WHEN starts_with(h, '#') THEN 'fragment' WHEN contains(split_part(h, '#', 1), chr(92)) THEN 'invalid' WHEN starts_with(h, '/') OR NOT contains(h, '..') THEN CASE WHEN regexp_matches(split_part(split_part(h, '#', 1), '?', 1), '(\.md|/)$') THEN 'broken' ELSE 'invalid' END ELSE 'out-of-bundle' END AS class FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h FROM pages)) GROUP BY 1", facts=False)
def page_href_classification(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hrefs = pages.select(F.lit("pages").alias("bundle_id"), F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'))).alias("raw_target"))
    none = hrefs.select("bundle_id", "path", F.lit(None).cast("string").alias("reserved")).limit(0)
    return graph.resolve(hrefs, none).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@register("index_entries", """, ent AS (
  SELECT regexp_replace(id, '/?[^/]*$', '') AS directory, 0 AS kind, regexp_extract(id, '[^/]*$') || '.md' AS name, '- [' || CASE WHEN coalesce(title, '') = '' THEN regexp_extract(id, '[^/]*$') ELSE title END || '](./' || replace(regexp_extract(id, '[^/]*$'), ' ', '%20') || '.md)' || CASE WHEN description IS NULL THEN '' ELSE ' - ' || description END AS line FROM c
  UNION ALL SELECT DISTINCT regexp_replace(d, '/?[^/]*$', ''), 1, regexp_extract(d, '[^/]*$'), '- [' || regexp_extract(d, '[^/]*$') || '](./' || replace(regexp_extract(d, '[^/]*$'), ' ', '%20') || '/)' FROM (SELECT unnest(list_transform(range(1, len(string_split(id, '/'))::BIGINT), lambda k: array_to_string(string_split(id, '/')[1:k], '/'))) AS d FROM c)
) SELECT directory, kind, name, line FROM ent""")
def index_entries(spark, sf_dir):
    return indexes.entries(_parsed(spark, sf_dir)).drop("bundle_id")


_REGIONS = REGISTRY["index_entries"][1] or ""


@register("index_plan", _REGIONS.replace("SELECT directory, kind, name, line FROM ent", """, reg AS (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY kind, name) - 1 AS rn FROM ent
), pieces AS (
  SELECT directory, 0 AS piece, CASE WHEN directory = '' THEN '---' || chr(10) || 'okf_version: "0.2"' || chr(10) || '---' || chr(10) || chr(10) || '# Tables' || chr(10) || chr(10) ELSE '' END || '<!-- index:start -->' || chr(10) || '## Contents' || chr(10) || chr(10) AS text FROM reg WHERE rn = 0
  UNION ALL SELECT directory, rn // 1000 + 1, string_agg(line || chr(10), '' ORDER BY rn) FROM reg GROUP BY 1, 2
  UNION ALL SELECT directory, max(rn) // 1000 + 2, '<!-- index:end -->' || chr(10) FROM reg GROUP BY 1
) SELECT CASE WHEN directory = '' THEN 'index.md' ELSE directory || '/index.md' END AS path, CASE WHEN directory = '' THEN 'update' ELSE 'create' END AS operation, piece::INTEGER AS piece, text FROM pieces"""), facts=False)
def index_plan(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    chunks = _held(spark, sf_dir, "index chunks", lambda: indexes.chunked(parsed, 1000))
    return indexes.pieces(indexes.plan(parsed, chunks=chunks), chunks).select("path", "operation", "piece", "text")


@register("migration_actions", "SELECT id || '.md' AS path, stamp IS NOT NULL AS changed, CASE WHEN stamp IS NOT NULL THEN 'timestamp-to-generated' ELSE '' END AS actions FROM c UNION ALL SELECT 'index.md', true, 'root-version-to-0.2'")
def migration_actions(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    old = docs.withColumn("content", F.when(F.col("bundle_path") == "index.md", F.encode(F.lit('---\nokf_version: "0.1" # old\n---\n\n# Tables\n'), "UTF-8")).otherwise(F.col("content")))
    return migration.plan(_held(spark, sf_dir, "before migration", lambda: parse.parse(old, ("body", "fields", "fault")).select(*migration.READ)), "process:migrate").select("path", "changed", F.array_join("actions", "|").alias("actions"))


@register("budget_cutoff", "SELECT path, cost, CASE WHEN total <= lim THEN 'kept' WHEN path = min(path) FILTER (WHERE total > lim) OVER () THEN 'over' ELSE 'skipped' END AS state FROM (SELECT lang || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path, n_chars AS cost, sum(n_chars) OVER (ORDER BY lang || '/' || lpad(doc_id::VARCHAR, 9, '0') ROWS UNBOUNDED PRECEDING) AS total, 1000000 AS lim FROM documents)", facts=False)
def budget_cutoff(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.lit("docs").alias("bundle_id"), F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("n_chars").alias("cost"))
    return query.cut_off(rows, 1_000_000).select("path", "cost", "state")


@register("vocabulary_growth", "SELECT id || '.md' AS path, sum(CASE WHEN type <> '' AND first THEN 1 ELSE 0 END) OVER (ORDER BY id || '.md')::BIGINT AS types FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id || '.md') = 1 AS first FROM c)")
def vocabulary_growth(spark, sf_dir):
    return reports.type_growth(_outline(spark, sf_dir)).select("path", F.col("types").cast("long").alias("types"))


@register("bundle_verdict", "SELECT count(*) AS findings, max(CASE category WHEN 'conformance' THEN 1 ELSE 0 END) AS exit_code FROM (SELECT DISTINCT code, category, id, subject FROM f)")
def bundle_verdict(spark, sf_dir):
    return reports.verdicts(rules.distinct_findings(_findings(spark, sf_dir))).drop("bundle_id")


@register("diagnostics", "SELECT 'mem://tables/' || id || '.md' AS uri, string_agg(severity || ' ' || code || ' ' || subject, chr(10) ORDER BY CASE category WHEN 'conformance' THEN 0 ELSE 1 END, code, subject) AS lines FROM (SELECT DISTINCT * FROM f WHERE code <> 'okf.curation.orphan-concept') GROUP BY 1")
def diagnostics(spark, sf_dir):
    found = reports.diagnostics(rules.distinct_findings(_findings(spark, sf_dir)), f"{rules.PREFIX}.curation.orphan-concept")
    return found.select("uri", F.array_join(F.transform("diagnostics", lambda d: F.concat_ws(" ", d["severity"], d["code"], d["subject"])), "\n").alias("lines"))


@register("finding_lines", "SELECT 'mem://tables/' || id || '.md' AS uri, upper(severity) || ' ' || code || ' mem://tables/' || id || '.md' || CASE WHEN subject <> '' THEN ' (' || subject || ')' ELSE '' END AS line FROM (SELECT DISTINCT * FROM f)")
def finding_lines(spark, sf_dir):
    return reports.lines(rules.distinct_findings(_findings(spark, sf_dir))).drop("bundle_id")


@register("graph_budgets", "SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM l WHERE class = 'broken') AS broken, (SELECT count(DISTINCT type) FROM c) AS types, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM c)) AS tags, (SELECT sum(len(tags)) FROM c)::BIGINT AS tag_uses")
def graph_budgets(spark, sf_dir):
    resolved, nodes = _links(spark, sf_dir), _nodes(spark, sf_dir)
    return reports.budgets(nodes, _edges(spark, sf_dir), graph.broken_links(resolved)).drop("bundle_id", "json_bytes")


@register("payload_sizes", """WITH s AS (SELECT s_suppkey AS k, n_nationkey AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey
), linked AS (SELECT * FROM s WHERE k % 3 <> 0
), n AS (
  SELECT b, '{"id":"' || k || '","type":"supplier","tags":[],"trustTier":"unverified","status":"stable","sourceCount":0,"orphan":' || CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END || ',"brokenLinkCount":0}' AS j, '"' || k || '":[]' AS back FROM s
  UNION ALL SELECT n_nationkey, '{"id":"hub","type":"hub","tags":[],"trustTier":"unverified","status":"stable","sourceCount":0,"orphan":' || CASE WHEN n_nationkey IN (SELECT b FROM linked) THEN 'false' ELSE 'true' END || ',"brokenLinkCount":0}',
    '"hub":[' || coalesce((SELECT string_agg('"' || k || '"', ',' ORDER BY k) FROM linked WHERE b = n_nationkey), '') || ']' FROM nation
), e AS (SELECT b, '{"id":"edge:' || lower(to_base(row_number() OVER (PARTITION BY b ORDER BY k::VARCHAR) - 1, 36)) || '","source":"' || k || '","target":"hub","sourceRange":{"start":{"offset":28,"line":4,"character":4},"end":{"offset":54,"line":4,"character":30}}}' AS j FROM linked
), np AS (SELECT b, string_agg(j, ',') AS j, string_agg(back, ',') AS back, count(*) AS n, count(*) FILTER (WHERE contains(j, '"orphan":true')) AS o FROM n GROUP BY 1), ep AS (SELECT b, string_agg(j, ',') AS j, count(*) AS n FROM e GROUP BY 1)
SELECT 'nation-' || np.b AS bundle_id, strlen('{"protocolVersion":1,"revision":7,"nodes":[' || np.j || '],"edges":[' || coalesce(ep.j, '') || '],"backlinks":{' || np.back || '},"brokenLinks":[],"statistics":{"conceptCount":' || np.n || ',"edgeCount":' || coalesce(ep.n, 0) || ',"orphanCount":' || np.o
  || ',"brokenLinkCount":0,"typeCounts":{"hub":1' || CASE WHEN np.n > 1 THEN ',"supplier":' || (np.n - 1) ELSE '' END || '},"tagCounts":{}}}')::BIGINT AS octets FROM np LEFT JOIN ep ON ep.b = np.b""", facts=False)
def payload_sizes(spark, sf_dir):
    """Octets of each nation's graph as one message."""
    parsed = _nations(spark, sf_dir)
    resolved = graph.all_links(parsed)
    return payload.sizes(graph.nodes(parsed, resolved), graph.edges(resolved), graph.broken_links(resolved), 7)


@register("preserved_focus", """WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE (turn + conv_id) % 3 <> 0)
SELECT b.conv_id, b.turn, b.place, x.place AS kept, x.turn AS focus FROM b LEFT JOIN a x ON x.conv_id = b.conv_id AND x.place = coalesce((SELECT a.place FROM a WHERE a.conv_id = b.conv_id AND a.turn = b.turn), (SELECT least(b.place, max(a.n) - 1) FROM a WHERE a.conv_id = b.conv_id))""", facts=False)
def preserved_focus(spark, sf_dir):
    """Where each turn's focus goes once every third turn is gone."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    numbered = lambda df: df.withColumn("place", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long"))
    return query.preserved(numbered(turns), numbered(turns.where((F.col("turn") + F.col("conv_id")) % 3 != 0)), ["conv_id"], "turn", "place")


@register("write_preflight", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, text, doc_id % 7 AS k FROM d)
SELECT doc_id::VARCHAR || CASE WHEN k = 3 THEN '-gone' WHEN k = 4 THEN '-new' ELSE '' END AS path, CASE k WHEN 1 THEN 'changed' WHEN 2 THEN 'appeared' WHEN 3 THEN 'missing' WHEN 5 THEN 'changed' ELSE 'ready' END AS outcome FROM p""", facts=False)
def write_preflight(spark, sf_dir):
    """Proposals on the documents as they are: most expect what is there, some another text, another length, none, or one that is gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lit("docs").alias("bundle_id"), "doc_id", F.coalesce("text", F.lit("")).alias("content"))
    k, name = F.col("doc_id") % 7, F.col("doc_id").cast("string")
    path = F.when(k == 3, F.concat(name, F.lit("-gone"))).when(k == 4, F.concat(name, F.lit("-new"))).otherwise(name)
    sha = F.when(k == 1, F.sha2(F.concat("content", F.lit("!")), 256)).when(~k.isin(2, 4), F.upper(F.sha2("content", 256)))
    size = F.octet_length("content").cast("long") + F.when(k == 5, 1).otherwise(0)
    proposed = docs.select("bundle_id", path.alias("path"), sha.alias("expected_sha256"), size.alias("expected_bytes"), F.concat("content", F.lit("\n")).alias("proposed"))
    return guarded.preflight(docs.select("bundle_id", name.alias("path"), "content"), proposed).select("path", "outcome")


@register("refused_bundles", "SELECT lang AS bundle_id, count(*) AS documents FROM documents GROUP BY 1 HAVING count(*) > 100", facts=False)
def refused_bundles(spark, sf_dir):
    return reports.refused(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("lang", "bundle_id"), 100)


@register("root_classification", """SELECT 'nation-' || n_nationkey AS bundle_id, CASE WHEN n_nationkey % 7 = 6 OR n_nationkey % 15 = 14 THEN NULL ELSE ['0.1', '0.2', '0.7', NULL, NULL][n_nationkey % 5 + 1] END AS version,
  CASE WHEN n_nationkey % 7 = 6 OR n_nationkey % 15 = 14 THEN 'failed' ELSE ['supported', 'supported', 'future-minor', 'undeclared', 'undeclared'][n_nationkey % 5 + 1] END AS verdict, CASE WHEN n_nationkey % 7 <> 6 AND n_nationkey % 3 < 2 THEN 'Suppliers of ' || n_name END AS label FROM nation""", facts=False)
def root_classification(spark, sf_dir):
    return reports.root_class(_nations(spark, sf_dir))


_NOTE = r"""WITH t AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS id, p_size % 10 AS form, 'p' || p_size AS name, p_brand AS brand,
  ['tags: ["' || p_brand || ', first", second, ''it''''s'']', 'description: >' || chr(10) || '  Part' || chr(10) || '  of' || chr(10) || chr(10) || '  ' || p_brand, '"status": draft', 'title: "Caf\u00e9\tp' || p_size || '"', 'seed: &b ' || p_brand || chr(10) || 'resource: *b', '', '', 'description: |-' || chr(10) || '  p' || p_size || chr(10) || '    more' || chr(10) || '  # no comment'][p_partkey % 8 + 1] AS front FROM part)"""


@register("note_fields", _NOTE + """ SELECT id, CASE WHEN k % 8 = 0 THEN brand || ', first|second|it''s' ELSE '' END AS tags, CASE k % 8 WHEN 1 THEN 'Part of' || chr(10) || brand || chr(10) WHEN 7 THEN name || chr(10) || '  more' || chr(10) || '# no comment' END AS description,
  CASE WHEN k % 8 = 2 THEN 'draft' END AS status, CASE WHEN k % 8 = 3 THEN 'Café' || chr(9) || name END AS title, CASE WHEN k % 8 = 4 THEN brand END AS resource, CASE WHEN k % 8 IN (5, 6) THEN 'frontmatter' END AS failure FROM t""", facts=False)
def note_fields(spark, sf_dir):
    return _notes(spark, sf_dir).select("id", F.array_join("tags", "|").alias("tags"), "description", "status", "title", "resource", "failure")


@register("note_failures", """SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 8 = 5 THEN 3 ELSE 4 END::BIGINT AS line, 0::BIGINT AS character,
  (CASE WHEN p_partkey % 8 = 5 THEN 4 + 11 + 6 + length(p_brand) + 1 ELSE 4 + 11 + 6 + 3 + length(p_brand) END + CASE WHEN p_partkey % 13 <> 0 THEN 0 WHEN p_partkey % 8 = 5 THEN 3 ELSE 4 END)::BIGINT AS start FROM part WHERE p_partkey % 8 IN (5, 6)""", facts=False)
def note_failures(spark, sf_dir):
    """Where each broken frontmatter breaks, as line and character from 0 and in UTF-16 units."""
    found = parse.failures(_notes(spark, sf_dir))
    return found.select(F.regexp_replace("path", r"\.md$", "").alias("id"), *[F.col(f"range.{n}").cast("long").alias(n) for n in ("line", "character", "start")])


@register("note_links", _NOTE + r""", d AS (
  SELECT id, k, '---' || chr(10) || 'type: note' || chr(10) || front || chr(10) || '---' || chr(10) || chr(10) AS head,
    CASE form WHEN 0 THEN {'label': 'yes', 'target': './' || name || '.md', 'before': '\[no](./x.md) ', 'length': 7 + length('./' || name || '.md'), 'nl': 0} WHEN 1 THEN {'label': 'one [two] three', 'target': './a.md', 'before': '', 'length': 25, 'nl': 0}
      WHEN 2 THEN {'label': 'p', 'target': './x(1).md', 'before': '', 'length': 14, 'nl': 0} WHEN 4 THEN {'label': 'after', 'target': './b.md', 'before': '<div>' || chr(10) || '[raw](./a.md)' || chr(10) || '</div>' || chr(10) || chr(10), 'length': 15, 'nl': 0}
      WHEN 5 THEN {'label': 'e', 'target': './a&b.md', 'before': '', 'length': 17, 'nl': 0} WHEN 6 THEN {'label': 'out', 'target': './c.md', 'before': '```' || chr(10) || '[in](./a.md)' || chr(10) || '```' || chr(10), 'length': 8, 'nl': 0}
      WHEN 8 THEN {'label': 'wide label', 'target': './w.md', 'before': 'xx ', 'length': 28, 'nl': 0} WHEN 9 THEN {'label': 'in' || chr(10) || 'list', 'target': './m.md', 'before': '- > ', 'length': 21, 'nl': 1} END AS l
  FROM t WHERE k % 8 NOT IN (5, 6)
), p AS (SELECT id, l, CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS cr, head || l.before AS before FROM d WHERE l IS NOT NULL
), q AS (SELECT *, length(before) - length(replace(before, chr(10), '')) AS rows FROM p)
SELECT id, l.label AS label, l.target AS raw_target, (length(before) + cr * rows)::BIGINT AS start, rows::BIGINT AS line, length(string_split(before, chr(10))[-1])::BIGINT AS character, (length(before) + l.length + cr * (rows + l.nl))::BIGINT AS "end" FROM q""", facts=False)
def note_links(spark, sf_dir):
    """Links of the notes with their places: a sign beyond U+FFFF counts as two."""
    found = parse.links(_notes(spark, sf_dir))
    return found.select(F.col("source_id").alias("id"), "label", "raw_target", *[F.col(f"range.{n}").cast("long").alias(n) for n in ("start", "line", "character", "end")])


@register("finding_places", """WITH s AS (SELECT *, '---' || chr(10) || CASE WHEN s_suppkey % 7 <> 0 THEN 'type: supplier' || chr(10) ELSE '' END || 'title: "' || s_name || '"' || chr(10) AS before FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'mem://tables/supplier/' || s_suppkey || '.md' AS uri, 'okf.curation.invalid-status' AS code, length(before)::BIGINT AS start, (3 - CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS line, (length(before) + 15)::BIGINT AS "end" FROM s WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'mem://tables/supplier/' || s_suppkey || '.md', 'okf.conformance.concept-type', 4, 1, length(before) + CASE WHEN s_suppkey % 5 = 0 THEN 16 WHEN s_suppkey % 3 = 0 THEN 14 ELSE 0 END + CASE WHEN s_suppkey % 4 = 0 THEN 58 ELSE 0 END FROM s WHERE s_suppkey % 7 = 0""", facts=False)
def finding_places(spark, sf_dir):
    """Where suppliers' faults stand: at their field, or at the frontmatter for want of one."""
    found = _findings(spark, sf_dir).where(F.col("uri").startswith("mem://tables/supplier/") & F.col("code").isin(f"{rules.PREFIX}.curation.invalid-status", f"{rules.PREFIX}.conformance.concept-type"))
    return found.select("uri", "code", *[F.col(f"range.{n}").cast("long").alias(n) for n in ("start", "line", "end")])


@register("folder_children", f", {_FOLDERS} SELECT regexp_replace(folder, '/?[^/]+$', '') AS folder, 0 AS kind, regexp_extract(folder, '[^/]*$') AS label, folder AS path FROM (SELECT DISTINCT folder FROM up WHERE folder <> '') UNION ALL SELECT regexp_replace(id, '/?[^/]*$', ''), 1, coalesce(title, id), id FROM c")
def folder_children(spark, sf_dir):
    return query.children(graph.names(_outline(spark, sf_dir))).drop("bundle_id")


@register("link_occurrences", "SELECT source, nth, target, coalesce(c.title, target) AS title, row_number() OVER (PARTITION BY source, target ORDER BY nth) - 1 AS again FROM e JOIN c ON c.id = target")
def link_occurrences(spark, sf_dir):
    found = query.occurrences(_internal(spark, sf_dir), _nodes(spark, sf_dir))
    return found.select("source", F.col("nth").cast("long").alias("nth"), "target", "title", "again")


@register("present_names", "SELECT DISTINCT p AS name, p IN (SELECT id FROM c) AS node_exists, p IN (SELECT regexp_replace(id, '/?[^/]*$', '') FROM c) OR p IN (SELECT DISTINCT split_part(id, '/', 1) FROM c WHERE contains(id, '/')) AS folder_exists FROM (SELECT 'region/' || r_name AS p FROM region UNION ALL SELECT 'order/' || o_orderpriority FROM orders UNION ALL SELECT 'none/' || n_name FROM nation)")
def present_names(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names = table("region").select(F.concat(F.lit("region/"), "r_name").alias("name")).unionByName(table("orders").select(F.concat(F.lit("order/"), "o_orderpriority").alias("name"))).unionByName(table("nation").select(F.concat(F.lit("none/"), "n_name").alias("name"))).distinct()
    return query.present(_nodes(spark, sf_dir), names.withColumn("bundle_id", F.lit(tables.BUNDLE))).drop("bundle_id")


@register("keyboard_neighbours", "SELECT conv_id, turn, coalesce(lead(turn) OVER w, min(turn) OVER (PARTITION BY conv_id)) AS next, coalesce(lag(turn) OVER w, max(turn) OVER (PARTITION BY conv_id)) AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)", facts=False)
def keyboard_neighbours(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return query.neighbours(turns.select("conv_id", "turn"), ["conv_id"], "turn")


@register("sample_summary", "SELECT event_type, count(value) AS count, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1", facts=False)
def sample_summary(spark, sf_dir):
    return query.sample_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type").withColumn("mean", F.round("mean", 6))


#: Events stand for workspace changes; their spacing makes hours of what a workspace has in milliseconds.
_QUIET, _LONGEST = 6 * 3600_000, 24 * 3600_000
_CHANGES = "chg AS (SELECT user_id::VARCHAR AS bundle_id, ts, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'change' END AS kind, 'doc-' || (event_id % 7) || '.md' AS uri FROM events)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("change")
    return events.select(F.col("user_id").cast("string").alias("bundle_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.concat(F.lit("doc-"), (F.col("event_id") % 7).cast("string"), F.lit(".md")).alias("uri"), F.lit(None).cast("string").alias("previous_uri"))


@register("refresh_sessions", f"WITH {_CHANGES}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY bundle_id ORDER BY ms) < {_QUIET} THEN 0 ELSE 1 END AS fresh FROM chg), s AS (SELECT *, sum(fresh) OVER (PARTITION BY bundle_id ORDER BY ms) AS session FROM g) SELECT bundle_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS changes, count(DISTINCT uri) AS paths FROM s GROUP BY bundle_id, session", facts=False)
def refresh_sessions(spark, sf_dir):
    return stream.sessions(_changes(spark, sf_dir), _QUIET).select("bundle_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "changes", "paths")


_CAPPED = f"""WITH RECURSIVE {_CHANGES}, n AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY ms) AS rn FROM chg), b AS (
  SELECT bundle_id, rn, ms, kind, uri, ms AS batch_start FROM n WHERE rn = 1
  UNION ALL SELECT n.bundle_id, n.rn, n.ms, n.kind, n.uri, CASE WHEN n.ms - b.ms >= {_QUIET} OR n.ms - b.batch_start >= {_LONGEST} THEN n.ms ELSE b.batch_start END FROM b JOIN n ON n.bundle_id = b.bundle_id AND n.rn = b.rn + 1
) """


@register("refresh_capped_batches", _CAPPED + "SELECT bundle_id, batch_start, count(*) AS changes FROM b GROUP BY 1, 2", facts=False)
def refresh_capped_batches(spark, sf_dir):
    return stream.capped_batches(_changes(spark, sf_dir), _QUIET, _LONGEST).groupBy("bundle_id", "batch_start").agg(F.count(F.lit(1)).alias("changes"))


@register("refresh_coalesced", _CAPPED + "SELECT bundle_id, batch_start, CASE WHEN count(DISTINCT uri) > 3 OR count(DISTINCT kind || uri) > 4 THEN 1 ELSE count(DISTINCT kind || uri) END AS changes, count(DISTINCT uri) AS paths, count(DISTINCT uri) > 3 OR count(DISTINCT kind || uri) > 4 AS rescan FROM b GROUP BY 1, 2", facts=False)
def refresh_coalesced(spark, sf_dir):
    return stream.coalesced(stream.capped_batches(_changes(spark, sf_dir), _QUIET, _LONGEST), "bundle_id", "batch_start", most_paths=3)


@register("stale_revision_filter", """WITH m AS (SELECT *, event_id % 11 AS revision, event_id % 5 + 1 AS delivery_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, user_id, revision, delivery_id FROM m WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.user_id = m.user_id AND p.rn < m.rn AND (p.revision > m.revision OR p.revision = m.revision AND p.delivery_id >= m.delivery_id))""", facts=False)
def stale_revision_filter(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"revision": F.col("event_id") % 11, "delivery_id": F.col("event_id") % 5 + 1})
    return stream.newest(events, "user_id", "ts", "event_id").select("event_id", "user_id", "revision", "delivery_id")


_LIMITS = {"body_units": 1_500_000, "body_lines": 3_000, "body_signs": 40_000}


@register("bundle_budgets", r"""WITH d AS (SELECT coalesce(lang, 'none') AS bundle_id, lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM documents
), w AS (SELECT *, length(body) + length(regexp_replace(body, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units, length(regexp_replace(body, '[^\x01-\x08\x0B\x0C\x0E-\x1F!-/:-@\[-`{-~]', '', 'g')) AS signs,
    length(body) - length(replace(body, chr(10), '')) + CASE WHEN body <> '' AND NOT ends_with(body, chr(10)) THEN 1 ELSE 0 END AS lines FROM d
), t AS (SELECT bundle_id, path, sum(units) OVER o AS u, sum(lines) OVER o AS l, sum(signs) OVER o AS s FROM w WINDOW o AS (PARTITION BY bundle_id ORDER BY path)
), b AS (SELECT *, CASE WHEN u > 1500000 THEN 'body_units' WHEN l > 3000 THEN 'body_lines' WHEN s > 40000 THEN 'body_signs' END AS broken FROM t
), f AS (SELECT bundle_id, min(path) AS first FROM b WHERE broken IS NOT NULL GROUP BY 1)
SELECT bundle_id, path, CASE WHEN first IS NULL OR path < first THEN 'kept' WHEN path = first THEN 'over' ELSE 'skipped' END AS state, CASE WHEN path = first THEN broken END AS budget, u::BIGINT AS body_units, l::BIGINT AS body_lines, s::BIGINT AS body_signs FROM b LEFT JOIN f USING (bundle_id)""", facts=False)
def bundle_budgets(spark, sf_dir):
    """Documents as concepts of a bundle per language: what each bundle has spent, and where its budgets end."""

    def make() -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        path = F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md"))
        return parse.parse(docs.select(F.coalesce("lang", F.lit("none")).alias("bundle_id"), F.concat(F.lit("mem://"), path).alias("uri"), path.alias("bundle_path"), F.encode(F.concat(F.lit("---\ntype: note\n---\n"), F.coalesce("text", F.lit(""))), "UTF-8").alias("content")))

    budgets = [b for b in limits.parser_budgets(**_LIMITS) if b.name in _LIMITS]
    return limits.spent(_held(spark, sf_dir, "document bundles", make).select("bundle_id", "path", "work"), budgets).select("bundle_id", "path", "state", "budget", *[f"spent.{n}" for n in _LIMITS])


@register("timestamps_checked", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - 9000 AS at, true AS is_date FROM events", facts=False)
def timestamps_checked(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:30"))
    return events.select("event_id", explicit_zone_epoch(stamp).alias("at"), is_iso_date(F.date_format("ts", "yyyy-MM-dd")).alias("is_date"))


def _said(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NAMES = list(templates.BODIES)
_KIND_ROWS = ", ".join(f"({k}, {_said(name)}, {_said(templates.BODIES[name])})" for k, name in enumerate(_NAMES))
_STARTER_ROWS = ", ".join(f"({_said(preset)}, {_said(s[0])}, {_said(templates.BODIES[s[1]])}, {_said(s[2])}, {_said(s[3])}, {_said(s[4])}, [{', '.join(map(_said, s[5]))}])" for preset, own in templates.PRESETS.items() for s in own)
#: A document from type, title, description, tags, stamp, runtime and body, with quoted fields; chr(27) is the one control character that rows hold.
_WRITTEN = """'---
type: ' || to_json(type)::VARCHAR || '
title: ' || replace(to_json(title)::VARCHAR, '\\u001B', '\\u001b') || '
' || CASE WHEN description IS NULL THEN '' ELSE 'description: ' || to_json(description)::VARCHAR || '
' END || CASE WHEN len(tags) > 0 THEN 'tags:
' || array_to_string(list_transform(tags, lambda t: '  - ' || to_json(t)::VARCHAR || '
'), '') ELSE '' END || CASE WHEN stamp IS NULL THEN '' ELSE 'generated:
  by: "process:wicker"
  at: ' || to_json(stamp)::VARCHAR || '
' END || CASE WHEN runtime IS NULL THEN '' ELSE 'runtime: ' || to_json(runtime)::VARCHAR || '
' END || '---

' || body"""


@register("entered_concepts", f"""WITH kinds(k, name, body) AS (VALUES {_KIND_ROWS}), t AS (
  SELECT p_partkey, p_partkey % 23 AS d, name, body, 'part ' || p_brand AS type, CASE p_partkey % 23 WHEN 9 THEN p_name || ' "a' || chr(27) || '\\" end' ELSE p_name END AS title, CASE p_partkey % 23 WHEN 10 THEN 'one' || chr(10) || 'two' || chr(10) || 'three' WHEN 11 THEN NULL ELSE 'Of ' || p_brand END AS description,
    CASE p_partkey % 23 WHEN 11 THEN [] ELSE [p_brand, 'size ' || p_size] END AS tags, CASE WHEN p_partkey % 3 = 0 THEN '2026-07-01T00:00:00Z' END AS stamp, CASE name WHEN 'attested-computation' THEN 'replace-with-runtime' END AS runtime FROM part JOIN kinds ON p_partkey % 8 = k
), u AS (SELECT *, CASE d WHEN 0 THEN 'unknown-concept-template' WHEN 1 THEN 'unsafe-relative-path' WHEN 7 THEN 'unsafe-relative-path' WHEN 12 THEN 'unsafe-relative-path' WHEN 2 THEN 'empty-concept-type' WHEN 6 THEN 'unsafe-concept-type-control' WHEN 3 THEN 'empty-concept-title' WHEN 4 THEN 'empty-concept-tag' WHEN 13 THEN 'concept-tag-utf8-limit' WHEN 5 THEN 'empty-concept-timestamp' END AS problem FROM t)
SELECT p_partkey, problem, CASE WHEN d IN (1, 7, 12) THEN NULL ELSE 'parts/' || p_partkey || '.md' END AS path, CASE WHEN problem IS NULL THEN {_WRITTEN} END AS text FROM u""", facts=False)
def entered_concepts(spark, sf_dir):
    """A concept per part, as someone might have typed it: every 23rd row of a kind holds one fault or one odd sign."""
    key, brand = F.col("p_partkey"), F.col("p_brand")
    odd = lambda usual, **other: F.coalesce(*[F.when(key % 23 == int(k[1:]), v) for k, v in other.items()], usual)
    number, none = key.cast("string"), F.lit(None).cast("string")
    path = odd(F.concat(F.lit("parts/"), number, F.lit(".md")), d1=F.concat(F.lit("../"), number, F.lit(".md")), d7=F.lit("a%252Findex.md"), d8=F.concat(F.lit("parts\\"), number, F.lit(".md")), d12=F.lit("parts/Con .md"), d14=F.concat(F.lit("%2570arts%2F"), number, F.lit("%2Emd")))
    kind = odd(F.element_at(F.array(*map(F.lit, _NAMES)), (key % 8 + 1).cast("int")), d0=F.lit("none"))
    type_ = odd(F.concat(F.lit("part "), brand), d2=F.lit("  "), d6=F.lit("a\tb"))
    title = odd(F.col("p_name"), d3=F.lit(" \n"), d9=F.concat(F.lit("\n "), F.col("p_name"), F.lit(' "a\x1b\\"\r\n end')))
    description = F.when(key % 23 != 11, odd(F.concat(F.lit("Of "), brand), d10=F.lit("one\r\ntwo\rthree")))
    tags = F.when(key % 23 == 11, F.lit(None).cast("array<string>")).when(key % 23 == 4, F.array(brand, F.lit(""))).when(key % 23 == 13, F.array(brand, F.repeat(F.lit("é"), 129)))
    tags = tags.otherwise(F.array(brand, F.concat(F.lit("size "), F.col("p_size").cast("string"))))
    stamp = F.when(key % 23 == 5, "").when(key % 3 == 0, "2026-07-01T00:00:00Z").otherwise(none)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit("parts").alias("bundle_id"), kind.alias("template"), path.alias("bundle_path"), type_.alias("type"), title.alias("title"), description.alias("description"), tags.alias("tags"), stamp.alias("timestamp"))
    return templates.rendered(rows).select("p_partkey", "problem", "path", "text")


@register("started_bundles", f"""WITH b AS (SELECT 'start-' || c_custkey AS bundle_id, ['minimal', 'software-project', 'data-analytics', 'none'][c_custkey % 4 + 1] AS preset, CASE WHEN c_custkey % 10 = 7 THEN ' ' WHEN c_custkey % 11 = 3 THEN 'a' || chr(10) ELSE '2026-07-0' || (c_custkey % 9 + 1) || 'T00:00:00Z' END AS stamp, c_custkey % 11 = 3 AS broken FROM customer
), p AS (SELECT *, CASE WHEN preset = 'none' THEN 'unknown-bundle-preset' WHEN stamp = ' ' THEN 'empty-template-timestamp' WHEN broken AND preset <> 'minimal' THEN 'unsafe-concept-timestamp-control' END AS problem FROM b
), s(preset, path, body, type, title, description, tags) AS (VALUES {_STARTER_ROWS}
), e AS (
  SELECT preset, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS folder, 0 AS kind, path AS name, '- [' || title || '](./' || split_part(path, '/', -1) || ') - ' || description || chr(10) AS line FROM s
  UNION ALL SELECT DISTINCT preset, '', 1, split_part(path, '/', 1), '- [' || split_part(path, '/', 1) || '](./' || split_part(path, '/', 1) || '/)' || chr(10) FROM s WHERE contains(path, '/')
), i AS (SELECT preset, folder, string_agg(line, '' ORDER BY kind, name) AS lines FROM e GROUP BY 1, 2 UNION ALL SELECT 'minimal', '', '')
SELECT bundle_id, path, {_WRITTEN} AS text, problem FROM (SELECT *, NULL::VARCHAR AS runtime FROM p JOIN s USING (preset) WHERE problem IS NULL)
UNION ALL SELECT bundle_id, CASE folder WHEN '' THEN 'index.md' ELSE folder || '/index.md' END, CASE folder WHEN '' THEN '---' || chr(10) || 'okf_version: "0.2"' || chr(10) || '---' || chr(10) ELSE '' END || '<!-- index:start -->' || chr(10) || '## Contents' || chr(10) || chr(10) || lines || '<!-- index:end -->' || chr(10), NULL FROM p JOIN i USING (preset) WHERE problem IS NULL
UNION ALL SELECT bundle_id, NULL, NULL, problem FROM p WHERE problem IS NOT NULL""", facts=False)
def started_bundles(spark, sf_dir):
    """A new bundle per customer, by one preset or another; some ask for none that there is, or give no sound time."""
    key = F.col("c_custkey")
    preset = F.element_at(F.array(*map(F.lit, ["minimal", "software-project", "data-analytics", "none"])), (key % 4 + 1).cast("int"))
    stamp = F.when(key % 10 == 7, " ").when(key % 11 == 3, "a\n").otherwise(F.concat(F.lit("2026-07-0"), (key % 9 + 1).cast("string"), F.lit("T00:00:00Z")))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("start-"), key.cast("string")).alias("bundle_id"), preset.alias("preset"), stamp.alias("timestamp"))
    return templates.presets(rows)


def queries() -> dict[str, Query]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
