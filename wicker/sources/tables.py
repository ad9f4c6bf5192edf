"""Adapters that write relational tables as documents of one bundle, so that every operator runs on tables of any size.

Each row of region, nation, supplier, customer, part and orders becomes a Markdown document with frontmatter and links;
some rows carry defects by the remainder of their key. Collecting an order's parts is the only grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.functions.paths import encode_segment

BUNDLE = "tables"


def _document(path: Column, fields: list[tuple[str, Column]], body: Column) -> list[Column]:
    lines = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("") for name, value in fields]
    text = F.concat(F.lit("---\n"), *lines, F.lit("---\n\n"), body, F.lit("\n"))
    return [F.lit(BUNDLE).alias("bundle_id"), F.concat(F.lit("mem://tables/"), path).alias("uri"), path.alias("bundle_path"), F.encode(text, "UTF-8").alias("content")]


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _link(label: str, target: Column) -> Column:
    return F.concat(F.lit(f"[{label}]("), target, F.lit(")"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents(bundle_id, uri, bundle_path, content) of the six tables, plus the root index."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda c: F.col(c).cast("string")
    nation_at = lambda prefix: F.concat(F.lit(prefix), encode_segment(F.col("n_name")), F.lit(".md"))
    nations, regions = table("nation"), table("region")
    region = regions.select(*_document(F.concat(F.lit("region/"), "r_name", F.lit(".md")), [("type", F.lit("region")), ("title", _quoted(F.col("r_name"))), ("tags", F.lit("[geo]")), ("description", F.lit("A region of the world."))], F.concat(F.lit("# "), "r_name")))
    nation = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(*_document(F.concat(F.lit("nation/"), "n_name", F.lit(".md")), [("type", F.lit("nation")), ("title", _quoted(F.col("n_name"))), ("tags", F.lit("[geo]"))], F.concat(F.lit("# "), "n_name", F.lit("\n\n"), _link("region", F.concat(F.lit("../region/"), encode_segment(F.col("r_name")), F.lit(".md#top"))))))
    supplier = table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(*_document(F.concat(F.lit("supplier/"), text("s_suppkey"), F.lit(".md")), [("type", F.when(F.col("s_suppkey") % 7 != 0, "supplier")), ("title", _quoted(F.col("s_name"))), ("status", F.when(F.col("s_suppkey") % 5 == 0, "retired").when(F.col("s_suppkey") % 3 == 0, "draft")), ("generated", F.when(F.col("s_suppkey") % 4 == 0, "{by: process:loader, at: 2026-07-01T00:00:00Z}"))], F.concat(F.lit("Based in "), _link("nation", nation_at("/nation/")))))
    customer = table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(*_document(F.concat(F.lit("customer/"), "c_mktsegment", F.lit("/"), text("c_custkey"), F.lit(".md")), [("type", F.lit("customer")), ("title", F.when(F.col("c_custkey") % 61 == 0, '""').otherwise(_quoted(F.col("c_name")))), ("tags", F.concat(F.lit("["), "c_mktsegment", F.lit("]"))), ("verified", F.when(F.col("c_custkey") % 10 == 0, "{by: human:ann, at: 2026-07-01T00:00:00Z}").when(F.col("c_custkey") % 10 == 5, "{by: process:check, at: 2026-07-01T00:00:00Z}").when(F.col("c_custkey") % 10 == 3, "\n  - by: process:check\n    at: 2026-07-01T00:00:00Z\n  - {by: human:ann, at: 2026-07-02T00:00:00Z}").when(F.col("c_custkey") % 10 == 7, "{by: process:check}")), ("stale_after", F.when(F.col("c_custkey") % 13 == 0, "2026-01-31").when(F.col("c_custkey") % 17 == 0, "2026-02-31"))], F.concat(F.lit("Lives in "), _link("home nation", nation_at("../../nation/")))))
    part = table("part").select(*_document(F.concat(F.lit("part/"), text("p_partkey"), F.lit(".md")), [("type", F.col("p_type")), ("title", _quoted(F.col("p_name"))), ("description", F.concat(F.lit("Part of brand "), "p_brand")), ("resource", F.concat(F.lit("urn:brand:"), "p_brand")), ("tags", F.concat(F.lit("["), "p_brand", F.lit(", size-"), text("p_size"), F.lit("]")))], F.concat(F.lit("## Size\n\n`"), text("p_size"), F.lit("` ![image](./none.png)"))))
    lines = table("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    key = F.col("o_orderkey")
    defect = F.concat(*[F.when(key % n == 0, F.lit(f"\n\n[odd]({target})")).otherwise("") for n, target in ((97, "./missing.md"), (89, "../../../outside.md"), (83, "https://example.com/a?b#c"), (79, "#frag"), (73, "../"), (71, "./%zz.md"))])
    parts = F.transform(F.coalesce("lines", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>")), lambda x: F.concat(F.lit("- [part](/part/"), x["l_partkey"].cast("string"), F.lit(".md)\n")))
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    to = F.concat(F.lit("/customer/"), encode_segment(F.col("c_mktsegment")), F.lit("/"), text("c_custkey"), F.lit(".md?from=order"))
    orders = table("orders").join(table("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(lines, key == F.col("l_orderkey"), "left")
    order = orders.select(*_document(F.concat(F.lit("order/"), "o_orderpriority", F.lit("/"), text("o_orderkey"), F.lit(".md")), [("type", F.lit("order")), ("title", F.concat(F.lit('"Order '), text("o_orderkey"), F.lit('"'))), ("tags", F.concat(F.lit("["), "o_orderstatus", F.lit("]"))), ("timestamp", stamp)], F.concat(_link("customer", to), F.lit("\n\n"), F.array_join(parts, ""), defect)))
    index = spark.range(1).select(*_document(F.lit("index.md"), [("okf_version", F.lit('"0.2"'))], F.lit("# Tables")))
    return reduce(DataFrame.unionByName, [region, nation, supplier, customer, part, order, index])


def nation_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bundle per nation: a root index that declares a version by the nation's key (or none, or is broken), a hub, and a document per supplier, every third of which links to nothing."""
    nations, suppliers = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("n_nationkey")
    of, number = F.concat(F.lit("nation-"), key.cast("string")), F.col("s_suppkey").cast("string")

    def rows(df: DataFrame, name: Column, fields: list[tuple[str, Column]], body: Column) -> DataFrame:
        return df.select(of.alias("bundle_id"), F.concat(F.lit("mem://"), of, F.lit("/"), name).alias("uri"), F.concat(name, F.lit(".md")).alias("bundle_path"), *_document(name, fields, body)[3:])

    version = F.when(key % 5 == 0, "'0.1'").when(key % 5 == 1, "!!str 0.2").when(key % 5 == 2, '&v "0.7"').when(key % 5 == 3, "1.0")
    title = F.when(key % 3 == 0, F.concat(F.lit(">-\n  Suppliers\n  of "), "n_name")).when(key % 3 == 1, F.concat(F.lit('"\\u0053uppliers of '), "n_name", F.lit('"')))
    index = rows(nations, F.lit("index"), [("okf_version", version), ("title", title), ("note", F.when(key % 7 == 6, "[open"))], F.lit("# A heading, which is no title"))
    body = F.when(F.col("s_suppkey") % 3 != 0, "> - [self *and* hub](<./hub.md>)\n\n      [code](./hub.md)").otherwise("\\[not a link](./hub.md) `[nor](./hub.md)`")
    held = rows(suppliers.join(nations, F.col("s_nationkey") == key), number, [("type", F.lit("supplier"))], body)
    return index.unionByName(held).unionByName(rows(nations, F.lit("hub"), [("type", F.lit("hub"))], F.lit("A hub")))


#: What notes() writes: the frontmatter by key modulo 8, and the body by size modulo 10. NAME and BRAND stand for the part's own.
NOTE_FRONTS = (
    "tags: [\"BRAND, first\", second, 'it''s']", "description: >\n  Part\n  of\n\n  BRAND", '"status": draft', 'title: "Caf\\u00e9\\tNAME"', "seed: &b BRAND\nresource: *b", "bad: [BRAND", "? bad\n: BRAND\nbad: again", "description: |-\n  NAME\n    more\n  # no comment",
)
NOTE_BODIES = (
    "\\[no](./x.md) [yes](./NAME.md)", "[one [two] three](./a.md)", "[p](./x(1).md)", "    [code](./a.md)", "<div>\n[raw](./a.md)\n</div>\n\n[after](./b.md)", "[e](./a&amp;b.md)", "```\n[in](./a.md)\n```\n[out][r]\n\n[R]: ./c.md 'title'", "`[x](./a.md)` ![i [j](./k.md)](./l.md)", "😀 [wide **label**](./w.md \"t\")", "- > [in\n  > list](./m.md)",
)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per part, in forms of YAML and Markdown that simple readers get wrong; every thirteenth has CRLF line ends."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    name, key = F.concat(F.lit("p"), F.col("p_size").cast("string")), F.col("p_partkey").cast("string")
    said = lambda forms, by: F.replace(F.replace(F.array(*map(F.lit, forms))[by.cast("int")], F.lit("NAME"), name), F.lit("BRAND"), F.col("p_brand"))
    text = F.concat(F.lit("---\ntype: note\n"), said(NOTE_FRONTS, F.col("p_partkey") % 8), F.lit("\n---\n\n"), said(NOTE_BODIES, F.col("p_size") % 10), F.lit("\n"))
    text = F.when(F.col("p_partkey") % 13 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return parts.select(F.lit("notes").alias("bundle_id"), F.concat(F.lit("mem://notes/"), key).alias("uri"), F.concat(key, F.lit(".md")).alias("bundle_path"), F.encode(text, "UTF-8").alias("content"))
