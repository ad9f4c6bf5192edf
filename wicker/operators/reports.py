"""What leaves the engine about findings and bundles: envelopes, lines, diagnostics, refusals, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.text import utf16_key, wide_trim
from wicker.operators.parse import concepts
from wicker.operators.running import running, running_distinct

#: The order of finding categories.
CATEGORIES = ("conformance", "curation", "compatibility")
#: Fixed value: documents that a bundle may hold.
MOST_DOCUMENTS = 2000


def category_rank(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category) - 1


def ordered(found: DataFrame) -> DataFrame:
    """Findings by uri, place (those without one last), category, code and subject, as UTF-16 orders text."""
    place = lambda end: F.coalesce(F.col(f"range.{end}"), F.lit((1 << 31) - 1))
    places = [place("start"), place("end")] if "range" in found.columns else []
    return found.orderBy("bundle_id", utf16_key(F.col("uri")), *places, category_rank(F.col("category")), utf16_key(F.col("code")), utf16_key(F.col("subject")))


def envelope(result: Column, command: str, version: int = 1) -> Column:
    """JSON text {schemaVersion, command, result} of a struct or array."""
    return F.to_json(F.struct(F.lit(version).alias("schemaVersion"), F.lit(command).alias("command"), result.alias("result")))


def lines(found: DataFrame) -> DataFrame:
    """bundle_id, uri, line: one readable line a finding."""
    subject = F.when(F.col("subject") != "", F.concat(F.lit(" ("), "subject", F.lit(")"))).otherwise("")
    return found.select("bundle_id", "uri", F.concat_ws(" ", F.upper("severity"), "code", F.concat("uri", subject)).alias("line"))


def verdicts(found: DataFrame) -> DataFrame:
    """bundle_id, findings, exit_code: 1 with any conformance finding."""
    return found.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("findings"), F.max((F.col("category") == "conformance").cast("int")).alias("exit_code"))


def diagnostics(found: DataFrame, hidden: str) -> DataFrame:
    """bundle_id, uri, diagnostics: the findings of each document in order, without those of the hidden code; a document's findings are bounded by its links and fields."""
    rows = found.where(F.col("code") != hidden)
    item = F.struct(category_rank(F.col("category")).alias("rank"), "code", "subject", "severity")
    each = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["severity"].alias("severity"), x["code"].alias("code"), x["subject"].alias("subject")))
    return rows.groupBy("bundle_id", "uri").agg(each.alias("diagnostics"))


def refused(docs: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """bundle_id, documents of the bundles that hold more documents than allowed."""
    return docs.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > most)


def root_class(parsed: DataFrame, known: tuple[str, ...] = ("0.1", "0.2")) -> DataFrame:
    """bundle_id, version, verdict (supported, future-minor, unsupported, undeclared, failed), label (the title in the root's frontmatter) of each bundle with a root index."""
    roots = parsed.where("path = 'index.md'")
    version = F.coalesce("declared_version", F.lit(""))
    minor = F.ltrim(F.regexp_extract(version, r"^0+\.(\d+)$", 1), F.lit("0"))
    newest = max(int(v.split(".")[1]) for v in known)
    future = version.rlike(r"^0+\.\d+$") & ((F.length(minor) > len(str(newest))) | ((F.length(minor) == len(str(newest))) & (minor > str(newest))))
    verdict = F.when(F.col("failure").isNotNull(), "failed").when(version == "", "undeclared").when(version.isin(*known), "supported").when(future, "future-minor").otherwise("unsupported")
    label = F.nullif(wide_trim(F.col("title")), F.lit(""))
    return roots.select("bundle_id", F.col("declared_version").alias("version"), verdict.alias("verdict"), label.alias("label"))


def budgets(nodes: DataFrame, edges: DataFrame, broken: DataFrame) -> DataFrame:
    """bundle_id and what its graph would weigh: nodes, edges, broken links, types, tags, tag_uses, and json_bytes of nodes and edges as JSON lines."""
    weigh = lambda *names: F.octet_length(F.to_json(F.struct(*names))).cast("long") + 1
    per_node = nodes.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("type").alias("types"), F.sum(F.size("tags")).alias("tag_uses"), F.sum(weigh("id", "type", "title", "description", "resource", "tags")).alias("node_bytes"))
    tags = nodes.select("bundle_id", F.explode("tags").alias("tag")).groupBy("bundle_id").agg(F.count_distinct("tag").alias("tags"))
    per_edge = edges.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(weigh("edge_id", "source", "target")).alias("edge_bytes"))
    per_broken = broken.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("broken"))
    joined = per_node.join(tags, "bundle_id", "left").join(per_edge, "bundle_id", "left").join(per_broken, "bundle_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("bundle_id", "nodes", none("edges"), none("broken"), "types", none("tags"), "tag_uses", (F.col("node_bytes") + F.coalesce("edge_bytes", F.lit(0))).alias("json_bytes"))


def type_growth(parsed: DataFrame) -> DataFrame:
    """bundle_id, path, types: the different types up to and with each concept, in order of path."""
    rows = concepts(parsed).where("failure IS NULL").select("bundle_id", "path", F.nullif("type", F.lit("")).alias("type"))
    return running_distinct(rows, ["bundle_id"], utf16_key(F.col("path")), "type", "types").select("bundle_id", "path", "types")


def vocabulary_growth(parsed: DataFrame) -> DataFrame:
    """bundle_id, path, types, bytes: the different types and the bytes of text up to and with each concept, in order of path."""
    rows = concepts(parsed).where("failure IS NULL").select("bundle_id", "path", F.nullif("type", F.lit("")).alias("type"), F.octet_length("source").cast("long").alias("size"))
    key = utf16_key(F.col("path"))
    return running(running_distinct(rows, ["bundle_id"], key, "type", "types"), ["bundle_id"], key, {"bytes": F.col("size")}).select("bundle_id", "path", "types", "bytes")
