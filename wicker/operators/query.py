"""Queries over graph nodes: search, filters, folders, details, vocabulary, order, budgets, summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions.paths import folder_of, in_folder
from wicker.functions.text import search_form, utf16_key
from wicker.operators.running import running


@dataclass(frozen=True)
class View:
    """What is selected: text, types, tags, folder (None: all; '': the root level only)."""

    text: str = ""
    types: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    folder: str | None = None


def matches(text: str, form: Column) -> Column:
    """Every term of the text stands in one of the values that form (search_form of them, joined by NUL) holds."""
    import unicodedata

    terms = unicodedata.normalize("NFKC", text).lower().split()
    return F.forall(F.array(*map(F.lit, terms)), lambda t: F.exists(F.split(form, "\x00"), lambda v: F.contains(v, t))) if terms else F.lit(True)


def visible(node_rows: DataFrame, view: View) -> DataFrame:
    rows = node_rows
    if view.types:
        rows = rows.where(F.col("type").isin(view.types))
    if view.tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, view.tags))))
    if view.folder is not None:
        rows = rows.where(in_folder(F.col("id"), view.folder))
    # The search runs Python, so it comes after what the scan can do.
    if not view.text.split():
        return rows
    joined = F.concat_ws("\x00", "id", "title", F.array_join("tags", "\x00"))
    return rows.withColumn("_form", search_form(joined)).where(matches(view.text, F.col("_form"))).drop("_form")


def ordered(node_rows: DataFrame) -> DataFrame:
    return node_rows.orderBy(utf16_key(F.coalesce("title", "id")), utf16_key(F.col("id")))


def folders(node_rows: DataFrame) -> DataFrame:
    """bundle_id, folder, parent, label, depth, direct, descendants of every folder that holds a node, the root ('') too."""
    own = node_rows.select("bundle_id", folder_of(F.col("id")).alias("folder")).groupBy("bundle_id", "folder").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    spread = own.select("bundle_id", F.col("folder").alias("own"), "n", F.explode(above).alias("folder"))
    total = spread.groupBy("bundle_id", "folder").agg(F.sum(F.when(F.col("own") == F.col("folder"), F.col("n")).otherwise(0)).alias("direct"), F.sum("n").alias("descendants"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    parent = F.when(F.col("folder") != "", F.regexp_replace("folder", "/?[^/]+$", ""))
    return total.select("bundle_id", "folder", parent.alias("parent"), F.regexp_extract("folder", "[^/]*$", 0).alias("label"), depth.alias("depth"), "direct", "descendants")


def sidebar(node_rows: DataFrame, by_uri: DataFrame) -> DataFrame:
    """Folders with concept counts and the errors and warnings of everything below them."""
    joined = node_rows.join(by_uri, ["bundle_id", "uri"], "left")
    parts = F.split("id", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    spread = joined.select("bundle_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), F.explode(above).alias("folder"))
    return spread.groupBy("bundle_id", "folder").agg(F.count(F.lit(1)).alias("concepts"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))


def vocabulary(node_rows: DataFrame) -> DataFrame:
    types = node_rows.select("bundle_id", F.lit("type").alias("kind"), F.col("type").alias("value"))
    tags = node_rows.select("bundle_id", F.lit("tag").alias("kind"), F.explode("tags").alias("value"))
    return types.unionByName(tags).distinct()


def details(edge_rows: DataFrame, node_rows: DataFrame, broken: DataFrame) -> DataFrame:
    """Per node: outgoing occurrences, distinct targets, distinct backlinks, broken links."""
    out = edge_rows.groupBy("bundle_id", F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("outgoing"), F.count_distinct("target").alias("targets"))
    back = edge_rows.groupBy("bundle_id", F.col("target").alias("id")).agg(F.count_distinct("source").alias("backlinks"))
    odd = broken.groupBy("bundle_id", F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("broken"))
    joined = node_rows.select("bundle_id", "id").join(out, ["bundle_id", "id"], "left").join(back, ["bundle_id", "id"], "left").join(odd, ["bundle_id", "id"], "left")
    return joined.select("bundle_id", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outgoing", "targets", "backlinks", "broken")])


def neighbours(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """Adds next and previous in order, wrapping at the ends of each group."""
    w = Window.partitionBy(*within).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("next", F.coalesce(F.lead(order).over(w), F.first(order).over(whole))).withColumn("previous", F.coalesce(F.lag(order).over(w), F.last(order).over(whole)))


def preserved(before: DataFrame, after: DataFrame, within: list[str], value: str, place: str) -> DataFrame:
    """before (within, value, place) with kept and focus: where an item stands now and what it is; one that is gone gives way to what has its old place, or to the last one. Null where nothing is left. Places count from 0."""
    now = after.select(*within, F.col(value).alias("_value"), F.col(place).alias("_place"))
    same = before.join(now.withColumnRenamed("_value", value), [*within, value], "left")
    ends = after.groupBy(*within).agg((F.count(F.lit(1)) - 1).alias("_last"))
    aimed = same.join(ends, within, "left").withColumn("kept", F.coalesce("_place", F.when(F.col("_last").isNotNull(), F.greatest(F.least(F.col(place), F.col("_last")), F.lit(0)))))
    focused = now.select(*within, F.col("_value").alias("focus"), F.col("_place").alias("kept"))
    return aimed.join(focused, [*within, "kept"], "left").select(*before.columns, "kept", "focus")


def cut_off(rows: DataFrame, limit: int, within: str = "bundle_id", order: str = "path", cost: str = "cost") -> DataFrame:
    """Adds total (running cost) and state: kept, over (the first row whose cost does not fit) or skipped (all after it). Groups are summed by runs, so none is held by one task."""
    run = running(rows, [within], utf16_key(F.col(order)), {"total": F.col(cost)})
    over = F.col("total") > limit
    first = run.where(over).groupBy(F.col(within).alias("_within")).agg(F.min(F.struct(utf16_key(F.col(order)).alias("k"), F.col(order).alias("o")))["o"].alias("_first"))
    joined = run.join(first, F.col(within) == F.col("_within"), "left")
    return joined.select(*run.columns, F.when(~over, "kept").when(F.col(order) == F.col("_first"), "over").otherwise("skipped").alias("state"))


def present(node_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (bundle_id, name) with node_exists (a node has this id) and folder_exists (a node stands below it; the root '' always)."""
    ids = node_rows.select("bundle_id", F.col("id").alias("name")).distinct().withColumn("_node", F.lit(True))
    held = folders(node_rows).select("bundle_id", F.col("folder").alias("name")).withColumn("_folder", F.lit(True))
    joined = wanted.join(ids, ["bundle_id", "name"], "left").join(held, ["bundle_id", "name"], "left")
    return joined.select("bundle_id", "name", F.col("_node").isNotNull().alias("node_exists"), (F.col("_folder").isNotNull() | (F.col("name") == "")).alias("folder_exists"))


def children(node_rows: DataFrame) -> DataFrame:
    """bundle_id, folder, kind (0 folder, 1 node), label, path: what each folder shows, folders first; ordered_children sorts it."""
    below = folders(node_rows).where("folder <> ''").select("bundle_id", F.col("parent").alias("folder"), F.lit(0).alias("kind"), "label", F.col("folder").alias("path"))
    own = node_rows.select("bundle_id", folder_of(F.col("id")).alias("folder"), F.lit(1).alias("kind"), F.coalesce("title", "id").alias("label"), F.col("id").alias("path"))
    return below.unionByName(own)


def ordered_children(rows: DataFrame) -> DataFrame:
    return rows.orderBy("bundle_id", utf16_key(F.col("folder")), "kind", utf16_key(F.col("label")), utf16_key(F.col("path")))


def occurrences(edge_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """bundle_id, source, nth, target, title, again: each outgoing link with its target's title, and how many earlier links of the source go to the same target.

    Rows are numbered within one source and target, which one document bounds.
    """
    titles = node_rows.select("bundle_id", F.col("id").alias("target"), F.coalesce("title", "id").alias("title"))
    again = F.row_number().over(Window.partitionBy("bundle_id", "source", "target").orderBy("nth")) - 1
    return edge_rows.join(titles, ["bundle_id", "target"], "left").select("bundle_id", "source", "nth", "target", "title", again.cast("long").alias("again"))


def toggled(chosen: list[str], value: str) -> list[str]:
    """A selection with one value put in or taken out."""
    return [v for v in chosen if v != value] if value in chosen else [*chosen, value]


def sample_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, least, most, mean and the nearest-rank 95th percentile."""
    return rows.groupBy(*by).agg(F.count(value).alias("count"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
