"""Documents to parsed rows: decoding, structure (structure.py), and what the fields of the frontmatter say, as Column expressions over its entries."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicker.functions import paths
from wicker.functions.dates import explicit_zone_epoch
from wicker.functions.text import actor_ok
from wicker.operators.structure import COLUMNS, with_structure

#: Concept fields that are texts, and the columns they become.
TEXTS = {"type": "type", "title": "title", "description": "description", "resource": "resource", "timestamp": "timestamp", "status": "status", "runtime": "runtime", "computation": "computation", "stale_after": "stale_after", "okf_version": "declared_version"}


def at(pointer: Column | str) -> Column:
    """The entry (kind, value, tag, size, range) under a pointer like /sources/0/id, or null; needs the column fields."""
    return F.try_element_at("fields", F.lit(pointer) if isinstance(pointer, str) else pointer)


def entry_has(entry: Column, key: str) -> Column:
    """The mapping under a pointer has this key."""
    return at(F.concat(entry, F.lit(f"/{key}"))).isNotNull()


def entry_text(entry: Column, key: str) -> Column:
    """The text under a key of the mapping under a pointer; null where there is none or it is no text."""
    return text_of(at(F.concat(entry, F.lit(f"/{key}"))))


def text_of(entry: Column) -> Column:
    return F.when(entry["kind"] == "str", entry["value"])


def has_field(name: str) -> Column:
    return at(f"/{name}").isNotNull()


def text_field(name: str) -> Column:
    return text_of(at(f"/{name}"))


def items(entry: Column) -> Column:
    """Pointers of a list's items, in order; empty for anything else."""
    found = at(entry)
    numbers = F.when((found["kind"] == "seq") & (found["size"] > 0), F.sequence(F.lit(0), found["size"] - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.concat(entry, F.lit("/"), k.cast("string")))


def list_field(name: str) -> Column:
    """A list of texts; empty where any element is none."""
    found = F.transform(items(F.lit(f"/{name}")), lambda p: text_of(at(p)))
    return F.when(F.forall(found, lambda x: x.isNotNull()), found).otherwise(F.array().cast("array<string>"))


def mappings(name: str) -> Column:
    """Pointers of the mappings that a field holds, alone or in a list; null for an element that is none, or for a field that is neither."""
    own = F.lit(f"/{name}")
    kind = at(own)["kind"]
    listed = F.transform(items(own), lambda p: F.when(at(p)["kind"] == "map", p))
    return F.when(kind == "seq", listed).when(kind == "map", F.array(own)).otherwise(F.array(F.lit(None).cast("string")))


def decode(docs: DataFrame) -> DataFrame:
    """Adds path (canonical), source (the text as it is), and failure (read or decode; null where sound). The second and later of one path fail as read, and so do names that are only an ending."""
    path = paths.canonical_path(F.col("bundle_path"))
    rows = docs.withColumn("path", path).withColumn("sound", F.is_valid_utf8(F.col("content").cast("string")))
    nth = F.row_number().over(Window.partitionBy("bundle_id", "path").orderBy("uri"))
    rows = rows.where("bundle_path LIKE '%.md'").withColumn("nth", nth).withColumn("source", F.when(F.col("sound"), F.col("content").cast("string")))
    unread = F.col("path").isNull() | (F.col("nth") > 1) | (paths.base_name(F.col("path")) == ".md")
    failure = F.when(unread, "read").when(~F.col("sound") | F.col("source").startswith("\ufeff\ufeff"), "decode")
    return rows.withColumn("failure", failure).withColumn("source", F.when(F.col("failure").isNull(), F.col("source"))).drop("sound", "nth", "content")


def parse(docs: DataFrame, made: Collection[str] = COLUMNS) -> DataFrame:
    """One row per document: bundle_id, uri, path, id, reserved (index, log or null), failure, structure's columns, and the normalised fields.

    failure is read, decode, frontmatter or resource-limit, with fault_message and fault_range; the document's structure
    is empty then. made: structure's columns that are given, fields and fault among them.
    """
    rows = decode(docs).withColumns({"id": paths.concept_id(F.col("path")), "reserved": paths.reserved_kind(F.col("path"))})
    rows = with_structure(rows.select(*[c for c in rows.columns if c != "bundle_path"]), made=made)
    rows = rows.withColumn("failure", F.coalesce("failure", "fault")).drop("fault")
    rows = rows.withColumns({column: text_field(name) for name, column in TEXTS.items()})
    verified = F.when(has_field("verified"), F.transform(mappings("verified"), lambda e: F.struct(entry_text(e, "by").alias("by"), entry_text(e, "at").alias("at"))))
    rows = rows.withColumns({"tags": list_field("tags"), "generated_by": entry_text(F.lit("/generated"), "by"), "generated_at": entry_text(F.lit("/generated"), "at"), "verified": verified})
    sound = F.filter(F.coalesce("verified", F.array().cast("array<struct<by:string,at:string>>")), event_ok)
    tier = F.when(F.exists(sound, lambda e: e["by"].startswith("human:")), "human-reviewed").when(F.size(sound) > 0, "machine-confirmed").otherwise("unverified")
    return rows.withColumn("trust_tier", tier)


def outline(docs: DataFrame) -> DataFrame:
    """bundle_id, uri, path, id, reserved, failure, type, title as parse gives them. Every document is read whole, but no more than this is kept of it."""
    rows = decode(docs).withColumns({"id": paths.concept_id(F.col("path")), "reserved": paths.reserved_kind(F.col("path"))})
    named = ["bundle_id", "uri", "path", "id", "reserved", "failure"]
    rows = with_structure(rows.select(*named, "source"), made=("fields", "fault"), carried=named)
    return rows.select(*named[:-1], F.coalesce("failure", "fault").alias("failure"), text_field("type").alias("type"), text_field("title").alias("title"))


def event_ok(event: Column) -> Column:
    """A verification counts with a sound actor and a date-time with an explicit zone."""
    return F.coalesce(actor_ok(event["by"]) & explicit_zone_epoch(event["at"]).isNotNull(), F.lit(False))


def concepts(parsed: DataFrame) -> DataFrame:
    """Documents that are concepts, failed ones (partial) included."""
    return parsed.where("path IS NOT NULL AND reserved IS NULL AND coalesce(failure, '') <> 'read'")


def headings(parsed: DataFrame) -> DataFrame:
    """bundle_id, path, nth, level, heading, range: headings outside code, in quotes and lists too."""
    each = parsed.select("bundle_id", "path", F.posexplode("heads").alias("nth", "h"))
    return each.select("bundle_id", "path", "nth", F.col("h.level").alias("level"), F.col("h.text").alias("heading"), F.col("h.range").alias("range"))


def fence_count(heading: str) -> Column:
    """Fenced code blocks in the sections of first-level headings with this text; needs the columns heads and code."""
    tops = F.filter("heads", lambda h: h["level"] == 1)
    above = lambda c: F.try_element_at(F.filter(tops, lambda h: h["range"]["start"] < c["start"]), F.lit(-1))
    return F.size(F.filter("code", lambda c: c["fenced"] & F.coalesce(above(c)["text"] == heading, F.lit(False))))


def links(parsed: DataFrame) -> DataFrame:
    """bundle_id, source_id, path, uri, nth (order in the document), label, raw_target, range; every occurrence counts."""
    sound = parsed.where("failure IS NULL AND reserved IS NULL")
    each = sound.select("bundle_id", F.col("id").alias("source_id"), "path", "uri", F.posexplode("marks").alias("nth", "l"))
    return each.select("bundle_id", "source_id", "path", "uri", "nth", F.col("l.label").alias("label"), F.col("l.target").alias("raw_target"), F.col("l.range").alias("range"))


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.where("failure IS NOT NULL").select("bundle_id", "uri", "path", F.col("failure").alias("reason"), F.col("fault_message").alias("message"), F.col("fault_range").alias("range"))
