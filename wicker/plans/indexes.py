"""Index documents: which directories need one, their entries, and whether it is created, updated, left or refused.

A directory may hold any number of entries, so an index file is planned as pieces: what stands before the managed lines,
the lines in numbered chunks, and what stands after. A sink that writes pieces in order writes the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.paths import base_name, directory_name, encode_segment
from wicker.functions.text import escape_label, fallback_title, one_line, utf16_cut, utf16_key
from wicker.operators.parse import at, concepts, text_field
from wicker.operators.running import running
from wicker.operators.structure import with_structure

#: Lines around the managed region; a caller with documents that hold other markers names those.
START, END = "<!-- index:start -->", "<!-- index:end -->"
#: Entries of a chunk.
LINES = 10_000
#: Line ends, longest first.
EOL = r"\r\n|\n|\r"


def directories(parsed: DataFrame) -> DataFrame:
    """bundle_id, directory: every ancestor of a concept, and those of index documents."""
    held = parsed.where("path IS NOT NULL AND (reserved IS NULL OR reserved = 'index')").select("bundle_id", F.split("path", "/").alias("parts"))
    return held.select("bundle_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))).alias("directory")).distinct()


def _concept_line(path: Column, title: Column, description: Column) -> Column:
    name = F.coalesce(F.nullif(one_line(title), F.lit("")), fallback_title(base_name(path)))
    note = F.coalesce(one_line(description), F.lit(""))
    return F.concat(F.lit("- ["), escape_label(name), F.lit("](./"), encode_segment(base_name(path)), F.lit(")"), F.when(note != "", F.concat(F.lit(" - "), escape_label(note))).otherwise(""))


def entries(parsed: DataFrame) -> DataFrame:
    """bundle_id, directory, kind (0 concept, 1 folder), name, line: one row per entry."""
    own = concepts(parsed).select("bundle_id", directory_name(F.col("path")).alias("directory"), F.lit(0).alias("kind"), base_name(F.col("path")).alias("name"), _concept_line(F.col("path"), F.col("title"), F.col("description")).alias("line"))
    below = directories(parsed).where("directory <> ''").withColumn("name", base_name(F.col("directory")))
    line = F.concat(F.lit("- ["), escape_label(one_line(F.col("name"))), F.lit("](./"), encode_segment(F.col("name")), F.lit("/)"))
    return own.unionByName(below.select("bundle_id", directory_name(F.col("directory")).alias("directory"), F.lit(1).alias("kind"), "name", line.alias("line")))


def chunked(parsed: DataFrame, lines: int = LINES) -> DataFrame:
    """bundle_id, directory, chunk (from 0), text: the entries' lines in order, at most `lines` of them a row."""
    key = F.concat(F.encode(F.col("kind").cast("string"), "UTF-8"), utf16_key(F.col("name")))
    placed = running(entries(parsed), ["bundle_id", "directory"], key, {"nth": F.lit(1).cast("long")})
    chunk = F.floor((F.col("nth") - 1) / lines).cast("int")
    gathered = placed.groupBy("bundle_id", "directory", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("nth", "line"))).alias("all"))
    return gathered.select("bundle_id", "directory", "chunk", F.concat(F.array_join(F.transform("all", lambda e: e["line"]), "\n"), F.lit("\n")).alias("text"))


def _first_eol(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, f"({EOL})", 1), F.lit("")), F.lit("\n"))


def versioned(roots: DataFrame, version: str = "0.2") -> DataFrame:
    """bundle_id, prepared (the root index's text with a version declared, all else as it was) and problem, of root indexes (parsed rows).

    A missing declaration goes before the first field of a block mapping, at its indentation, or behind the opening brace
    of a flow mapping, with the line ends in use; without frontmatter one is put in front. What comes out is parsed again
    and refused unless it says the version; so is a root that cannot be read.
    """
    said = f'okf_version: "{version}"'
    root, source = at(""), F.col("source")
    bom = F.when(source.startswith("﻿"), "﻿").otherwise("")
    body = F.regexp_replace(source, r"^\x{FEFF}", "")
    eol = _first_eol(body)
    whole = F.concat(bom, F.lit("---"), eol, F.lit(said), eol, F.lit("---"), eol, body)
    before, after = utf16_cut(body, root["range"]["start"])
    indent = F.repeat(F.lit(" "), root["range"]["character"])
    blocked = F.concat(bom, before, F.lit(said), _first_eol(after), indent, after)
    inside = F.substring(after, F.lit(2), F.length(after))
    kept = F.regexp_extract(inside, r"(?s)^(.*?)\}", 1)
    mark = F.when(F.length(F.trim(F.regexp_replace(kept, r"[\t\r\n]", " "))) == 0, "").when(inside.startswith("#"), ", ").otherwise(",")
    flowed = F.concat(bom, before, F.lit("{" + said), mark, inside)
    prepared = F.when(at("/okf_version").isNotNull(), source).when(F.col("front").isNull(), whole).when(after.startswith("{"), flowed).otherwise(blocked)
    made = roots.select("bundle_id", F.when(F.col("failure").isNull(), prepared).alias("source"), F.lit("index").alias("reserved"), (F.col("failure").isNull() & at("/okf_version").isNotNull()).alias("had"))
    again = with_structure(made)
    sound = F.col("had") | (F.col("fault").isNull() & F.coalesce(text_field("okf_version") == version, F.lit(False)))
    return again.select("bundle_id", F.when(sound, F.col("source")).alias("prepared"), F.when(~sound, "root-version-synthesis-refused").alias("problem"))


def merged(text: Column, start: str, end: str) -> Column:
    """struct(problem, before, after, newline): where a managed region goes in a text. Markers are one pair of whole lines; without any, it is appended after a blank line."""
    lines = F.split(F.regexp_replace(text, r"^\x{FEFF}", ""), EOL)
    count = lambda marker: F.size(F.filter(lines, lambda x: x == marker))
    starts, ends = count(start), count(end)
    problem = (
        F.when((starts == 0) & (ends == 0), F.lit(None).cast("string")).when((starts > 1) | (ends > 1), "managed-region-duplicate-markers")
        .when((starts == 0) | (ends == 0), "managed-region-incomplete-markers").when(F.array_position(lines, start) > F.array_position(lines, end), "managed-region-reversed-markers")
    )
    opening = rf"(?s)^(\x{{FEFF}}?|\x{{FEFF}}?.*?(?:{EOL}))\Q{start}\E({EOL})"
    closing = rf"(?s)(?:^\x{{FEFF}}?|[\r\n])\Q{end}\E(?:(?:{EOL})(.*))?\z"
    eol = _first_eol(text)
    gap = F.when((F.length(text) == 0) | text.rlike(r"(?:\n\n|\r\n\r\n|\r\r)\z"), "").when(text.rlike(r"[\r\n]\z"), eol).otherwise(F.concat(eol, eol))
    none = starts == 0
    return F.struct(
        problem.alias("problem"), F.when(none, F.concat(text, gap)).otherwise(F.regexp_extract(text, opening, 1)).alias("before"),
        F.when(none, "").otherwise(F.coalesce(F.regexp_extract(text, closing, 1), F.lit(""))).alias("after"), F.when(none, eol).otherwise(F.regexp_extract(text, opening, 2)).alias("newline"),
    )


def plan(parsed: DataFrame, start: str = START, end: str = END, version: str = "0.2", missing_only: bool = False, chunks: DataFrame | None = None, bundles: DataFrame | None = None) -> DataFrame:
    """bundle_id, directory, path, operation (create, update, keep, refuse), problem, newline, opening, closing, fills.

    The file is opening, then the directory's chunks where fills, then closing. Existing text changes only between its
    markers and, in a root index, by a missing version. With missing_only, existing indexes get nothing but that version.
    Pass chunks (chunked(parsed)) where they are at hand, and bundles (bundle_id) where some may have no document yet: each
    gets a root index.
    """
    chunks = chunked(parsed) if chunks is None else chunks
    existing = parsed.where("reserved = 'index' AND coalesce(failure, '') NOT IN ('read', 'decode')")
    roots = versioned(existing.where("path = 'index.md'"), version).select("bundle_id", F.lit("").alias("directory"), "prepared", F.col("problem").alias("refusal"))
    old = existing.select("bundle_id", directory_name(F.col("path")).alias("directory"), F.col("source").alias("old"))
    wanted = directories(parsed)
    if bundles is not None:
        wanted = wanted.unionByName(bundles.select("bundle_id", F.lit("").alias("directory"))).distinct()
    rows = wanted.join(old, ["bundle_id", "directory"], "left").join(roots, ["bundle_id", "directory"], "left")
    base = F.coalesce("prepared", "old")
    rows = rows.withColumn("m", F.when(base.isNotNull(), merged(base, start, end)))
    fills = F.lit(True) if not missing_only else F.col("old").isNull()
    problem = F.coalesce("refusal", F.when(fills, F.col("m.problem")))
    newline = F.coalesce("m.newline", F.lit("\n"))
    head = F.when(F.col("old").isNotNull(), F.col("m.before")).otherwise(F.when(F.col("directory") == "", f'---\nokf_version: "{version}"\n---\n').otherwise(""))
    opening = F.when(fills, F.concat(head, F.lit(start), newline, F.lit("## Contents"), newline, newline)).otherwise(base)
    closing = F.when(fills, F.concat(F.lit(end), newline, F.coalesce("m.after", F.lit("")))).otherwise("")
    rows = rows.select("bundle_id", "directory", "old", problem.alias("problem"), newline.alias("newline"), opening.alias("opening"), closing.alias("closing"), fills.alias("fills"))
    # Only texts of the size that the old one has can equal it, and only their chunks are put together.
    wide = F.octet_length("newline") - 1
    measured = chunks.withColumn("size", F.octet_length("text").cast("long")).withColumn("n", F.length("text") - F.length(F.replace("text", F.lit("\n"))))
    total = measured.groupBy("bundle_id", "directory").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    sized = rows.join(total, ["bundle_id", "directory"], "left")
    added = F.when(F.col("fills"), F.coalesce("size", F.lit(0)) + wide * F.coalesce("n", F.lit(0))).otherwise(0)
    alike = sized.where("old IS NOT NULL").withColumn("added", added).where(F.octet_length("opening") + F.octet_length("closing") + F.col("added") == F.octet_length("old"))
    inner = alike.where("fills").select("bundle_id", "directory", "newline").join(chunks, ["bundle_id", "directory"]).groupBy("bundle_id", "directory", "newline").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "").alias("lines"))
    inner = inner.select("bundle_id", "directory", F.replace("lines", F.lit("\n"), F.col("newline")).alias("lines"))
    same = alike.join(inner, ["bundle_id", "directory"], "left").where(F.concat("opening", F.coalesce("lines", F.lit("")), "closing") == F.col("old")).select("bundle_id", "directory", F.lit(True).alias("same"))
    operation = F.when(F.col("problem").isNotNull(), "refuse").when(F.col("old").isNull(), "create").when(F.col("same").isNotNull(), "keep").otherwise("update")
    path = F.when(F.col("directory") == "", "index.md").otherwise(F.concat("directory", F.lit("/index.md")))
    return rows.join(same, ["bundle_id", "directory"], "left").select("bundle_id", "directory", path.alias("path"), operation.alias("operation"), "problem", "newline", "opening", "closing", "fills")


def pieces(planned: DataFrame, chunks: DataFrame) -> DataFrame:
    """bundle_id, path, operation, piece (from 0), text of the files to write: created and updated ones."""
    wanted = planned.where("operation IN ('create', 'update')")
    last = chunks.groupBy("bundle_id", "directory").agg((F.max("chunk") + 2).alias("last"))
    out = lambda df, piece, text: df.select("bundle_id", "path", "operation", piece.cast("int").alias("piece"), text.alias("text"))
    opening = out(wanted, F.lit(0), F.col("opening"))
    lines = wanted.where("fills").join(chunks, ["bundle_id", "directory"])
    closing = out(wanted.join(last, ["bundle_id", "directory"], "left"), F.when(F.col("fills"), F.coalesce("last", F.lit(1))).otherwise(1), F.col("closing"))
    return opening.unionByName(out(lines, F.col("chunk") + 1, F.replace("text", F.lit("\n"), F.col("newline")))).unionByName(closing)


def texts(pieces_: DataFrame) -> DataFrame:
    """bundle_id, path, operation, text: whole files, for bundles whose indexes fit a row each."""
    gathered = pieces_.groupBy("bundle_id", "path", "operation").agg(F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("all"))
    return gathered.select("bundle_id", "path", "operation", F.array_join(F.transform("all", lambda p: p["text"]), "").alias("text"))


def refused(planned: DataFrame) -> DataFrame:
    """bundle_id, problems: bundles that get no index at all, as one of theirs is refused; the first eight paths and codes."""
    found = planned.where("operation = 'refuse'")
    return found.groupBy("bundle_id").agg(F.slice(F.sort_array(F.collect_set(F.concat_ws(": ", "path", "problem"))), 1, 8).alias("problems"))


def in_order(planned: DataFrame) -> DataFrame:
    return planned.orderBy("bundle_id", F.size(F.split("path", "/")), utf16_key(F.col("path")))
