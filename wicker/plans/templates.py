"""New documents from rows: what was entered is checked, the document is written, and what was written is read again.

A table of entered concepts may have any number of rows; each is checked and written by itself, without a shuffle. Whole
bundles start from a preset: its concepts are written the same way and its indexes planned as for any other bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.paths import base_name, portable_segment, stable_decoded
from wicker.functions.text import description_input, has_text, json_quote, let, one_line, utf16_length
from wicker.operators import parse
from wicker.operators.structure import MOST_BYTES, with_structure
from wicker.plans import indexes
from wicker.sources import store

#: The kinds of concepts, and the lines below each one's frontmatter.
BODIES = {
    "generic-concept": "## Summary\n\nDescribe the durable knowledge captured by this concept.\n\n## Details\n\nAdd relevant context, constraints, and links.\n",
    "decision": "## Status\n\nProposed\n\n## Context\n\nDescribe the forces that require a decision.\n\n## Decision\n\nRecord the chosen direction.\n\n## Consequences\n\nRecord the important trade-offs and follow-up work.\n",
    "metric": "## Definition\n\nDefine what the metric measures and why it matters.\n\n## Calculation\n\nDescribe the formula, dimensions, and source data.\n\n## Interpretation\n\nExplain expected ranges and important caveats.\n",
    "api-endpoint": "## Contract\n\nDocument the method, path, request, and response.\n\n## Authentication\n\nDescribe access requirements without recording secrets.\n\n## Failure modes\n\nList actionable error behavior and retry expectations.\n",
    "data-table": "## Purpose\n\nDescribe the table's business or analytical purpose.\n\n## Grain and keys\n\nRecord row grain, primary keys, and important relationships.\n\n## Columns\n\nDocument important columns and quality constraints.\n",
    "playbook": "## When to use\n\nDescribe the trigger and prerequisites.\n\n## Steps\n\n1. Add the first repeatable step.\n\n## Verification\n\nDescribe how to confirm the procedure succeeded.\n",
    "reference": "## Reference\n\nSummarize the durable information supplied by the referenced resource.\n\n## Relevance\n\nExplain when and why maintainers should consult it.\n",
    "attested-computation": "# Computation\n\n```text\nReplace this fence with the sanctioned computation.\n```\n\n## Contract notes\n\nDocument the runtime, typed parameters, executor receipt, and deterministic attester.\n",
}
#: Fixed value: what a computation's runtime says until someone names it.
RUNTIMES = {"attested-computation": "replace-with-runtime"}
#: The concepts that a preset starts with (path, template, type, title, description, tags).
PRESETS = {
    "minimal": [],
    "software-project": [
        ("project-overview.md", "generic-concept", "project-overview", "Project overview", "The product purpose, users, scope, and important constraints.", ["project", "overview"]),
        ("architecture/system-overview.md", "generic-concept", "architecture", "System overview", "The system boundaries, components, and important data flows.", ["architecture"]),
        ("decisions/initial-context.md", "decision", "decision", "Initial context", "The initial constraints and decisions that shape this project.", ["decision", "context"]),
        ("playbooks/development.md", "playbook", "playbook", "Development", "The repeatable workflow for developing and verifying changes.", ["development", "playbook"]),
    ],
    "data-analytics": [
        ("data-landscape.md", "generic-concept", "data-landscape", "Data landscape", "The important data domains, producers, consumers, and constraints.", ["data", "overview"]),
        ("datasets/example-dataset.md", "data-table", "dataset", "Example dataset", "Replace this starter with a durable description of a real dataset.", ["dataset"]),
        ("metrics/example-metric.md", "metric", "metric", "Example metric", "Replace this starter with a precise definition of a real metric.", ["metric"]),
        ("playbooks/data-quality.md", "playbook", "playbook", "Data quality", "The repeatable workflow for detecting and resolving data-quality problems.", ["data-quality", "playbook"]),
    ],
}
#: What a field may hold, in UTF-16 units and (types and tags) in bytes; tags of a concept; bytes and segments of a path.
UNITS = {"type": 256, "title": 4096, "description": 16_384, "tag": 256, "timestamp": 256}
BYTES = {"type": 256, "tag": 256}
MOST_TAGS, PATH_BYTES, PATH_SEGMENTS = 128, 4096, 64
#: Signs that no type, tag, timestamp or path may hold.
CONTROL = "[\\x00-\\x1f\\x7f-\\x9f]"


def _too_long(c: Column, field: str) -> Column:
    """The field's limit that a text exceeds, or null."""
    found = F.when(utf16_length(c) > UNITS[field], f"concept-{field}-code-unit-limit")
    return found.when(F.octet_length(c) > BYTES[field], f"concept-{field}-utf8-limit") if field in BYTES else found


def _plain(c: Column, field: str) -> Column:
    """What is wrong with a text that has to be there, within its limits, on one line and without control characters."""
    return F.when(~has_text(c), f"empty-concept-{field}").otherwise(F.coalesce(_too_long(c, field), F.when(c.rlike(CONTROL), f"unsafe-concept-{field}-control")))


def type_problem(c: Column) -> Column:
    return _plain(c, "type")


def title_problem(c: Column) -> Column:
    """Of a title as it was typed; its limit is that of its one line."""
    return let(one_line(c), lambda t: F.when(~has_text(t), "empty-concept-title").otherwise(_too_long(t, "title")))


def description_problem(c: Column) -> Column:
    """Null stands for no description, which is no problem."""
    return _too_long(description_input(c), "description")


def tags_problem(c: Column) -> Column:
    """Of a list of tags, the first one's that has any; null stands for no tags."""
    first = F.try_element_at(F.filter(F.transform(c, lambda t: _plain(t, "tag")), lambda p: p.isNotNull()), F.lit(1))
    return F.when(F.size(c) > MOST_TAGS, "concept-tag-count-limit").otherwise(first)


def timestamp_problem(c: Column) -> Column:
    """Null stands for no timestamp."""
    return F.when(c.isNotNull(), _plain(c, "timestamp"))


def output_path(raw: Column) -> Column:
    """Where a typed path is written, or null where nothing may be: percent escapes are undone until none is left, and each segment has to be portable."""

    def checked(path: Column) -> Column:
        parts = F.split(path, "/")
        sound = F.forall(parts, lambda s: portable_segment(s) & ~s.isin(".", "..") & (F.octet_length(s) <= 255))
        fits = (F.octet_length(path) <= PATH_BYTES) & (F.size(parts) <= PATH_SEGMENTS)
        return F.when(fits & sound & ~path.rlike(CONTROL), path)

    slashed = F.replace(raw, F.lit("\\"), F.lit("/"))
    typed = has_text(raw) & (F.octet_length(raw) <= PATH_BYTES) & (F.size(F.split(slashed, "/")) <= PATH_SEGMENTS)
    return F.when(typed, let(F.replace(stable_decoded(slashed), F.lit("\\"), F.lit("/")), checked))


def concept_path(raw: Column) -> Column:
    """output_path of a concept: a Markdown file with a name, and no index or log."""
    return let(output_path(raw), lambda p: F.when(p.endswith(".md") & ~F.lower(base_name(p)).isin(".md", "index.md", "log.md"), p))


def frontmatter(type_: Column, title: Column, description: Column, tags: Column, timestamp: Column, runtime: Column, producer: str) -> Column:
    """The fields as quoted YAML, those that are null or empty left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), json_quote(c), F.lit("\n"))
    given = lambda when, c: F.when(when, c).otherwise("")
    listed = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), json_quote(t), F.lit("\n"))), "")
    return F.concat(
        F.lit("---\n"), line("type", type_), line("title", title), given(has_text(description), line("description", description)),
        given(F.size(tags) > 0, F.concat(F.lit("tags:\n"), listed)), given(timestamp.isNotNull(), F.concat(F.lit(f'generated:\n  by: "{producer}"\n  at: '), json_quote(timestamp), F.lit("\n"))),
        given(runtime.isNotNull(), line("runtime", runtime)), F.lit("---\n"),
    )


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def written(entered: DataFrame, producer: str) -> DataFrame:
    """rendered() without reading again what was written."""
    template, path = F.col("template"), concept_path(F.col("bundle_path"))
    problem = F.coalesce(
        F.when(~F.coalesce(template.isin(*BODIES), F.lit(False)), "unknown-concept-template"), F.when(F.col("path").isNull(), "unsafe-relative-path"), type_problem(F.col("type")),
        title_problem(F.col("title")), description_problem(F.col("description")), tags_problem(F.col("tags")), timestamp_problem(F.col("timestamp")),
    )
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    front = frontmatter(F.col("type"), one_line(F.col("title")), description_input(F.col("description")), tags, F.col("timestamp"), F.try_element_at(_table(RUNTIMES), template), producer)
    text = F.concat(front, F.lit("\n"), F.try_element_at(_table(BODIES), template))
    rows = entered.withColumn("path", path).withColumn("problem", problem)
    return rows.withColumn("text", F.when(F.col("problem").isNull(), text))


def rendered(entered: DataFrame, producer: str = "process:wicker") -> DataFrame:
    """entered(bundle_id, template, bundle_path, type, title, description, tags, timestamp) with path, problem and text.

    problem is the code of the first fault, in the order template, path, type, title, description, tags, timestamp, and then
    of the document that came out; text is null with one. Null descriptions, tags and timestamps are left out of the
    document; any other null is a fault. Rows that repeat are written each; other columns are kept as they are.
    """
    inner = ("path", "problem", "text", "source", "reserved")
    own = [c for c in entered.columns if c not in inner]
    rows = written(entered, producer)
    again = with_structure(rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "path", "problem", F.col("text").alias("source"), F.lit(None).cast("string").alias("reserved")))
    fault = (
        F.when(utf16_length(F.col("source")) > MOST_BYTES, "generated-concept-code-unit-limit").when(F.octet_length("source") > MOST_BYTES, "generated-concept-utf8-limit")
        .when(F.col("fault").isNotNull(), "generated-concept-frontmatter-limit")
    )
    checked = again.withColumn("problem", F.coalesce("problem", fault))
    return checked.select("row.*", "path", "problem", F.when(F.col("problem").isNull(), F.col("source")).alias("text"))


def preset_problem(preset: Column, timestamp: Column) -> Column:
    """Of a bundle to be started: an unknown preset, no timestamp, or one that its concepts may not hold."""
    known = F.coalesce(preset.isin(*PRESETS), F.lit(False))
    return F.when(~known, "unknown-bundle-preset").when(~has_text(timestamp), "empty-template-timestamp").when(preset.isin(*[p for p, own in PRESETS.items() if own]), timestamp_problem(timestamp))


def presets(bundles: DataFrame, producer: str = "process:wicker") -> DataFrame:
    """bundle_id, path, text, problem: the files of each bundle(bundle_id, preset, timestamp), one row a bundle.

    A bundle with a problem has one row, without path and text; the others have a row for each concept of their preset and
    for the index of each of its folders, the root's always among them.
    """
    rows = bundles.select("bundle_id", "preset", "timestamp").withColumn("problem", preset_problem(F.col("preset"), F.col("timestamp")))
    sound = rows.where("problem IS NULL")
    starter = lambda s: F.struct(F.lit(s[0]).alias("bundle_path"), F.lit(s[1]).alias("template"), F.lit(s[2]).alias("type"), F.lit(s[3]).alias("title"), F.lit(s[4]).alias("description"), F.array(*map(F.lit, s[5])).alias("tags"))
    own = F.coalesce(*[F.when(F.col("preset") == name, F.array(*map(starter, given))) for name, given in PRESETS.items() if given])
    concepts = written(sound.select("bundle_id", "timestamp", F.explode(own).alias("s")).select("bundle_id", "timestamp", "s.*"), producer).select("bundle_id", "path", "text")
    # Indexes are planned in several passes, each of which would write and parse all concepts again.
    parsed, _ = store.written(parse.parse(concepts.select("bundle_id", F.col("path").alias("uri"), F.col("path").alias("bundle_path"), F.encode("text", "UTF-8").alias("content"))))
    chunks, _ = store.written(indexes.chunked(parsed))
    planned = indexes.plan(parsed, chunks=chunks, bundles=sound.select("bundle_id"))
    files = concepts.unionByName(indexes.texts(indexes.pieces(planned, chunks)).select("bundle_id", "path", "text"))
    none = F.lit(None).cast("string")
    return files.withColumn("problem", none).unionByName(rows.where("problem IS NOT NULL").select("bundle_id", none.alias("path"), none.alias("text"), "problem"))
