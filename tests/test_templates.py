"""Entered concepts: every check, what is written, and what reading it again gives."""

import json

from pyspark.sql import functions as F

from wicker.functions import text
from wicker.operators import parse
from wicker.plans import templates

ENTERED = "bundle_id string, template string, bundle_path string, type string, title string, description string, tags array<string>, timestamp string"
SOUND = {"bundle_id": "b", "template": "decision", "bundle_path": "a/b.md", "type": "decision", "title": "A title", "description": "Why.", "tags": ["x"], "timestamp": "2026-07-01T00:00:00Z"}

FAULTS = [
    ({"template": None}, "unknown-concept-template"), ({"template": "Decision"}, "unknown-concept-template"), ({"bundle_path": None}, "unsafe-relative-path"),
    ({"type": None}, "empty-concept-type"), ({"type": "\u3000"}, "empty-concept-type"), ({"type": "t" * 257}, "concept-type-code-unit-limit"), ({"type": "é" * 129}, "concept-type-utf8-limit"),
    ({"type": "a\x85b"}, "unsafe-concept-type-control"), ({"title": None}, "empty-concept-title"), ({"title": " \r\n "}, "empty-concept-title"), ({"title": "😀" * 2049}, "concept-title-code-unit-limit"),
    ({"title": "a" + " " * 5000 + "b"}, None), ({"description": "d" * 16385}, "concept-description-code-unit-limit"), ({"description": None}, None), ({"description": "\x1f"}, None),
    ({"tags": None}, None), ({"tags": []}, None), ({"tags": ["t"] * 128}, None), ({"tags": ["t"] * 129}, "concept-tag-count-limit"), ({"tags": ["t", None]}, "empty-concept-tag"),
    ({"tags": ["t", "a\nb", ""]}, "unsafe-concept-tag-control"), ({"tags": ["é" * 129]}, "concept-tag-utf8-limit"), ({"timestamp": None}, None), ({"timestamp": ""}, "empty-concept-timestamp"),
    ({"timestamp": "t" * 257}, "concept-timestamp-code-unit-limit"), ({"timestamp": "1\x7f"}, "unsafe-concept-timestamp-control"), ({"type": None, "title": None, "tags": [""]}, "empty-concept-type"),
]

PATHS = [
    ("a.md", "a.md"), ("a\\b.md", "a/b.md"), ("a%2Fb.md", "a/b.md"), ("a%252Fb.md", "a/b.md"), ("100%25.md", None), ("x%2e%2e/a.md", None), ("%2e%2e/a.md", None), ("/a.md", None), ("c:/a.md", None), ("a//b.md", None),
    ("./a.md", None), ("a/", None), ("a.txt", None), ("a.MD", None), ("Index.md", None), ("a/LOG.md", None), (".md", None), ("a/.md", None), ("nul.md", None), ("Com1 .md", None), ("com0.md", "com0.md"), ("lpt².x.md", None),
    ("conout$.md", None), ("a./b.md", None), ("a /b.md", None), ("a%zz.md", None), ("a%00.md", None), ("a\x85.md", None), ("", None), ("  ", None), (None, None), ("é" * 126 + ".md", "é" * 126 + ".md"), ("é" * 127 + ".md", None),
    ("d/" * 63 + "a.md", "d/" * 63 + "a.md"), ("d/" * 64 + "a.md", None), ("a+b c.md", "a+b c.md"),
]


def entered(spark, rows):
    return spark.createDataFrame([(k, *[(SOUND | row)[c] for c in SOUND]) for k, row in enumerate(rows)], f"nth int, {ENTERED}")


def test_every_fault_has_its_code(spark):
    got = {r["nth"]: r for r in templates.rendered(entered(spark, [row for row, _ in FAULTS])).collect()}
    assert [got[k]["problem"] for k in range(len(FAULTS))] == [code for _, code in FAULTS]
    assert all((got[k]["text"] is None) == (code is not None) for k, (_, code) in enumerate(FAULTS))


def test_paths(spark):
    rows = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(PATHS)], "k int, p string").select("k", templates.concept_path(F.col("p")).alias("p"))
    assert [PATHS[r["k"]][:1] + (r["p"],) for r in rows.orderBy("k").collect()] == PATHS


def test_document_as_written(spark):
    row = templates.rendered(entered(spark, [{"title": ' "q"\n \\u001B \x1b end ', "description": "one\r\ntwo", "tags": ["a: b", "#c"], "template": "attested-computation"}])).first()
    lines = row["text"].split("\n")
    assert lines[:3] == ["---", 'type: "decision"', 'title: "\\"q\\" \\\\u001B \\u001b end"']
    assert lines[3:13] == ['description: "one\\ntwo"', "tags:", '  - "a: b"', '  - "#c"', "generated:", '  by: "process:wicker"', '  at: "2026-07-01T00:00:00Z"', 'runtime: "replace-with-runtime"', "---", ""]
    assert lines[13] == "# Computation" and row["text"].endswith(".\n")


def test_reading_gives_back_what_was_entered(spark):
    rows = [{"template": t, "bundle_path": f"{t}.md", "title": f"é😀 {t}: #1", "type": "'[x]'", "tags": ["*a", "- b", "true", "t"], "description": "a > b\n  c: |\nd"} for t in templates.BODIES]
    made = templates.rendered(entered(spark, rows), producer="process:test")
    back = parse.parse(made.select("bundle_id", F.col("path").alias("uri"), F.col("path").alias("bundle_path"), F.encode("text", "UTF-8").alias("content"))).collect()
    assert len(back) == len(rows) == 8
    for r in back:
        assert (r["failure"], r["type"], r["title"], r["description"], r["tags"]) == (None, "'[x]'", f"é😀 {r['id']}: #1", "a > b\n  c: |\nd", ["*a", "- b", "true", "t"])
        assert (r["generated_by"], r["generated_at"]) == ("process:test", "2026-07-01T00:00:00Z")
        assert r["runtime"] == ("replace-with-runtime" if r["id"] == "attested-computation" else None) and r["heads"]


def test_other_columns_repeats_and_no_rows(spark):
    rows = entered(spark, [{}, {}]).withColumns({"problem": F.lit("mine"), "fault": F.lit(1), "source": F.lit("s"), "a.b": F.lit(2)})
    got = templates.rendered(rows)
    assert got.columns == ["nth", *SOUND, "fault", "a.b", "path", "problem", "text"]
    assert [(r["problem"], r["fault"], r["a.b"]) for r in got.collect()] == [(None, 1, 2)] * 2
    assert templates.rendered(entered(spark, [])).count() == 0
    assert templates.presets(spark.createDataFrame([], "bundle_id string, preset string, timestamp string")).count() == 0


def test_presets(spark):
    rows = [("m", "minimal", "now"), ("n", "minimal", None), ("s", "software-project", "now"), ("l", "software-project", "t" * 257), ("k", "minimal", "t" * 257), ("u", None, "now")]
    got = templates.presets(spark.createDataFrame(rows, "bundle_id string, preset string, timestamp string")).collect()
    assert {(r["bundle_id"], r["problem"]) for r in got if r["problem"]} == {("n", "empty-template-timestamp"), ("l", "concept-timestamp-code-unit-limit"), ("u", "unknown-bundle-preset")}
    files = {(r["bundle_id"], r["path"]): r["text"] for r in got if not r["problem"]}
    assert sorted(p for b, p in files if b == "s") == sorted(["index.md", *[s[0] for s in templates.PRESETS["software-project"]], "architecture/index.md", "decisions/index.md", "playbooks/index.md"])
    assert [p for b, p in files if b in "mk"] == ["index.md"] * 2 and "okf_version" in files["m", "index.md"]
    assert "- [Project overview](./project-overview.md)" in files["s", "index.md"] and "- [decisions](./decisions/)" in files["s", "index.md"]
    assert "okf_version" not in files["s", "decisions/index.md"] and files["s", "decisions/initial-context.md"].startswith('---\ntype: "decision"\n')


def test_json_quotes(spark):
    said = ["", "plain", 'a"b\\c', "\\u000B", "\x0b\x0b\x1f", "\\\x1a", "\\\\\x0e\x08\t\n", "é😀\u2028\x7f"]
    rows = spark.createDataFrame(list(enumerate(said)), "k int, c string").select("k", text.json_quote(F.col("c")).alias("q"))
    assert [r["q"] for r in rows.orderBy("k").collect()] == [json.dumps(x, ensure_ascii=False) for x in said]
