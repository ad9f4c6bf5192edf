"""Small bundles written out as text: parsing, link classes, rules, plans."""

from pyspark.sql import functions as F

from wicker.functions import dates, paths, text
from wicker.operators import graph, parse, query, rules
from wicker.sources import bundles

NOW, TODAY = 1784721600, "2026-07-22"


def bundle(spark, files):
    rows = [("b", f"mem://b/{p}", p, c if isinstance(c, bytes) else c.encode()) for p, c in files.items()]
    return parse.parse(spark.createDataFrame(rows, "bundle_id string, uri string, bundle_path string, content binary")).persist()


def codes(spark, files):
    parsed = bundle(spark, files)
    resolved = graph.all_links(parsed)
    found = rules.all_findings(parsed, resolved, graph.nodes(parsed, resolved), NOW, TODAY)
    return sorted((r["code"].split(".", 1)[1], r["uri"][8:]) for r in found.collect())


CONCEPT = "---\ntype: note\ntitle: T\ndescription: D\n---\n\n"


def test_link_classes(spark):
    targets = {
        "./sub/leaf.md?view=wide#part-2": "internal", "/common/%C3%BC%C3%A9%20%C3%B8.md": "internal", "https://links.test/page?x=2#end": "external", "mailto:ann@links.test": "external", "./absent.md": "broken", "../../../above.md": "out-of-bundle",
        "/%2E%2E/above.md": "out-of-bundle", "%2f..%2fabove.md": "out-of-bundle", "#part-2": "fragment", "./sub/": "directory", "./half%4.md": "invalid", "./table.csv": "invalid", "sub/index.md": "directory",
    }
    body = "\n".join(f"[x]({t})" for t in targets)
    parsed = bundle(spark, {"notes/from.md": CONCEPT + body, "notes/sub/leaf.md": CONCEPT, "notes/sub/index.md": "# I\n", "common/üé ø.md": CONCEPT})
    got = {r["raw_target"]: r for r in graph.all_links(parsed).collect()}
    assert {t: r["classification"] for t, r in got.items()} == targets
    first = got["./sub/leaf.md?view=wide#part-2"]
    assert (first["target_id"], first["query"], first["fragment"]) == ("notes/sub/leaf", "view=wide", "part-2")
    assert got["/common/%C3%BC%C3%A9%20%C3%B8.md"]["target_id"] == "common/üé ø"


def test_link_forms(spark):
    body = "[one](a.md) ![image](b.md) `[code](c.md)`\n\n```\n[fence](d.md)\n```\n\n[Second **formatted**][ref] [ref][] [Ref]\n\n<https://e.test/x>\n\n[ref]: e.md\n[ref]: f.md\n"
    got = [(r["label"], r["raw_target"]) for r in parse.links(bundle(spark, {"s.md": CONCEPT + body})).orderBy("nth").collect()]
    assert got == [("one", "a.md"), ("Second formatted", "e.md"), ("ref", "e.md"), ("Ref", "e.md"), ("https://e.test/x", "https://e.test/x")]


def test_frontmatter_values(spark):
    front = "---\r\ntype: 'it''s'\r\ntitle: \"a \\\"b\\\"\"\r\ndescription: 12\r\nresource: plain # note\r\ntags:\r\n  - x\r\n  - \"y z\"\r\nverified: {by: human:ann, at: 2026-07-01T00:00:00Z}\r\n---\r\nBody\r\n"
    r = bundle(spark, {"a.md": "﻿" + front}).first()
    assert (r["type"], r["title"], r["description"], r["resource"], r["tags"], r["trust_tier"], r["failure"], r["body"]) == ("it's", 'a "b"', None, "plain", ["x", "y z"], "human-reviewed", None, "Body\n")
    mixed = bundle(spark, {"a.md": "---\ntype: x\ntags: [a, 1]\n---\n"}).first()
    assert mixed["tags"] == []


def test_failures_and_rules(spark):
    got = codes(spark, {
        "index.md": '---\nokf_version: "0.3"\nextra: 1\n---\n', "log.md": "# L\n\n## 2026-07-01\n\n## soon\n", "bad.md": b"---\ntype: x\n---\n\xff", "none.md": "no frontmatter", "twice.md": "---\ntype: a\ntype: b\n---\n",
        "a.md": CONCEPT + "[b](b.md) [gone](gone.md)", "b.md": "---\ntype: ' '\nresource: r\nstatus: old\ntimestamp: 2030-01-01T00:00:00Z\nstale_after: 2026-02-30\ngenerated: {by: nobody}\n---\n", "c.md": "---\ntype: x\ntitle: c\ndescription: c\nresource: ' r '\n---\n[a](a.md)",
    })
    assert got == sorted([
        ("compatibility.future-minor-version", "index.md"), ("conformance.reserved-frontmatter", "index.md"), ("conformance.index-structure", "index.md"), ("conformance.log-structure", "log.md"), ("conformance.utf8-decode", "bad.md"), ("conformance.frontmatter", "none.md"), ("conformance.frontmatter", "twice.md"),
        ("curation.broken-link", "a.md"), ("conformance.concept-type", "b.md"), ("curation.missing-title", "b.md"), ("curation.missing-description", "b.md"), ("curation.invalid-status", "b.md"), ("curation.invalid-stale-after", "b.md"), ("curation.invalid-generated", "b.md"), ("curation.duplicate-resource", "b.md"), ("curation.duplicate-resource", "c.md"),
    ])


def test_field_positions_keep_their_digits(spark):
    names = ["type", "title", "description", "resource", "status", "stale_after", "runtime", "computation"]
    front = "".join(f"{n}:  {k + 1}x{k}{k + 1} \n" for k, n in enumerate(names))
    r = bundle(spark, {"a.md": f"---\n{front}---\n"}).first()
    assert [r[n] for n in names] == [f"{k + 1}x{k}{k + 1}" for k in range(len(names))]


def test_fences_are_whole_lines(spark):
    got = {r["path"]: r["failure"] for r in bundle(spark, {"a.md": "--- \ntype: x\n---\n", "b.md": "---\ntype: x\n--- \n", "c.md": "---\ntype: x\n---", "d.md": "---"}).collect()}
    assert got == {"a.md": "frontmatter", "b.md": "frontmatter", "c.md": None, "d.md": "frontmatter"}


def test_verification_events(spark):
    at = "at: 2026-07-01T00:00:00Z"
    cases = {
        "{by: human:ann, %s}" % at: ("human-reviewed", []), "{by: process:ci}": ("unverified", ["invalid-verified"]), "\n  - {by: bob, %s}\n  - by: human:ann\n    %s" % (at, at): ("human-reviewed", ["invalid-verified"]),
        "[{by: tool/1.0, %s}, {by: process:ci, %s}]" % (at, at): ("machine-confirmed", []), "\n  by: human:ann\n  at: 2027-01-01T00:00:00Z": ("human-reviewed", ["future-verified-at"]), "[]": ("unverified", ["invalid-verified"]), "true": ("unverified", ["invalid-verified"]),
        "[{by: human:ann, %s}, done]" % at: ("human-reviewed", ["invalid-verified"]),
    }
    parsed = bundle(spark, {f"{k}.md": f"---\ntype: x\nverified: {v}\ntitle: t\n---\n" for k, v in enumerate(cases)})
    found = {}
    for r in rules.verified(parsed, NOW).collect():
        found.setdefault(r["uri"][8:], []).append(r["code"].rsplit(".", 1)[1])
    assert {r["path"]: (r["trust_tier"], found.get(r["path"], [])) for r in parsed.collect()} == {f"{k}.md": v for k, v in enumerate(cases.values())}


def test_sources_and_attested_parts(spark):
    whole = "  - resource: https://a.test\n    author: team:docs\n    last_modified: 2026-01-31\n    usage_count: 3\n    usage_window: {from: 2026-01-01, to: 2026-02-01}\n"
    cases = {
        "sources:\n" + whole: [], "sources: [{resource: a}, {resource: b, id: c}]\n": [], "sources: []\n": [], "sources:\n  - resource: ''\n": ["invalid-sources"], "sources:\n  - id: a\n": ["invalid-sources"], "sources: {resource: a}\n": ["invalid-sources"],
        "sources:\n  - {resource: a, author: someone}\n": ["invalid-sources"], "sources:\n  - {resource: a, usage_count: 1}\n": ["invalid-sources"], "sources:\n  - {resource: a, last_modified: soon}\n": ["invalid-sources"],
    }
    parsed = bundle(spark, {f"{k}.md": f"---\ntype: x\n{v}title: t\n---\n" for k, v in enumerate(cases)})
    got = {r["uri"][8:]: [r["code"].rsplit(".", 1)[1]] for r in rules.provenance(parsed).collect()}
    assert {f"{k}.md": got.get(f"{k}.md", []) for k in range(len(cases))} == {f"{k}.md": v for k, v in enumerate(cases.values())}
    parts = {
        "runtime: py\nparameters:\n  - {name: a, type: int, required: true}\n": None, "runtime: py\nparameters:\n  - {name: a, type: int}\n": "parameters", "runtime: py\ncomputation: f.py\n": "computation", "parameters: x\n": "runtime",
        "runtime: py\nexecutor: {resource: r, receipt: [a, b]}\nattester: {resource: s}\n": None, "runtime: py\nexecutor: {resource: ''}\n": "executor", "runtime: py\nattester: x\n": "attester",
    }
    parsed = bundle(spark, {f"{k}.md": f"---\ntype: Attested Computation\n{v}---\n# Computation\n\n```\nx\n```\n" for k, v in enumerate(parts)})
    assert {r["uri"][8:]: r["subject"] for r in rules.attested(parsed).collect()} == {f"{k}.md": v for k, v in enumerate(parts.values()) if v}


def test_attested_computation(spark):
    head = "---\ntype: Attested Computation\ntitle: t\ndescription: d\nruntime: py\n---\n"
    got = codes(spark, {"a.md": head + "# Computation\n\n```\nx\n```\n[b](b.md)", "b.md": head + "# Computation\n\nnothing\n[a](a.md)"})
    assert got == [("curation.invalid-attested-computation", "b.md")]


def test_failed_documents_are_targets_but_have_no_edges(spark):
    parsed = bundle(spark, {"a.md": CONCEPT + "[f](f.md)", "f.md": "broken [a](a.md)"})
    resolved = graph.all_links(parsed)
    nodes = {r["id"]: r for r in graph.nodes(parsed, resolved).collect()}
    assert [(r["source"], r["target"]) for r in graph.edges(resolved).collect()] == [("a", "f")]
    assert nodes["f"]["source_failed"] and not nodes["f"]["orphan"] and nodes["f"]["type"] == "" and nodes["f"]["status"] is None
    assert {r["type"] for r in graph.type_counts(graph.nodes(parsed, resolved)).collect()} == {"note"}


def test_order_of_documents_does_not_matter(spark):
    files = {f"d{k % 3}/n{k}.md": CONCEPT + f"[n](/d{(k + 1) % 3}/n{(k + 1) % 9}.md)" for k in range(9)}
    a, b = (sorted(map(tuple, graph.edges(graph.all_links(bundle(spark, f))).collect())) for f in (files, dict(reversed(files.items()))))
    assert a == b and len(a) == 9


def test_search(spark):
    nodes = spark.createDataFrame([("b", "büro/Tea-room", "Ｂｉｇ Kettle", ["Hot-Water", "чай"])], "bundle_id string, id string, title string, tags array<string>")
    hit = lambda q: query.visible(nodes, query.View(text=q)).count() == 1
    assert all(map(hit, ["big kettle", "ＴＥＡ", "water чай", "büro", "", "  "])) and not any(map(hit, ["big pan", "kettlewater"]))


def test_paths(spark):
    cases = {"a\\b//./c.md": "a/b/c.md", "a/../b.md": "b.md", "../x.md": None, "/x.md": None, "C:/x.md": None, "a\x01.md": None, "/".join(["a"] * 65): None}
    df = spark.createDataFrame(list(cases.items()), "raw string, expected string")
    assert df.where(~paths.canonical_path(F.col("raw")).eqNullSafe(F.col("expected"))).count() == 0
    seg = spark.createDataFrame([("a b*~'é", "a%20b%2A~%27%C3%A9")], "s string, e string")
    assert seg.where(paths.encode_segment(F.col("s")) != F.col("e")).count() == 0


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.fnv1a(F.lit("concept"))) == 2738371859 and one(text.fnv1a(F.lit(""))) == 0x811C9DC5
    assert one(text.wide_trim(F.lit("  ﻿a b　"))) == "a b" and one(text.one_line(F.lit(" a\r\n\tb "))) == "a b"
    assert one(text.wide_trim(F.lit("Brand#12"))) == "Brand#12"
    assert one(text.escape_label(F.lit("a[b]\\"))) == "a\\[b\\]\\\\" and one(text.json_quote(F.lit('a"b'))) == '"a\\"b"'
    assert one(text.utf16_length(F.lit("a😀"))) == 3 and one(text.bounded(F.lit("x" * 200))) == "x" * 159 + "…" and one(text.bounded(F.lit("x" * 158 + "😀😀"))) == "x" * 158 + "…"
    assert one(text.slug(F.lit("  A--b! "))) == "a-b" and one(text.inline_code(F.lit("a`b"))) == "``a`b``" and one(text.base36(F.lit(71))) == "1z"
    ordered = [r["s"] for r in spark.createDataFrame([("😀",), ("～",)], "s string").orderBy(text.utf16_key(F.col("s"))).collect()]
    assert ordered == ["😀", "～"]
    actors = {"human:ann": True, "process:x": True, "a/1.0": True, "a/b/c": False, "human:": False, "bob": False}
    df = spark.createDataFrame(list(actors.items()), "a string, ok boolean")
    assert df.where(text.actor_ok(F.col("a")) != F.col("ok")).count() == 0


def test_dates(spark):
    cases = {"2026-07-22T12:00:00Z": NOW, "2026-07-22T14:30:00.5+02:30": NOW, "2026-07-22T11:00:00-01:00": NOW, "2026-07-22T11:00:00-0100": None, "2026-02-30T00:00:00Z": None, "2026-07-22": None, "2026-07-22T24:00:00Z": None, "2026-07-22T12:00:00": None}
    df = spark.createDataFrame(list(cases.items()), "s string, e bigint")
    assert df.where(~dates.explicit_zone_epoch(F.col("s")).eqNullSafe(F.col("e"))).count() == 0


def codes_of(parsed, path):
    return [r["code"] for r in rules.generated(parsed, NOW).unionByName(rules.provenance(parsed)).where(F.col("uri").endswith("/" + path)).collect()]


def test_read_bundle(spark, tmp_path):
    for name in ("index.md", "AGENTS.md", ".agents/x.md", "d/index.md", "d/c.md", "d/c.txt", "node_modules/p/index.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(CONCEPT)
    root = f"file:{tmp_path}"
    found = {r["bundle_path"] for r in bundles.read_bundle(spark, root, "b").collect()}
    assert {"index.md", "d/index.md", "d/c.md"} <= found and not {"AGENTS.md", "d/c.txt", ".agents/x.md"} & found
    assert bundles.read_root_index(spark, root, "b").count() == 1
    assert [(r["root"], r["omitted"]) for r in bundles.discover(spark, root).collect()] == [(root, 0)]


def test_budget_states(spark):
    rows = spark.createDataFrame([("b", p, c) for p, c in (("a", 5), ("b", 4), ("c", 3), ("d", 1))], "bundle_id string, path string, cost bigint")
    assert {r["path"]: r["state"] for r in query.cut_off(rows, 9).collect()} == {"a": "kept", "b": "kept", "c": "over", "d": "skipped"}
