"""Message sizes against real messages, focus after a change, guarded writes."""

import hashlib
import json

from pyspark.sql import functions as F

from wicker.operators import graph, parse, payload, query
from wicker.sources import guarded


def test_sizes_are_those_of_the_message(spark):
    texts = {
        "a.md": "---\ntype: note\ntitle: \"T \\\"é😀\\\" \\u0001\\t\"\ntags: [x, y, x]\nsources:\n  - {resource: r}\n  - no\ngenerated: {by: tool/1, at: 2026-07-01T00:00:00Z}\n---\n😀 [b](b.md) [b](b.md)\n[gone \"x\"](gone.md)\n",
        "b.md": "---\ntype: ''\nstatus: 5\nruntime: py\n---\n[a](a.md) [c](sub/c.md)\n", "sub/c.md": "no frontmatter", "d.md": "---\ntype: note\n---\n", "index.md": "# I\n",
    }
    for files in (texts, {"d.md": texts["d.md"]}):
        parsed = parse.parse(spark.createDataFrame([("b", f"m://{p}", p, t.encode()) for p, t in files.items()], "bundle_id string, uri string, bundle_path string, content binary"))
        resolved = graph.all_links(parsed)
        nodes, edges, broken = graph.nodes(parsed, resolved), graph.edges(resolved), graph.broken_links(resolved)
        rows = nodes.withColumn("json", payload.node_json(nodes)).collect()
        ns, es, bs = [json.loads(r["json"]) for r in rows], [json.loads(r["j"]) for r in edges.select(payload.edge_json().alias("j")).collect()], [json.loads(r["j"]) for r in broken.select(payload.broken_json().alias("j")).collect()]
        sound = [n for n in ns if "sourceFailed" not in n]
        counts = lambda values: {v: values.count(v) for v in values}
        message = {
            "protocolVersion": 1, "revision": 12, "nodes": ns, "edges": es, "backlinks": {n["id"]: sorted({e["source"] for e in es if e["target"] == n["id"]}) for n in ns}, "brokenLinks": bs,
            "statistics": {"conceptCount": len(ns), "edgeCount": len(es), "orphanCount": sum(n["orphan"] for n in ns), "brokenLinkCount": len(bs), "typeCounts": counts([n["type"] for n in sound]), "tagCounts": counts([t for n in sound for t in dict.fromkeys(n["tags"])])},
        }
        want = len(json.dumps(message, ensure_ascii=False, separators=(",", ":")).encode())
        assert [tuple(r) for r in payload.sizes(nodes, edges, broken, 12).collect()] == [("b", want)]
        by = {n["id"]: n for n in ns}
        if len(files) > 1:
            assert by["sub/c"] == {"id": "sub/c", "sourceFailed": True, "type": "", "tags": [], "orphan": False, "brokenLinkCount": 0}
            assert by["a"]["sourceCount"] == 1 and by["a"]["generatedAt"] == "2026-07-01T00:00:00Z" and "status" not in by["b"] and by["b"]["runtime"] == "py"
            assert es[0]["sourceRange"]["start"]["character"] == 3 and len(es) == 4 and len(bs) == 1


def test_focus_stays_or_goes_to_the_nearest_place(spark):
    before = spark.createDataFrame([("s", "b", 1), ("s", "gone", 2), ("s", "late", 9), ("t", "x", 0), ("u", "y", 4)], "view string, value string, place long")
    after = spark.createDataFrame([("s", v, k) for k, v in enumerate("abcd")] + [("u", "z", 0)], "view string, value string, place long")
    got = {(r["view"], r["value"]): (r["kept"], r["focus"]) for r in query.preserved(before, after, ["view"], "value", "place").collect()}
    assert got == {("s", "b"): (1, "b"), ("s", "gone"): (2, "c"), ("s", "late"): (3, "d"), ("t", "x"): (None, None), ("u", "y"): (0, "z")}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def proposals(spark, *rows):
    return spark.createDataFrame([("b", p, old and sha(old), old and len(old.encode()), new) for p, old, new in rows], guarded.PROPOSALS)


def texts(store):
    return {r["path"]: r["content"] for r in store.read().collect()}


def outcomes(report):
    return {r["path"]: r["outcome"] for r in report.collect()}


def test_guarded_writes(spark, tmp_path):
    store = guarded.Store(spark, f"file:{tmp_path}/store")
    made, report = store.write(proposals(spark, ("a.md", None, "A"), ("b.md", None, "é")))
    assert made == 1 and outcomes(report) == {"a.md": "applied", "b.md": "applied"} and texts(store) == {"a.md": "A", "b.md": "é"}
    mixed = proposals(spark, ("a.md", "A", "A2"), ("b.md", "other", "B2"), ("c.md", "C", "C2"), ("a2.md", None, "new"), ("b.md", "é", "B3"), ("a.md", "A", "A2"))
    made, report = store.write(mixed)
    assert made is None and outcomes(report) == {"a.md": "repeated", "b.md": "repeated", "c.md": "missing", "a2.md": "held"} and texts(store) == {"a.md": "A", "b.md": "é"}
    made, report = store.write(proposals(spark, ("a.md", "A", "A2"), ("b.md", "x", "B2"), ("c.md", "C", "C2"), ("d.md", None, "D")), partial=True)
    assert made == 2 and outcomes(report) == {"a.md": "applied", "b.md": "changed", "c.md": "missing", "d.md": "applied"} and texts(store) == {"a.md": "A2", "b.md": "é", "d.md": "D"}
    # The same proposals again find their own result in place of what they expect.
    made, report = store.write(proposals(spark, ("a.md", "A", "A2"), ("d.md", None, "D")))
    assert made is None and outcomes(report) == {"a.md": "changed", "d.md": "appeared"} and store.version() == 2


def test_a_lost_race_leaves_the_winner(spark, tmp_path):
    store = guarded.Store(spark, f"file:{tmp_path}/store")
    store.write(proposals(spark, ("a.md", None, "A")))
    base = store.version()
    first = guarded.applied(store.read(base), proposals(spark, ("a.md", "A", "one")))
    second = guarded.applied(store.read(base), proposals(spark, ("a.md", "A", "two")))
    assert store.commit(first, base) == 2 and store.commit(second, base) is None and texts(store) == {"a.md": "one"} and store.version() == 2
    assert len([p for p in (tmp_path / "store/staged").iterdir() if p.is_dir()]) == 2 and store.read(1).select(F.first("content")).first()[0] == "A"
