"""Running sums by runs against a plain walk, and what is built on them."""

import random

from pyspark.sql import functions as F

from wicker.functions.text import utf16_key
from wicker.operators import query, reports
from wicker.operators.running import key_bytes, running, running_distinct


def rows_of(spark):
    rng = random.Random(3)
    paths = [f"{d}/{rng.randrange(10**6)}.md" for d in ("a", "aa", "b/c", "～", "😀") for _ in range(60)]
    rows = [(b, p, rng.randrange(9), rng.choice("xyzw") if rng.random() < 0.8 else None) for b in ("m", "n", None) for p in dict.fromkeys(paths)]
    return rows, spark.createDataFrame(rows, "bundle_id string, path string, cost int, type string")


def test_running_sums(spark):
    rows, df = rows_of(spark)
    key = utf16_key(F.col("path"))
    assert key_bytes(df, ["bundle_id"], key, 1000) == 0 and key_bytes(df, ["bundle_id"], key, 20) > 0
    expected = {}
    for b in ("m", "n", None):
        total, types = 0, set()
        for _, p, c, t in sorted((r for r in rows if r[0] == b), key=lambda r: r[1].encode("utf-16-be")):
            total += c
            types |= {t} - {None}
            expected[b, p] = (total, len(types))
    for most in (20, 1000):
        sums = running(df, ["bundle_id"], key, {"total": F.col("cost")}, most=most)
        assert sums.columns == [*df.columns, "total"]
        got = running_distinct(sums, ["bundle_id"], key, "type", "types", most=most).collect()
        assert {(r["bundle_id"], r["path"]): (r["total"], r["types"]) for r in got} == expected
    assert running(df.limit(0), ["bundle_id"], key, {"total": F.col("cost")}).count() == 0


def test_children_and_occurrences(spark):
    nodes = spark.createDataFrame([("b", "x/1", "One", "u1"), ("b", "x/y/2", None, "u2"), ("b", "3", "Three", "u3")], "bundle_id string, id string, title string, uri string")
    got = [(r["folder"], r["kind"], r["label"], r["path"]) for r in query.ordered_children(query.children(nodes)).collect()]
    assert got == [("", 0, "x", "x"), ("", 1, "Three", "3"), ("x", 0, "y", "x/y"), ("x", 1, "One", "x/1"), ("x/y", 1, "x/y/2", "x/y/2")]
    edges = spark.createDataFrame([("b", "3", "x/1", 0), ("b", "3", "x/y/2", 1), ("b", "3", "x/1", 2)], "bundle_id string, source string, target string, nth int")
    assert [(r["nth"], r["title"], r["again"]) for r in query.occurrences(edges, nodes).orderBy("nth").collect()] == [(0, "One", 0), (1, "x/y/2", 0), (2, "One", 1)]
    wanted = spark.createDataFrame([("b", n) for n in ("x", "x/1", "", "x/y", "q")], "bundle_id string, name string")
    assert {r["name"]: (r["node_exists"], r["folder_exists"]) for r in query.present(nodes, wanted).collect()} == {"x": (False, True), "x/1": (True, False), "": (False, True), "x/y": (False, True), "q": (False, False)}
    assert query.toggled(["a"], "b") == ["a", "b"] and query.toggled(["a", "b"], "a") == ["b"]


def test_reports(spark):
    found = spark.createDataFrame(
        [("b", "okf.curation.x", "curation", "warning", "u2", ""), ("b", "okf.conformance.y", "conformance", "error", "u2", "s"), ("b", "okf.curation.hidden", "curation", "warning", "u1", ""), ("c", "okf.curation.x", "curation", "warning", "u3", "")],
        "bundle_id string, code string, category string, severity string, uri string, subject string",
    )
    assert [r["code"] for r in reports.ordered(found.where("bundle_id = 'b'")).collect()] == ["okf.curation.hidden", "okf.conformance.y", "okf.curation.x"]
    assert {r["bundle_id"]: (r["findings"], r["exit_code"]) for r in reports.verdicts(found).collect()} == {"b": (3, 1), "c": (1, 0)}
    shown = {r["uri"]: [d["code"] for d in r["diagnostics"]] for r in reports.diagnostics(found, "okf.curation.hidden").collect()}
    assert shown == {"u2": ["okf.conformance.y", "okf.curation.x"], "u3": ["okf.curation.x"]}
    assert {r["line"] for r in reports.lines(found.where("uri = 'u2'")).collect()} == {"WARNING okf.curation.x u2", "ERROR okf.conformance.y u2 (s)"}
    text = spark.range(1).select(reports.envelope(F.struct(F.lit(1).alias("n")), "validate").alias("j")).first()["j"]
    assert text == '{"schemaVersion":1,"command":"validate","result":{"n":1}}'
    many = spark.range(5).select(F.when(F.col("id") < 3, "b").otherwise("c").alias("bundle_id"))
    assert [tuple(r) for r in reports.refused(many, 2).collect()] == [("b", 3)]
