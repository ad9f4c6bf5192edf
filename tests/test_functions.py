"""Inputs, containment, reference times, and graphs that disagree with themselves."""

import pytest
from pyspark.sql import functions as F

from wicker.functions import dates, paths, text
from wicker.operators import graph


def each(spark, make, *rows):
    names = [f"c{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + ", ".join(f"{c} string" for c in names))
    return [r["x"] for r in df.select("n", make(*map(F.col, names)).alias("x")).orderBy("n").collect()]


def test_inputs(spark):
    assert each(spark, text.title_input, (" a\r\n b\t c ",), ("",)) == ["a b c", ""] and each(spark, text.description_input, ("a\r\nb\rc\n",),) == ["a\nb\nc\n"]
    assert each(spark, text.tags_input, (" a, ,b,,a ",), ("",), (",",)) == [["a", "b", "a"], [], []]
    assert [len(x) for x in each(spark, text.failure_detail, ("x" * 4096,), ("x" * 4097,))] == [4096, 4096] and each(spark, lambda c: text.with_line_ends(c, "\r\n"), ("a\nb\rc\r\nd",)) == ["a\r\nb\r\nc\r\nd"]


def test_stable_decoding(spark):
    layers = lambda n: "%" + "25" * n + "41"
    cases = {"a%20b+c": "a b+c", "%2561": "a", layers(3): "A", layers(14): "A", layers(20): None, "%zz": None, "%25zz": None, "%00": None, "%2500": None, "%ff": None, "plain": "plain", "": "", "%EF%BF%BD": "�"}
    assert each(spark, paths.stable_decoded, *[(c,) for c in cases]) == list(cases.values())


def test_containment(spark):
    cases = [
        ("file:///a/b", "file:///a/b/c.md", True, "c.md"), ("file:///a/b/", "file:///a/b", True, "."), ("file:///a/b", "file:///a/bc", False, None), ("file:///", "file:///x/y", True, "x/y"), ("mem://h/a", "mem://H/a/b", True, "b"), ("mem://h/a", "mem://g/a/b", False, None),
        ("mem://h/a?q", "mem://h/a/b", False, None), ("mem://h/a", "mem://h/a/../b", True, None), ("no uri", "no uri", False, None),
    ]
    assert each(spark, paths.contained, *[c[:2] for c in cases]) == [c[2] for c in cases] and each(spark, paths.within, *[c[:2] for c in cases]) == [c[3] for c in cases]


def test_reference_times():
    assert dates.reference_time("2026-07-22T12:00:00Z") == dates.reference_time("2026-07-22T14:30:00.25+02:30") == dates.reference_time("2026-07-22T12:00") == dates.reference_time("2026-07-22T07:00-0500") == (1784721600, "2026-07-22")
    assert dates.reference_time("2026-07-22") == (1784678400, "2026-07-22") and dates.reference_time("2026-07-21T24:00") == (1784678400, "2026-07-22") and dates.reference_time("2026-07-22T01:00+02:00")[1] == "2026-07-21"
    for bad in ("2026-02-30", "2026-07-22T25:00Z", "2026-07-22T24:01", "2026-07-22T12:60", "2026-07-22T12", "now", "2026-07-22T12:00+25:00", ""):
        with pytest.raises(ValueError):
            dates.reference_time(bad)


def test_graphs_that_disagree_with_themselves(spark):
    nodes = lambda *rows: spark.createDataFrame([("b", *r) for r in rows], "bundle_id string, id string, type string, tags array<string>, orphan boolean, source_failed boolean, broken_link_count int")
    edges = lambda *rows: spark.createDataFrame([("b", *r) for r in rows], "bundle_id string, edge_id string, source string, target string")
    back = lambda *rows: spark.createDataFrame([("b", *r) for r in rows], "bundle_id string, target string, source string")
    stated = lambda *row: spark.createDataFrame([("b", *row)], "bundle_id string, concept_count int, edge_count int, orphan_count int, broken_link_count int")
    a, b, c = ("a", "t", [], False, False, 1), ("b", "t", ["x"], False, False, 0), ("c", "t", [], True, False, 0)
    good = (nodes(a, b, c), edges(("edge:0", "a", "b"), ("edge:1", "a", "b")), back(("b", "a")), stated(3, 2, 1, 1))
    assert graph.message_faults(*good).count() == 0
    cases = {
        "repeated-id": (nodes(a, b, c, c), good[1], good[2], stated(4, 2, 2, 1)), "repeated-edge": (good[0], edges(("edge:0", "a", "b"), ("edge:0", "a", "b")), *good[2:]), "edge-number": (good[0], edges(("edge:0", "a", "b"), ("edge:01", "a", "b")), *good[2:]),
        "backlink-missing": (*good[:2], back(), good[3]), "backlink-unfounded": (*good[:2], back(("b", "a"), ("a", "b")), good[3]), "orphan-mark": (nodes(a, b, (*c[:3], False, *c[4:])), *good[1:3], stated(3, 2, 0, 1)), "counts": (*good[:3], stated(3, 3, 1, 1)),
        "failed-source": (nodes(a, b, ("c", "t", [], False, True, 0)), *good[1:3], stated(3, 2, 0, 1)), "dangling-end": (nodes(a, b, c), edges(("edge:0", "a", "b"), ("edge:1", "a", "z")), back(("b", "a"), ("z", "a")), good[3]),
    }
    for fault, given in cases.items():
        assert {r["fault"] for r in graph.message_faults(*given).collect()} == {fault}, fault
