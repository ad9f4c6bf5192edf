"""Runs are cut finer only where they are too large; what queries keep of documents that they read for a few fields."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from wicker import catalog
from wicker.functions.text import utf16_key
from wicker.operators import parse, query, rules, structure
from wicker.operators.running import key_cuts, running
from wicker.plans import migration
from wicker.sources import store, tables


def test_only_large_runs_are_cut_finer(spark):
    """Numbers behind a long common prefix do not make a run of each row."""
    paths = [f"order/4-NOT SPECIFIED/{k}.md" for k in range(2000)] + [f"part/{k}.md" for k in range(50)]
    df = spark.createDataFrame([("b", p, 1) for p in paths], "bundle_id string, path string, one int").repartition(4)
    key, most = utf16_key(F.col("path")), 100
    cuts = key_cuts(df, ["bundle_id"], key, most)
    assert [size for size, _ in cuts] == [8 * k for k in range(len(cuts))]
    assert all(0 < large.count() <= len(paths) // most for _, large in cuts)
    placed = running(df, ["bundle_id"], key, {"nth": F.col("one")}, most=most)
    assert {r["path"]: r["nth"] for r in placed.collect()} == {p: k + 1 for k, p in enumerate(sorted(paths))}


def test_outline_is_of_the_parsed_documents(spark, sf_dir):
    docs = tables.documents(spark, sf_dir).unionByName(tables.notes(spark, sf_dir)).unionByName(tables.nation_bundles(spark, sf_dir))
    found = parse.outline(docs)
    assert found.columns == ["bundle_id", "uri", "path", "id", "reserved", "failure", "type", "title"]
    want = parse.parse(docs).select(*found.columns)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty() and not found.where("failure IS NOT NULL").isEmpty()


def test_structure_gives_the_columns_named(spark):
    docs = spark.createDataFrame([("a", "---\ntype: t\n---\n\n# H\n\n[x](./y.md)\n", None), ("b", None, None)], "uri string, source string, reserved string")
    whole, some = structure.with_structure(docs), structure.with_structure(docs, made=("marks", "fault"), carried=("uri",))
    assert some.columns == ["uri", "marks", "fault"] and some.collect() == whole.select(*some.columns).collect()


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    """What a table was made from is removed with its query; the session's setting stays as it was."""
    before = spark.conf.get(store.DROP_SHUFFLES, None)
    local = Path(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p for p in local.rglob("shuffle_*.data")}
    there = files()
    df, path = store.written(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not files() - there:
            break
        time.sleep(0.1)
    assert not files() - there and df.count() == 1000 and spark.conf.get(store.DROP_SHUFFLES, None) == before
    store.delete(spark, path)


def test_folder_children_needs_no_links(spark, sf_dir):
    """Names of the outline are those of the nodes, and neither links nor nodes are made for them."""
    catalog.release()
    found = catalog.queries()["folder_children"](spark, sf_dir)
    assert {name for _, _, name in catalog._HELD} == {"outline"}
    want = query.children(catalog._nodes(spark, sf_dir)).drop("bundle_id")
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    catalog.release()


def test_bundle_summary_writes_no_findings(spark, sf_dir):
    """Counts come from the rules at once, and are those of the written findings."""
    catalog.release()
    found = catalog.queries()["bundle_summary"](spark, sf_dir)
    assert {name for _, _, name in catalog._HELD} == {"parsed", "links"}
    want = rules.summary(catalog._findings(spark, sf_dir)).drop("bundle_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    catalog.release()


def test_migration_keeps_what_it_reads(spark, sf_dir):
    catalog.release()
    catalog.queries()["migration_actions"](spark, sf_dir)
    [(held, _)] = catalog._HELD.values()
    assert held.columns == list(migration.READ)
    catalog.release()
