"""Root verdicts."""

from wicker.operators import parse, reports


def parsed_of(spark, files):
    rows = [("b", f"mem://b/{p}", p, c.encode()) for p, c in files.items()]
    return parse.parse(spark.createDataFrame(rows, "bundle_id string, uri string, bundle_path string, content binary"))


def test_root_verdicts(spark):
    for version, verdict in (('"0.1"', "supported"), ('"0.2"', "supported"), ('"0.10"', "future-minor"), ('"1.0"', "unsupported")):
        row = reports.root_class(parsed_of(spark, {"index.md": f"---\nokf_version: {version}\ntitle: '  My bundle '\n---\n# Head\n"})).first()
        assert (row["verdict"], row["label"]) == (verdict, "My bundle")
    assert reports.root_class(parsed_of(spark, {"index.md": "no heading"})).first()["verdict"] == "undeclared"
