from wicker.plans import templates


def test_presets_parse_each_concept_once(spark):
    bundles = spark.createDataFrame([("b", "software-project", "2026-07-01T00:00:00Z"), ("c", "minimal", "2026-07-01T00:00:00Z")], "bundle_id string, preset string, timestamp string")
    found = templates.presets(bundles)
    # What is left are root indexes that are read again; with concepts parsed in every pass there were 80.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 9
    assert {r.bundle_id for r in found.collect()} == {"b", "c"}
