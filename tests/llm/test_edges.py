"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from wicker.llm import bpe, embedding_dedup, langid, line_dedup, lm_scoring, mixing, ngram_join, quality, sharding, winnowing

LONG = "word thing other some more text here " * 4000 + "x" * 60_000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, block bigint, node bigint, size bigint, run int, token string, label int, _lang_pred string"
ROWS = [
    (1, "One plain text with several words in it.\nAnd a second line of words.", "en", "a", 3),
    (2, "One plain text with several words in it.\nAnd a second line of words.", None, "b", None),
    (3, "", "en", None, 0), (4, None, "de", "a", None), (5, LONG, "en", "a", len(LONG)), (6, " \n\t ", "de", "b", 4),
    (7, "ein anderer Text mit Worten", "de", "b", 27), (7, "ein anderer Text mit Worten", "de", "b", 27), (None, "a text without an id", "en", "a", 20), (8, "12 34 ... !!", None, None, 12),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (0.5, 1, 2, 3, 4, "t", 5, "p")
    return spark.createDataFrame([r + extra for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *keys):
    return sorted(map(tuple, df.select(*keys).collect()), key=repr)


def test_sharding(docs, none):
    got = sharding.shard(docs, 3).collect()
    assert len(got) == len(ROWS) and sharding.shard(none, 3).count() == 0
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["size"] for r in got if r["doc_id"] in (3, 4)} == {16} and all(r["grown_shard"] in (r["shard"], 3) for r in got)


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    assert mix.agg(F.sum(words)).first()[0] == sum(r["taken"] for r in got)


def test_bpe(docs, none):
    got = bpe.encode(docs, bpe.vocabulary_path()).collect()
    assert sorted((r["decoded"] for r in got), key=repr) == sorted((r[1] or "" for r in ROWS), key=repr)
    assert bpe.encode(none, bpe.vocabulary_path()).count() == 0 and all(not r["ids"] for r in got if r["doc_id"] in (3, 4))


def test_language_id(docs, none):
    path = langid.vocabulary_path()
    model = langid.train(docs, path, rounds=1)
    got = langid.identify(docs, model, path).collect()
    assert model[0] == ["de", "en"] and len(got) == len(ROWS)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 6, 8)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    nothing = langid.train(none, path)
    assert nothing[0] == [] and {r["lang_pred"] for r in langid.identify(docs, nothing, path).collect()} == {"und"}
    assert langid.identify(none, model, path).count() == 0


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 1), (5, None), (None, 1), (2, 0)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality.score(none, quality.train(none, labels.limit(0))).count() == 0


def test_winnowing(docs, none):
    got = winnowing.with_next(docs).collect()
    assert len(got) == len(ROWS) and winnowing.with_next(none).count() == 0
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2)}) == 1 and {r["fingerprint"] for r in got if r["doc_id"] in (3, 4)} == {""}
    assert winnowing.with_next(docs.where("doc_id = 5")).first()["near_next"] == 1.0
    plain = {r["doc_id"]: [(x["hash"], x["position"]) for x in r["fingerprint"]] for r in winnowing.fingerprint(docs).collect()}
    assert plain[3] == [] and plain[1] == plain[2] and plain[1]


def test_lm_scoring(docs, none):
    got = lm_scoring.score(docs).collect()
    assert len(got) == len(ROWS) and lm_scoring.score(none).count() == 0
    assert {(r["n_words"], r["log_sum"], r["score"]) for r in got if r["doc_id"] in (3, 4, 6)} == {(0, 0.0, None)}


def test_ngram_join(docs, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_groups(docs).collect()}
    assert got[1] == got[2] and got[2][1] == 1 and got[3] == (0, 3) and got[4] == (0, 4) and got[7] == (2, 7) and got[None][1] is None
    assert ngram_join.join_groups(none).count() == 0


def test_line_dedup(docs, none):
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"] and line_dedup.dedup_lines(none).count() == 0
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in found.collect()}
    assert got[1] == (ROWS[0][1], 2, 0) and got[2] == ("", 2, 2) and got[4] == (None, 0, 0) and got[6] == (" \n\t ", 2, 0) and got[5][0] == LONG and got[None][2] == 0
    assert found.where("doc_id = 7").count() == 2


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 1), (2, [2.0, 0.001], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, [1.0, 0.0], 2), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [5e-324, 0.0], 3), (14, [1.7e308, 1e300], 3), (15, [0.0, 1e-200], 3)]
    vectors = spark.createDataFrame([(*r, 9, "n") for r in data], "vec_id bigint, embedding array<double>, label int, node int, rows string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert got[13] == (1, 13, True) and got[14] == (1, 13, False) and got[15] == (0, 15, True)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)) and got[None][:2] == (0, None)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_pipeline_stages(docs, spark):
    import corpus_pipeline

    data = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows_in in (data, data.limit(0)):
        now = rows_in
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            kept = stage(spark, now, "")
            assert k == 4 or kept.columns == data.columns
            now = spark.createDataFrame(kept.collect(), kept.schema)
        assert now.where("NOT round_trip").count() == 0
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows_in, "").collect()
