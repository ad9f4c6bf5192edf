"""Quality classification from trusted positives and unlabelled text (non-negative positive-unlabelled learning).

A linear score over shares of byte-class pairs, hashed words, word pairs and letter runs, and a few word statistics
minimises the non-negative unbiased risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior *
loss(positives as 0)). Where the second part falls below zero, a step goes up its gradient instead, which keeps it from
overfitting. Documents labelled 0 are no training examples, and labels say nothing about the class prior: it is estimated
from where held-back positives and unlabelled text score highest.

The trusted positives are a bounded sample; the unlabelled text is all of it. Its features are dealt to chunks by a hash
of id and text, as many as the number of documents asks for, whatever files and partitions the rows lie in. Each chunk
gets a fit of its own against the positives, on the executors, and the model is the mean of these fits by their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.common import ascii_words, documents, hash_words, kept, mix, slices, texts_of

#: Bound on the labelled sample, and unlabelled documents per chunk: so many at least on average, and below twice as many (all chunks are used).
MAX_POSITIVES, CHUNK = 4000, 8000
#: Steps that ids are drawn in: of many positives, about twice as many ids as are wanted are sorted.
DRAWS = 1 << 30
CLASSES, HASHED, WORD_STATS = 10, 64, 6
WIDTH = CLASSES**2 + 3 * HASHED + WORD_STATS


def byte_classes() -> np.ndarray:
    """Class of each UTF-8 byte: lower, upper, digit, blank, line end, other control, beyond ASCII, full stop or other sentence end, comma or other pause, any other sign."""
    table = np.full(256, 9, dtype=np.int64)
    table[128:] = 6
    table[:32] = table[127] = 5
    for k, signs in ((3, b" \t"), (4, b"\r\n"), (7, b".!?"), (8, b",;:")):
        table[list(signs)] = k
    for k, low, high in ((0, "a", "z"), (1, "A", "Z"), (2, "0", "9")):
        table[ord(low) : ord(high) + 1] = k
    return table


BYTE_CLASS = byte_classes()


def features(texts: list[str | None]) -> np.ndarray:
    """[text, WIDTH], float32: roots of the shares of pairs of adjacent byte classes and of hashed words, word pairs and runs of three bytes, then word statistics. Empty texts: zeros."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n_texts, sizes = len(raw), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    octets = np.frombuffer(b"".join(raw), dtype=np.uint8)
    kinds, owner = BYTE_CLASS[octets], np.repeat(np.arange(n_texts), sizes)

    def shares(of: np.ndarray, code: np.ndarray, width: int) -> np.ndarray:
        counts = np.bincount(of * width + code, minlength=n_texts * width).reshape(n_texts, width)
        return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))

    inside = owner[1:] == owner[:-1]
    pairs = shares(owner[1:][inside], (kinds[:-1] * CLASSES + kinds[1:])[inside], CLASSES**2)
    whole = owner[2:] == owner[:-2]
    runs = (octets[:-2].astype(np.uint32) << 16 | octets[1:-1].astype(np.uint32) << 8 | octets[2:])[whole] * np.uint32(2654435761)
    letters = shares(owner[2:][whole], (runs >> np.uint32(26)).astype(np.int64), HASHED)
    words, counts = ascii_words(texts)
    h, of = hash_words(words), np.repeat(np.arange(n_texts), counts)
    single = shares(of, (h % np.uint64(HASHED)).astype(np.int64), HASHED)
    near = of[1:] == of[:-1]
    double = shares(of[1:][near], (mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[near] % np.uint64(HASHED)).astype(np.int64), HASHED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = np.maximum(counts, 1)
    per = lambda x: np.bincount(of, weights=x, minlength=n_texts) / n
    new = np.ones(len(h), dtype=bool)
    order = np.lexsort((h, of))
    new[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & near
    stats = [np.log1p(counts) / 10, per(lengths) / 10, np.sqrt(per(lengths.astype(float) ** 2)) / 10, np.where(counts > 0, per(new), 0), np.where(counts > 0, per(new) * np.sqrt(n) / 10, 0), per(again)]
    return np.concatenate([pairs, letters, single, double, np.stack(stats, axis=1)], axis=1).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int, rate: float = 0.02, sparsity: float = 0.01, batch: int = 512, seed: int = 0) -> np.ndarray:
    """Weights, the bias last, by Adam on mini-batches: of the non-negative risk, or without a prior of telling positives from unlabelled.

    A smoothed L1 penalty keeps features that only tell the two samples apart by chance out of the score; the weights
    are the mean over the second half of the steps.
    """
    rng, w = np.random.default_rng(seed), np.zeros(positive.shape[1] + 1)
    mean = np.zeros_like(w)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p, u = (x[rng.integers(0, len(x), size=min(batch, len(x)))] for x in (positive, unlabelled))
        sp, su = (sigmoid(x @ w[:-1] + w[-1]) for x in (p, u))
        pull = lambda x, s: np.r_[x.T @ s, s.sum()] / len(s)
        if prior is None:
            step = pull(u, su) - pull(p, 1 - sp)
        else:
            rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            rest_step = pull(u, su) - prior * pull(p, sp)
            step = rest_step - prior * pull(p, 1 - sp) if rest >= 0 else -rest_step
        step = step + sparsity * np.r_[w[:-1] / np.sqrt(w[:-1] ** 2 + 1e-4), 0]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        mean += w * (2 * t > steps)
    return mean / (steps - steps // 2)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in unlabelled text, from scores: above any score, unlabelled texts are at least that share of the positives above it; the score where this bound is tightest decides, for its error."""
    scores = np.sort(positive)[::-1]
    at_least = np.arange(1, len(scores) + 1) / len(scores)
    above = 1 - np.searchsorted(np.sort(unlabelled), scores, side="left") / len(unlabelled)
    error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(unlabelled)) + 1.1 / np.sqrt(len(positive)))
    best = int(np.argmin((above + error) / at_least))
    return float(np.clip(above[best] / at_least[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights on the features as they are, the bias last, and the estimated prior. One positive in four is held back for the prior.

    Steps that go up the gradient push all scores up, so the bias is set at the end: the mean score of the unlabelled
    texts is the prior.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-2
    p, u = ((x - mean) / scale for x in (positive, unlabelled))
    back = np.arange(len(p)) % 4 == 3 if len(p) >= 8 else np.ones(len(p), dtype=bool)
    told = descend(p[~back] if len(p) >= 8 else p, u, None, steps // 2)
    prior = estimate_prior(p[back] @ told[:-1], u @ told[:-1])
    w = descend(p, u, prior, steps)
    z, low, high = u @ w[:-1], -60.0, 60.0
    for _ in range(60):
        w[-1] = (low + high) / 2
        low, high = (w[-1], high) if sigmoid(z + w[-1]).mean() < prior else (low, w[-1])
    return np.r_[w[:-1] / scale, w[-1] - w[:-1] @ (mean / scale)], prior


def _features(rows: DataFrame) -> DataFrame:
    """drawn (a hash of id and text) and f, the features, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in features(texts_of(part))], pa.binary())], names=["drawn", "f"])

    return rows.select(F.xxhash64("doc_id", "text").alias("drawn"), "text").mapInArrow(run, "drawn bigint, f binary")


def _matrix(found) -> np.ndarray:
    return np.array([np.frombuffer(x, dtype=np.float32) for x in found], dtype=np.float32).reshape(len(found), WIDTH)


def train(unlabelled: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, chunk: int = CHUNK) -> dict[str, np.ndarray]:
    """Fit on documents (doc_id, text) and labels (doc_id, quality): weight [WIDTH], bias, prior.

    An id labelled more than once counts as 1 only if all its labels are; null ids and labels are not used, though the
    texts of null ids are unlabelled text like any other. Without positives or texts, all scores are one half. The
    result depends on the rows only, not on where they lie: chunks are dealt by hash and sorted before they are fitted.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = unlabelled.select("doc_id", "text")
    # Ids are drawn before texts are read: at most max_positives of them are broadcast, so no text is shuffled for its label.
    found = known.where("quality = 1").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS)).alias("at"))
    share = min(1.0, 2 * max_positives / max(1, found.count()))
    ids = found.where(F.col("at") < int(share * DRAWS)).orderBy("at", "doc_id").limit(max_positives).select("doc_id")
    drawn = _features(rows.join(F.broadcast(ids), "doc_id", "left_semi")).orderBy("drawn", "f").limit(max_positives)
    positive = _matrix(drawn.select("f").toPandas()["f"])
    if not len(positive):
        return {"weight": np.zeros(WIDTH), "bias": np.array(0.0), "prior": np.array(0.5)}
    held, chunks = unlabelled.sparkSession.sparkContext.broadcast(positive), max(1, rows.count() // chunk)

    def run(table: pa.Table) -> pa.Table:
        kept("quality", dict)
        every = table.sort_by([("drawn", "ascending"), ("f", "ascending")])
        weights, prior = fit(held.value, _matrix(every.column("f").to_pylist()))
        values = np.r_[weights, prior] * every.num_rows
        return pa.table({"k": pa.array(np.arange(len(values))), "value": pa.array(values), "n": pa.array(np.full(len(values), every.num_rows))})

    fits = _features(rows).withColumn("chunk", F.pmod("drawn", F.lit(chunks))).groupBy("chunk").applyInArrow(run, "k bigint, value double, n bigint")
    found = fits.groupBy("k").agg((F.sum("value") / F.sum("n")).alias("value")).toPandas()
    mean = found.sort_values("k")["value"].to_numpy()
    return {"weight": mean[:WIDTH], "bias": np.array(mean[WIDTH]), "prior": np.array(mean[WIDTH + 1])}


def score(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 where score >= threshold).

    Null and empty texts get the score of a text without any feature. Texts are read whole; repeated rows get equal
    scores; other columns are not read; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                s = sigmoid(features(texts_of(part)) @ m["weight"] + m["bias"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def held_out() -> Column:
    """crc32 of the id as text leaves 2 by 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
