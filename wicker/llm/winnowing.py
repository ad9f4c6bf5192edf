"""Document fingerprints by winnowing.

Hash every run of `k` code points, take the least hash of every window of `w` neighbouring runs (the rightmost of
equals), and keep hash and position. Two texts that share a run of w + k - 1 code points share a fingerprint hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicker.llm.common import documents, mix, slices, texts_of

K, W = 16, 48
#: Text bytes that one run of neighbouring documents holds, about, and the most runs whose first ids the driver holds.
RUN_BYTES, MAX_RUNS, DRAWN_PER_RUN = 4 << 20, 100_000, 20


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k codes, by joining hashes of halves: log2(k) passes. k is a power of two."""
    h = mix(codes.astype(np.uint64) + np.uint64(1))
    span, odd = 1, 0x9E3779B97F4A7C15
    while span < k:
        h = h[:-span] * np.uint64(odd) + h[span:]
        odd, span = odd * odd % 2**64, span * 2
    return mix(h)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value in each window of w, the rightmost of equals; windows are joined from shorter ones."""
    at = np.arange(len(h), dtype=np.int64)
    value, span, start = h, 1, 0
    done: tuple[np.ndarray, np.ndarray] | None = None
    while True:
        if w & span:
            if done is None:
                done = (value, at)
            else:
                n = len(h) - (start + span) + 1
                a, b = (done[0][:n], done[1][:n]), (value[start : start + n], at[start : start + n])
                right = b[0] <= a[0]
                done = (np.where(right, b[0], a[0]), np.where(right, b[1], a[1]))
            start += span
        if span * 2 > w:
            return done[1]
        right = value[span:] <= value[:-span]
        value, at = np.where(right, value[span:], value[:-span]), np.where(right, at[span:], at[:-span])
        span *= 2


def winnow(texts: list[str], k: int = K, w: int = W) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text. A text shorter than k has one hash, of all of it; an empty text none."""
    gap = "\0" * (k + w)
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    start = np.cumsum(np.r_[0, n[:-1] + k + w])
    grams = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    h = gram_hashes(codes, k)
    real = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(real, start, (n > 0).astype(np.int64))
    np.add.at(real, np.minimum(start + grams, len(h)), -(n > 0).astype(np.int64))
    h = np.where(np.cumsum(real[:-1]) > 0, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    least = window_minima(h, w)
    out = []
    for s, g in zip(start.tolist(), grams.tolist(), strict=True):
        if g:
            picked = least[s : s + max(g - w + 1, 1)]
            picked = picked[np.r_[True, picked[1:] != picked[:-1]]]
            out.append((h[picked], picked - s))
        else:
            out.append((h[:0], least[:0]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two fingerprints' hashes; of two empty ones 1."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def text_form(hashes: np.ndarray, positions: np.ndarray) -> str:
    """16 hex digits of each hash and 8 of its position, in order of position."""
    rows = np.empty(len(hashes), dtype=[("h", ">u8"), ("p", ">u4")])
    rows["h"], rows["p"] = hashes, positions
    return rows.tobytes().hex()


def fingerprint(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint array<struct<hash long, position long>>; null text counts as empty, which has none. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = winnow([t or "" for t in texts_of(part)], k, w)
                rows = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in found]).astype(np.int64)) for i in (0, 1)], names=["hash", "position"])
                offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, rows)], names=["doc_id", "fingerprint"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint array<struct<hash:bigint,position:bigint>>")


def in_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (run, look, doc_id, text, k) dealt into runs of neighbouring ids, each run followed by the next run's first document (look = 1; after the last run, the very first).

    Each text is shuffled once. Run bounds are ids drawn evenly by hash; the driver holds at most DRAWN_PER_RUN * MAX_RUNS of them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"))
    n, size, first = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("k")).first()
    runs = int(min(MAX_RUNS, max(1, size // RUN_BYTES)))
    share = min(1.0, runs * DRAWN_PER_RUN / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("k").distinct()
    ids = np.sort(drawn.toPandas()["k"].to_numpy(dtype=np.int64))
    cuts = np.unique(np.r_[[] if first is None else [first], ids[:: max(1, len(ids) // runs)]].astype(np.int64))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(k):
        place = np.searchsorted(cuts, k.to_numpy(), side="right") - 1
        starts = cuts[place] == k.to_numpy()
        # A run's first document also stands behind the run before, as -1 - run.
        return k.__class__([[p, -1 - (p - 1) % len(cuts)] if s else [p] for p, s in zip(place.tolist(), starts.tolist(), strict=True)])

    to = rows.withColumn("to", F.explode(of("k")))
    to = to.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("run"), (F.col("to") < 0).cast("int").alias("look"), "doc_id", "text", "k")
    return to.repartition("run").sortWithinPartitions("run", "look", "k", "text")


def with_next(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document by id.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document (all
    of it if shorter); the last document's next is the first. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null text counts as empty; a null id sorts first; rows that repeat an id
    follow one another by text; a single document is its own next; other columns are not read; an empty table gives no
    rows.
    """

    def finish(rows: list[tuple], following: list[str]) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        edited = [t[: len(t) - len(t) // 4] + nxt[: len(t) // 4] for t, nxt in zip(texts, following, strict=True)]
        own, after, changed = winnow(texts, k, w), winnow(following, k, w), winnow(edited, k, w)
        columns = [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
            pa.array([text_form(*x) for x in own], pa.string()), pa.array([text_form(*x) for x in changed], pa.string()),
            pa.array([likeness(a[0], b[0]) for a, b in zip(own, changed, strict=True)], pa.float64()), pa.array([likeness(a[0], b[0]) for a, b in zip(own, after, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        rows: list[tuple] = []
        following: list[str] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for where, look, doc_id, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if waiting and waiting[2] == where:
                        rows.append(waiting)
                        following.append(text)
                        size += len(text)
                    waiting = None if look else (doc_id, text, where)
                if size > 1 << 20:
                    yield finish(rows, following)
                    rows, following, size = [], [], 0
        if rows:
            yield finish(rows, following)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_runs(docs, id_col, text_col).select("run", "look", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))
