"""N-gram Jaccard join by set relations.

A document is its set of distinct word shingles. Shingles are ordered rarest first by a count over all documents (a
fixed-size table of hashed counters, so the order needs no join), and only the leading ones of a set go into the index:
two sets that are alike enough must share one of these. An index entry holds its position in the set: entries from whose
positions too few shingles follow for the overlap are skipped, alone or by blocks of a long list (linking.py). A 512-bit
parity map bounds the difference of two sets from below and drops most pairs; the others are verified on the whole sets.
A set's answers follow from those of the leader it is highly similar to: the leader's distances, less the group's radius,
rule out most other sets at once, and only pairs across groups that this leaves open are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.common import ascii_words, discard, documents, hash_words, id_marks, kept, marked_rows, mix, slices, stash, texts_of
from wicker.llm.linking import REST_BITS, find_groups

#: Counters in the frequency table, in chunks; the driver and each worker hold one byte for each.
COUNTERS, CHUNK = 1 << 22, 1 << 16
MAP_BITS = 512


def shingle_sets(texts: list[str | None], words_each: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; with fewer words, of the whole sequence; without words none."""
    words, counts = ascii_words(texts)
    h = hash_words(words)
    odd, out, at = np.uint64(0x9E3779B97F4A7C15), [], 0
    for n in counts.tolist():
        w, at = h[at : at + n], at + n
        k = min(words_each, n)
        if not n:
            out.append(w)
            continue
        g = mix(w[: n - k + 1] + np.uint64(k))
        for i in range(1, k):
            g = mix(g * odd + w[i : n - k + 1 + i])
        g.sort()
        out.append(g[np.r_[True, g[1:] != g[:-1]]])
    return out


def frequency_classes(docs: DataFrame, sets: Callable[[list[str | None]], list[np.ndarray]]) -> np.ndarray:
    """uint8 per counter: floor(log2(1 + how often sets, which reads texts, gives a hash of that counter)), over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("shingles", dict)
        table = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found = sets(texts_of(part))
                np.add.at(table, np.concatenate(found) % np.uint64(COUNTERS), 1) if found else None
        chunks = table.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([zlib.compress(chunks[i].tobytes(), 1) for i in used], pa.binary())], names=["chunk", "counts"])

    return classes_of(docs.select("text").mapInArrow(count, "chunk bigint, counts binary"))


def classes_of(counted: DataFrame) -> np.ndarray:
    """uint8 per counter: floor(log2(1 + count)), from rows (chunk, counts: packed 64-bit numbers) of any number of tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([np.log2(1 + t).astype(np.uint8).tobytes() for t in total.values()], pa.binary())], names=["chunk", "classes"])

    classes = np.zeros((COUNTERS // CHUNK, CHUNK), dtype=np.uint8)
    for row in counted.repartition("chunk").mapInArrow(add, "chunk bigint, classes binary").collect():
        classes[row["chunk"]] = np.frombuffer(row["classes"], dtype=np.uint8)
    return classes.ravel()


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return int(s.sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(s)).astype(np.int64))


def _row(s: np.ndarray, classes: np.ndarray, percent: int) -> tuple[list[int], bytes, int, int]:
    n = len(s)
    if not n:
        return [], b"\0" * (MAP_BITS // 8), 0, 0
    # Index tokens: frequency class, then the hash without its low seven bits (a clash there is only one more candidate).
    keys = (classes[s % np.uint64(COUNTERS)].astype(np.uint64) << np.uint64(57)) | (s >> np.uint64(7))
    keys.sort()
    parity = np.bincount((s >> np.uint64(40)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1
    return keys[: n - -(-percent * n // 100) + 1].astype(np.int64).tolist(), np.packbits(parity.astype(np.uint8)).tobytes(), *digest_of(s)


def node_of_set() -> Column:
    """A set is known by its size and digest, hashed to one number."""
    return F.xxhash64("k1", "k2", "size")


def described(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """doc_id, version, size, k1, k2 (digest of the set), prefix (index tokens), sig (parity map) of each row, stashed."""
    held = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, lambda texts: shingle_sets(texts, words_each)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(texts_of(part), words_each)
                prefix, sig, k1, k2 = zip(*(_row(s, classes, percent) for s in sets), strict=True)
                columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "size", "k1", "k2", "prefix", "sig"])

    return stash(docs.select("doc_id", "version", "text").mapInArrow(run, "doc_id bigint, version bigint, size bigint, k1 bigint, k2 bigint, prefix array<bigint>, sig binary"))


def common(a: bytes, b: bytes) -> tuple[int, int]:
    """Sizes of intersection and union of two sets of 64-bit hashes."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in (a, b))
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared, len(both) - shared


def sets_of(docs: DataFrame, wanted: DataFrame, words_each: int) -> DataFrame:
    """node, shingles (64-bit hashes) of the sets in wanted (node, lead: the id of a document with it); other documents are passed over by a bounded bit map, then by an exact semi-join."""
    held, place = id_marks(wanted.select(F.col("lead").alias("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(marked_rows(batch, held.value, 1), "text"):
                sets = [s for s in shingle_sets(texts_of(part), words_each) if len(s)]
                digests = [digest_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in digests], pa.int64()), pa.array([k[1] for k in digests], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["k1", "k2", "size", "shingles"])

    sets = docs.select("text", place(F.col("doc_id")).alias("place")).mapInArrow(run, "k1 bigint, k2 bigint, size bigint, shingles binary").select(node_of_set().alias("node"), "shingles")
    return sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def row_groups(docs: DataFrame, words_each: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, version (hash of the text), n_shingles, component_id of each row; join_groups says of which."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    known = described(rows, words_each, percent)
    real = known.where("doc_id IS NOT NULL AND size > 0").withColumn("node", node_of_set())
    classes = stash(real.groupBy("node").agg(F.min("doc_id").alias("lead")))
    leads = real.join(classes.select(F.col("node").alias("of"), "lead"), (F.col("node") == F.col("of")) & (F.col("doc_id") == F.col("lead")), "left_semi")
    payload = stash(leads.select("node", "size", "sig").dropDuplicates(["node"]))
    entries = leads.select("node", "size", F.posexplode("prefix").alias("nth", "token"))
    rest = F.least(F.col("size") - F.col("nth"), F.lit((1 << REST_BITS) - 1))
    entries = entries.select("token", "node", F.shiftleft("size", REST_BITS).bitwiseOR(rest).alias("place"))

    def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return -(-percent * (n + m) // (100 + percent))

    def limit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(100 * np.minimum(n, m) >= percent * np.maximum(n, m), (100 - percent) * (n + m) // (100 + percent), -1)

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = stash(ends.join(classes, "node"))
        sets = stash(sets_of(rows, wanted, words_each))
        with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = [common(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield batch.select([0, 1]).filter(pa.array([100 * both >= percent * union for both, union in sizes], pa.bool_()))

        linked = stash(both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint"))
        discard(sets, wanted)
        return linked

    groups = find_groups(entries, payload, limit, need, verify, percent / 100)
    grouped = stash(classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    discard(classes, payload)
    least = grouped.groupBy("component").agg(F.min("lead").alias("component_id"))
    by_class = grouped.select(F.col("node").alias("of"), "component").join(least, "component").select("of", "component_id")
    linked = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    joined = known.select("doc_id", "version", "size", node_of_set().alias("node")).join(by_class, linked & (F.col("node") == F.col("of")), "left")
    return joined.select("doc_id", "version", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def join_groups(docs: DataFrame, words_each: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    Two documents link when 100 * intersection >= percent * union of their shingle sets (percent at least 80). Null and
    empty texts have no shingles and link with nothing. A null id stays null and links with nothing. Rows that repeat an
    id with another text are documents of their own. Other columns are not read; an empty table gives no rows. Shingles
    and words count as equal when their 64-bit hashes are.
    """
    return row_groups(docs, words_each, percent, id_col, text_col).drop("version")


def keep_first(docs: DataFrame, words_each: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without near duplicates: of every group of linked documents the row with the least id stays, among equal ids the one with the least hash of its text, and of rows equal in both one.

    Rows without an id or without words stay. Columns are the input's; an empty table gives no rows.
    """
    found = row_groups(docs, words_each, percent, id_col, text_col).where("doc_id IS NOT NULL AND n_shingles > 0")
    per_row = stash(found.groupBy("component_id", "doc_id", "version").agg(F.count(F.lit(1)).alias("n")))
    stays = per_row.groupBy("component_id").agg(F.min(F.struct("doc_id", "version")).alias("stay"))
    judged = per_row.join(stays, "component_id").withColumn("gone", F.struct("doc_id", "version") != F.col("stay")).where("gone OR n > 1")
    judged = stash(judged.select(F.col("doc_id").alias("_join_id"), F.col("version").alias("_join_version"), "gone"))
    here = (F.col(id_col).cast("long") == F.col("_join_id")) & (F.xxhash64(text_col) == F.col("_join_version"))
    kept = docs.join(judged, here, "left_anti")
    again = judged.where("NOT gone")
    if again.isEmpty():
        return kept
    repeated = docs.join(again, here).dropDuplicates(["_join_id", "_join_version"]).select(*docs.columns)
    return kept.unionByName(repeated)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(documents(spark, sf_dir))
