"""Helpers that the operators share: shared-folder tables, Arrow slicing, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Spark's setting that removes a query's shuffle files when the query ends: what a written table came from is not needed again.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What Python workers keep from task to task: one operator's memory at a time.
_KEPT: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]) -> object:
    """What this worker keeps for owner, made on first use; what it kept for any other owner is given up, so that one stage's memory does not outlive it."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, local sessions (tests) get one of their own; a cluster has no folder to fall back on."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="wicker-shared-")
    return f"file://{_LOCAL[app]}"


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/wicker-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.stashed_at = path
    return kept


def discard(*stashed: DataFrame) -> None:
    """Delete tables that stash() wrote, once all that reads them has itself been written."""
    for df in stashed:
        jvm = df.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split a batch into runs of rows whose texts hold about `limit` bytes, so that a task's working memory has a bound."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    run = np.cumsum(np.asarray(sizes, dtype=np.int64)) // limit
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]).tolist()
    for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def ascii_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text with A-Z lower-cased, and the number of words of each text (null: 0)."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = text.encode("utf-8", "surrogatepass").lower().split()
            counts[i] = len(found)
            words += found
    return words, counts


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def id_marks(wanted: DataFrame) -> tuple[Broadcast, Callable[[Column], Column]]:
    """A bit map of the ids in wanted (id), about 16 bits each and 128 MB at most, and the column that gives an id's bit. It may pass other ids, never misses one.

    Executors set the bits, chunk by chunk; the driver only puts finished chunks of 8 kB together.
    """
    bits = 1 << min(30, max(16, (16 * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, p = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for c in np.unique(chunk).tolist():
                here = p[chunk == c] & 0xFFFF
                np.bitwise_or.at(chunks.setdefault(c, np.zeros(1 << 11, dtype=np.uint32)), here >> 5, np.uint32(1) << (here & 31).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([x.tobytes() for x in chunks.values()], pa.binary())], names=["chunk", "bits"])

    marks = wanted.select(F.shiftright(place(F.col("id")), 16).alias("chunk"), place(F.col("id")).alias("p"))
    table = np.zeros((bits >> 16, 1 << 11), dtype=np.uint32)
    filled = marks.repartition("chunk").mapInArrow(fill, "chunk bigint, bits binary")
    # A small map comes in one job; of a large one the driver takes a partition at a time.
    for row in filled.collect() if bits <= 1 << 26 else filled.toLocalIterator():
        table[row["chunk"]] = np.frombuffer(row["bits"], dtype=np.uint32)
    return wanted.sparkSession.sparkContext.broadcast(table.ravel()), place


def marked_rows(batch: pa.RecordBatch, table: np.ndarray, column: int, marked: bool = True) -> pa.RecordBatch:
    """The rows whose place in the bit map, in the given column, is marked, or the others; a null place is not."""
    p = np.asarray(pc.fill_null(batch.column(column), 0), dtype=np.int64)
    hit = pc.and_(pa.array((table[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1), pc.is_valid(batch.column(column)))
    return batch.filter(hit if marked else pc.invert(hit))


def by_marks(df: DataFrame, held: Broadcast, place: str) -> tuple[DataFrame, DataFrame]:
    """df's rows that are marked by their place (a column), and the others."""
    at = df.columns.index(place)

    def part(marked: bool) -> DataFrame:
        return df.mapInArrow(lambda batches: (marked_rows(batch, held.value, at, marked) for batch in batches), df.schema)

    return part(True), part(False)
