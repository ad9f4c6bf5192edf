"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample. A vector is described by its nearest pivots in order. Trios of
these are inverted lists, and the order says which: those whose ranks are low in sum, as the nearest pivots are the ones
that a near copy shares most often. Vectors meet in a list when they share three pivots that rank low for both. A list's
members are verified by cosine in double precision, in blocks; a pair counts only in the first of the lists it shares, so
no pair is counted twice and none needs to leave its task. Equal vectors are one node with a multiplicity. Every vector is
indexed; the tests hold recall against brute force.

The pivots grow with the cube root of the vectors, so trios grow with the vectors and a list's expected length stays as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.llm.common import discard, stash
from wicker.llm.linking import components

#: Nearest pivots that describe a vector; trios of their ranks (from 0) that are lists: those of at most this sum.
NEAREST, RANK_SUM = 6, 7
TRIOS = np.array([t for t in combinations(range(NEAREST), 3) if sum(t) <= RANK_SUM])
#: Pivots for each cube root of the number of vectors, and the least of them; vectors in the sample they are drawn from, for each pivot, and the least of these.
PIVOT_RATE, LEAST_PIVOTS, SAMPLE_RATE, LEAST_SAMPLE = 3, 16, 4, 4096
BLOCK = 500
#: Similarities, and pairs, that a task works on at once.
AT_ONCE, PAIRS_AT_ONCE = 1 << 22, 1 << 17


def pivot_count(vectors: int) -> int:
    return max(LEAST_PIVOTS, round(PIVOT_RATE * vectors ** (1 / 3)))


def draw_pivots(sample: list[list[float]], count: int) -> dict[int, np.ndarray]:
    """Unit pivots [count, dimensions] for each dimension count of the sample: its first directions, filled up with seeded random ones."""
    out: dict[int, np.ndarray] = {}
    for dim in {len(v) for v in sample}:
        own = np.unique(unit(np.array([v for v in sample if len(v) == dim], dtype=np.float64)).round(12), axis=0)
        own = own[np.random.default_rng(dim).permutation(len(own))[:count]]
        out[dim] = unit(np.concatenate([own, random_pivots(dim, count)])[:count])
    return out


def random_pivots(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(count, dim))


def near_one(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def unit(v: np.ndarray) -> np.ndarray:
    v = near_one(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def describe(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the NEAREST pivots of each vector, nearest first."""
    out = [np.empty((0, NEAREST), dtype=np.int64)]
    step = max(1, AT_ONCE // len(pivots))
    for lo in range(0, len(vectors), step):
        far = -(unit(vectors[lo : lo + step]) @ pivots.T)
        near = np.argpartition(far, NEAREST - 1, axis=1)[:, :NEAREST]
        out.append(np.take_along_axis(near, np.lexsort((near, np.take_along_axis(far, near, axis=1)), axis=1), axis=1))
    return np.concatenate(out)


def lists_of(nearest: np.ndarray) -> np.ndarray:
    """The lists [vectors, trios] that vectors with these nearest pivots stand in: a trio's pivots in ascending order, 21 bits each."""
    s = np.sort(nearest.astype(np.int64)[:, TRIOS], axis=2)
    return (s[:, :, 0] << 42) | (s[:, :, 1] << 21) | s[:, :, 2]


def elsewhere(link: np.ndarray, lists: np.ndarray, here: int) -> np.ndarray:
    """The links of a small symmetric matrix without those whose pair shares a list before this one."""
    link = link.copy()
    one, other = np.nonzero(np.triu(link))
    for lo in range(0, len(one), PAIRS_AT_ONCE):
        a, b = one[lo : lo + PAIRS_AT_ONCE], other[lo : lo + PAIRS_AT_ONCE]
        shared = (lists[a][:, :, None] == lists[b][:, None, :]).any(axis=2)
        late = np.where(shared, lists[a], np.iinfo(np.int64).max).min(axis=1) != here
        link[a[late], b[late]] = link[b[late], a[late]] = False
    return link


def usable(vector: str, label: str) -> Column:
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & x.isNotNull() & sound & F.exists(x, lambda v: v != 0), F.lit(False))


def _labels(link: np.ndarray) -> np.ndarray:
    """Least index reachable through the links of a small symmetric matrix."""
    now = np.arange(len(link))
    while True:
        after = np.minimum(now, np.where(link, now[None, :], len(link)).min(axis=1, initial=len(link)))
        after = after[after]
        if (after == now).all():
            return now
        now = after


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept.

    Vectors link when their labels are equal and not null, they have as many components, and their cosine reaches the
    threshold. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing. Rows that
    repeat an id should repeat its vector and count once; a null id links with nothing and keeps component_id null. Other
    columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable("v", "label") & F.col("vec_id").isNotNull()).withColumns({"k1": F.xxhash64("label", "v"), "k2": F.hash("v", "label")})
    keys = stash(rows.select("vec_id", "ok", "k1", "k2"))
    classes = stash(keys.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies")))
    nodes = rows.where("ok").join(classes.withColumnRenamed("node", "vec_id").select("vec_id", "copies"), "vec_id").dropDuplicates(["vec_id"])
    count = pivot_count(classes.count())
    sample = [r["v"] for r in rows.where("ok").orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").select("v").limit(max(LEAST_SAMPLE, SAMPLE_RATE * count)).collect()]
    held = vectors.sparkSession.sparkContext.broadcast(draw_pivots(sample, count))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            nearest = np.zeros((len(values), NEAREST), dtype=np.int64)
            sizes = np.array([len(v) for v in values])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                pivots = held.value.get(dim)
                nearest[at] = describe(np.array([values[i] for i in at], dtype=np.float64), unit(random_pivots(dim, count)) if pivots is None else pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(1), pa.array(nearest.tolist(), pa.list_(pa.int32())), pa.array(lists_of(nearest).tolist(), pa.list_(pa.int64()))], names=["node", "copies", "place", "v", "nearest", "lists"])

    # place keeps labels and dimension counts apart in the index.
    nodes = nodes.select("vec_id", "v", "copies", F.concat_ws(":", F.size("v").cast("string"), F.col("label").cast("string")).alias("place"))
    known = stash(nodes.mapInArrow(index, "node bigint, copies bigint, place string, v array<double>, nearest array<int>, lists array<bigint>"))
    entries = known.select("node", "place", F.explode("lists").alias("trio"))
    token = ["place", "trio"]
    counted = entries.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*token))).where("m > 1").withColumn("parts", F.ceil(F.col("m") / BLOCK))
    own = counted.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # Cell (i, j) compares block i with block j; a node of block p stands in cells (p, j >= p) and (i < p, p).
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select(*token, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node")
    full = cells.join(known.select("node", "v", "copies", "nearest"), "node")
    held_rows = full.groupBy(*token, "i", "j").agg(F.sort_array(F.collect_list(F.struct("node", "part", "copies", "nearest", "v"))).alias("rows"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for trio, i, j, cell in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), (x.values for x in batch.column(3)), strict=True):
                node, part, copies = (np.asarray(cell.field(k)) for k in range(3))
                v = near_one(np.asarray(cell.field(4).flatten(), dtype=np.float64).reshape(len(node), -1))
                size = np.linalg.norm(v, axis=1)
                link = (v @ v.T) / np.outer(size, size) >= threshold
                np.fill_diagonal(link, False)
                if i != j:
                    link &= part[:, None] != part[None, :]
                has = np.flatnonzero(link.any(axis=1))
                if len(has):
                    near = np.asarray(cell.field(3).flatten()).reshape(-1, NEAREST)
                    node, copies = node[has], copies[has]
                    link = elsewhere(link[np.ix_(has, has)], lists_of(near[has]), trio)
                    has = link.any(axis=1)
                    out.append((node[has], (link * copies[None, :]).sum(axis=1)[has], node[_labels(link)][has]))
            node, n, to = (np.concatenate([o[k] for o in out]) if out else np.empty(0, dtype=np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int64)), pa.array(to)], names=["node", "n", "to"])

    found = stash(held_rows.select("trio", "i", "j", "rows").mapInArrow(verify, "node bigint, n bigint, to bigint"))
    discard(known)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    by_class = classes.join(counts, "node", "left").join(groups, "node", "left")
    by_class = by_class.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    joined = keys.join(by_class, F.col("ok") & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
