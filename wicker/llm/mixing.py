"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Targets: sources share the word budget by weight, none beyond `max_epochs` times its own words (the excess is reshared
by weight). Every document enters the queue once per epoch. Documents of a source stand in a shuffled order fixed by an
MD5 of their id; a copy's virtual finish time is the words its source has sent up to and with it, divided by the
source's target. The mix is the copies in order of finish time up to the word budget. Running sums go over runs of the
shuffled order and over ranges of finish time, so that no task holds a whole source or the whole mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.llm.common import documents, stash

WORD = "[^\\x20\\x09-\\x0D]+"
#: Ranges of finish time per unit; at time 1 every source has sent its target.
TIME_RANGES = 4096
WEIGHTS = (5, 2, 1)


def targets(per_source: DataFrame, weights: tuple[int, ...], budget_share: float, max_epochs: int) -> DataFrame:
    """source, source_size, target. Water-filling in closed form: sources leave at their cap in order of cap per weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    s = per_source.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("fill", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(budget_share))
    capped = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sharing = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("budget") - capped) / sharing)
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", F.col("source").isNull().alias("last"), "source", "level"))).over(every)
    s = s.withColumn("level", F.coalesce(level["level"], F.max("fill").over(every)))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"), "budget")


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


def queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, max_epochs: int = 2, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every copy in the queue: row key, at (hash of id, source and text), doc_id, source, size, source_size, target, epoch, finish, position (words sent before it and with it), taken (boolean)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), row_hash(id_col, source_col, text_col).alias("at"))
    shuffled = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("#" + seed)))
    sized = stash(sized.withColumn("h", shuffled).withColumn("run", F.substring("h", 1, 3)))
    runs = sized.groupBy("source", "run").agg(F.sum("size").alias("words"))
    per_source = runs.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    t = targets(per_source, weights, budget_share, max_epochs).withColumnRenamed("source", "t_source")
    runs = stash(runs.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", "words"))
    runs = runs.withColumnsRenamed({"source": "r_source", "run": "r_run"})
    inside = Window.partitionBy("source", "run").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sent = sized.join(runs, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("run") == F.col("r_run")))
    sent = sent.withColumn("sent", F.col("start") + F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
    copies = sent.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
    finish = (F.col("epoch") * F.col("source_size") + F.col("sent")) / F.col("target")
    copies = copies.withColumn("finish", F.when(F.col("target") > 0, finish).otherwise(F.lit(float("inf"))))
    copies = copies.withColumn("span", F.least(F.floor(F.least(F.col("finish"), F.lit(1e6)) * TIME_RANGES), F.lit(2 * TIME_RANGES)).cast("int"))
    copies = copies.withColumn("part", F.when(F.col("span") == 2 * TIME_RANGES, F.col("run")))
    # Within the queue, copies beyond time 2 are never reached; they keep the same order but are numbered by run too.
    spans = copies.groupBy("span", "part").agg(F.sum("size").alias("words"))
    ahead = Window.orderBy("span", "part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("span").alias("s_span"), F.col("part").alias("s_part"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    fair = Window.partitionBy("span", "part").orderBy("finish", F.col("source").asc_nulls_last(), "h", "doc_id", "epoch", "nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = copies.join(spans, (F.col("span") == F.col("s_span")) & F.col("part").eqNullSafe(F.col("s_part")))
    placed = placed.withColumn("position", F.col("ahead") + F.sum("size").over(fair)).withColumn("taken", (F.col("position") <= F.col("budget")) & F.col("finish").isNotNull())
    return placed.select("doc_id", "source", "h", "nth", "run", "size", "source_size", "target", "epoch", "finish", "position", "taken", "at")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null or empty text has size 0 and adds nothing; null sources form one source that comes last. A source without
    words has target 0. Repeated rows each keep their own place (ties are broken by a row number among equal rows, which
    are interchangeable). An empty table gives no rows; other columns are not read. Reruns agree.
    """
    q = queue(docs, **options)
    by_row = q.groupBy("doc_id", "source", "run", "h", "nth", "size").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
    return by_row.select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input rows in mix order, once per copy taken, range-sorted by position; input columns only.

    Rows with null or empty text are in no mix. Rows that repeat id, source and text are told apart by a row number, and
    are interchangeable. Texts are shuffled twice: to meet their places, and by place. Only repeated rows are numbered,
    from the same exchange.
    """
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    q = queue(docs, **options).select(F.col("at").alias("_mix_to"), F.col("epoch").alias("_mix_epoch"), F.col("position").alias("_mix_position"), F.col("size").alias("_mix_size"), F.col("taken").alias("_mix_taken"))
    q = q.withColumn("_mix_rows", F.sum(F.when(F.col("_mix_epoch") == 0, 1).otherwise(0)).over(Window.partitionBy("_mix_to")))
    places = q.where(F.col("_mix_taken") & (F.col("_mix_size") > 0))
    rows = docs.withColumn("_mix_at", row_hash(id_col, source_col, text_col))
    here = F.col("_mix_at") == F.col("_mix_to")
    single = rows.join(places.where("_mix_rows = 1").select("_mix_to", "_mix_position"), here)
    # The k-th of equal rows takes the k-th place of each epoch.
    nth = F.row_number().over(Window.partitionBy("_mix_to", "_mix_epoch").orderBy("_mix_position"))
    repeated = q.where("_mix_rows > 1").withColumn("_mix_k", nth).where(F.col("_mix_taken") & (F.col("_mix_size") > 0)).select("_mix_to", "_mix_k", "_mix_position")
    equal = rows.join(q.where("_mix_rows > 1").select("_mix_to").distinct(), here, "left_semi").withColumn("_mix_row", F.row_number().over(Window.partitionBy("_mix_at").orderBy(F.col(id_col), F.col(source_col))))
    again = equal.join(repeated, here & (F.col("_mix_row") == F.col("_mix_k")))
    joined = single.select(*docs.columns, "_mix_position").unionByName(again.select(*docs.columns, "_mix_position"))
    return joined.orderBy("_mix_position").select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || '#mix-1') AS h FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s
), f AS (
  SELECT *, cap / weight AS fill FROM w
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f
), t AS (
  SELECT source, source_size, budget, least(cap, weight * coalesce((SELECT level FROM l WHERE level <= fill ORDER BY fill, source NULLS LAST LIMIT 1), (SELECT max(fill) FROM l))) AS target FROM l
), q AS (
  SELECT d.doc_id, d.source, d.h, d.size, t.source_size, t.target, t.budget, e.epoch,
         (e.epoch * t.source_size + sum(d.size) OVER (PARTITION BY d.source, e.epoch ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING)) / t.target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) e(epoch)
), p AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, h, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS position FROM q
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, sum(CASE WHEN position <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM p GROUP BY doc_id, size, source_size, target
"""
