"""Interaction of five document filters: what each removes, alone and after others, in every order.

A to D look at one document. E marks documents whose text some smaller id has too: a left-semi join on the text's hash,
the exact text and a smaller id. Its marks are united with the other failures, and from then on only counts of failure
combinations (32 a part) are left; every order of the filters is arithmetic on these.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.common import discard, documents, stash

FILTERS = "ABCDE"
#: Fixed values of the filters: fewest words, least percentage of distinct words, most percentage of capitals, signs not allowed.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
DUPLICATE = 1 << FILTERS.index("E")
#: Copies of a text that one task compares with the smallest id, and parts that each hash is dealt to when copies are looked for.
COPIES, SALTS = 256, 32


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _words: maximal runs without ASCII white space."""
    plain = F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " ")
    return docs.withColumn("_words", F.array_remove(plain, ""))


def failure_bits(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits: bit k is set where the document fails the k-th of the filters A to D."""
    n = F.size("_words")
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed: list[Column] = [n < LEAST_WORDS, 100 * F.size(F.array_distinct("_words")) < LEAST_DISTINCT * n, 100 * capitals.cast("long") > MOST_CAPITALS * F.length("text"), F.col("text").rlike(SIGNS)]
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failed)), F.lit(0))
    return with_words(docs).select("doc_id", "part", bits.alias("bits"))


def later_copies(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of docs (doc_id, part, text) whose text a smaller doc_id has, and the tables to discard once they are written.

    First only hashes are counted. Texts are shuffled where their hash stands for more than one id; each hash is dealt
    to SALTS parts, and then each text to one part for COPIES rows, so that no group of copies meets in one task.
    """
    hashed = docs.where("doc_id IS NOT NULL").withColumn("_hash", F.xxhash64("text"))
    repeated = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("_hash", "_n")
    known = stash(repeated)
    salts = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = hashed.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    suspects = stash(salted.join(salts, ["_hash", "_salt"]).drop("_salt"))
    deals = F.ceil(F.col("_n") / COPIES)
    firsts = suspects.groupBy("_hash", "text").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.min("_n").alias("_n")).where("_first < _last")
    firsts = firsts.select(F.col("_hash").alias("_h"), F.col("text").alias("_t"), "_first", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)).alias("_d"))
    dealt = suspects.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), deals))
    same = (F.col("_hash") == F.col("_h")) & (F.col("_deal") == F.col("_d")) & (F.col("text") == F.col("_t")) & (F.col("_first") < F.col("doc_id"))
    return dealt.join(firsts, same, "left_semi").select("doc_id", "part", "text"), [known, suspects]


def combinations(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """part and the arrays n, good, toxic: documents, and those labelled so, for each of the 32 combinations of failures. Also the table to discard later."""
    copies, made = later_copies(docs)
    marked = failure_bits(copies)
    # A marked row moves from its combination without E to the one with it, so that no join by id has to find it again.
    moves = [failure_bits(docs).withColumn("k", F.lit(1)), marked.withColumn("k", F.lit(-1)), marked.withColumn("bits", F.col("bits") + DUPLICATE).withColumn("k", F.lit(1))]
    united = stash(moves[0].unionByName(moves[1]).unionByName(moves[2]))
    discard(*made)
    known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = united.groupBy("part", "bits").agg(F.sum("k").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    lost = united.join(known, "doc_id").groupBy("part", "bits").agg(F.lit(0).cast("long").alias("n"), F.sum(F.col("k") * F.col("good")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))
    every = counted.unionByName(lost)
    of = lambda c: F.array(*[F.sum(F.when(F.col("bits") == b, F.col(c)).otherwise(0)) for b in range(1 << len(FILTERS))]).alias(c)
    return every.groupBy("part").agg(of("n"), of("good"), of("toxic")), united


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per part, order of the five filters and step.

    Null texts are empty (they fail A only), null sources are the part ''. Null ids are kept as documents, never copies
    and never labelled. Rows of one id and one text are no copies of each other and count each; labels of an id given
    more than once count if any row says so. Texts are compared whole. An empty table gives no rows; other columns are
    not read.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts, _ = combinations(read, labels)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counts.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    rows = rows.withColumn("_own", bit(F.col("filter"))).withColumn("_before", F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("at")), F.lit(0), lambda done, letter: done + bit(letter)))

    def total(values: str, wanted) -> Column:
        kept = F.transform(F.col(values), lambda v, b: F.when(wanted(b), v).otherwise(F.lit(0).cast("long")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, v: a + v)

    own, before = F.col("_own"), F.col("_before")
    fails = lambda b: b.bitwiseAND(own) != 0
    late = lambda b: b.bitwiseAND(before) != 0
    here = lambda b: fails(b) & ~late(b)
    # In orders of all filters, a document goes by each of the filters it fails equally often.
    orders_each = F.transform(F.col("n"), lambda v, b: F.when(fails(b), v * (F.lit(120) / F.greatest(F.bit_count(b), F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter",
        total("n", lambda b: ~fails(b) & ~late(b)).alias("kept"), total("n", here).alias("removed"), total("n", lambda b: fails(b) & late(b)).alias("redundant"),
        total("n", lambda b: b == own).alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        F.aggregate(orders_each, F.lit(0).cast("long"), lambda a, v: a + v).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL
), bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL
), f AS (
  SELECT part, coalesce(doc_id IN (SELECT doc_id FROM good), FALSE) AS good, coalesce(doc_id IN (SELECT doc_id FROM bad), FALSE) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < doc_id THEN 'E' ELSE '' END AS failed
  FROM w
), c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2
), one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
), s AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, contains(failed, filter_order[step]) AS fails,
    len(list_filter(string_split(failed, ''), lambda x: x <> '' AND contains(left(filter_order, step - 1), x))) > 0 AS late, length(failed) AS size
  FROM c, steps
), r AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT late), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT late), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE fails AND late), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails AND size = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails AND NOT late), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT late), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY 1, 2, 3, 4
), v AS (SELECT part, filter, sum(removed)::BIGINT AS shapley FROM r GROUP BY 1, 2)
SELECT part, filter_order, step::INTEGER AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM r JOIN v USING (part, filter)
"""
