"""URL filters: logistic regression on hashed character n-grams of host and path, with rules for known hosts on top.

Host and path are cut out by Column expressions, and rules are matched there too. The model is fitted on a small labelled
table of URLs (a bounded sample); scoring runs over Arrow batches, with rolling hashes over all characters of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.common import mix, slices

#: Rows that the fit reads at most, drawn by a hash of the URL; n-gram lengths in bytes, and bits of their hash.
MAX_LABELLED, LENGTHS, BITS = 20_000, (3, 4, 5), 16
#: Rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The labelled table is written from names of sites to block and to keep, put together by hand for this purpose.
UNWANTED = """
royal-casino casino-jackpot lucky-casino-slots best-online-casino casino-king casino-spins casino-bonus free-slots-win free-spins win-big-poker poker-bonus pokerwin roulette-win win-jackpot
bets365-free sports-bets best-bets bet-now football-bets freebet-tips top-betting free-bets-today cheap-viagra cheap-meds-online discount-pills pills-shop buy-pills-cheap diet-pills weight-loss-pills cheap-cialis
payday-loans quick-loan-cash easy-cash-now fast-money-online get-rich-quick cheap-watches-replica replica-bags cheap-essays buy-cheap-followers
adult-cams adult-video adult-dating adult-xxx hot-xxx-video sexy-chat porn-tube free-porn xxx-live x-rated torrent-crack keygen-free-download warez-full free-iphone-winner you-win-prize click-here-win
ads-server track-ads ad-tracker ads-click banner-ads tracking-ads track-click spam-links link-farm spam-site content-farm-spam spam-mail seo-spam-farm
"""
WANTED = """
news station the-thread theory nation science weather library museum university history-of-towns cooking garden music-school river mountain-walks city-hall hospital school post-office travel trains
open-source developer physics mathematics translation editor encyclopedia dictionary chess-club football-club theatre cinema parliament court energy water forest ocean
bakery bookshop pharmacy-school medicine finance-news insurance thether onering tionhe stan ring ble thand therst inger andth hering thin thest these that thwh thre then theory-of-the-other
"""
#: What stands around a name, the same for both classes.
BEFORE, AFTER, TOPS = ("", "www.", "m.", "blog."), ("/en/12", "/fr/7.html", "/de/904/", "/es/3?page=2", "/", "/articles/light", "/en/1520#top"), ("com", "org", "net")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first :// and the first of / ? #, A-Z lower-cased, and from there to the first of ? #; both '' without a ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)([^?#]*)", 2)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits the host or a domain above it and begins the path; of equal ones the first; null without one."""
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + start))
        chosen = F.coalesce(chosen, F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return chosen


def grams(hosts: list[str | None], paths: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of `^host$` and of the path, and n-grams a row. Host and path have buckets of their own as far as hashes tell."""
    owners, buckets = [], []
    for kind, texts in enumerate(([f"^{h or ''}$" for h in hosts], [p or "" for p in paths])):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        octets, of = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64), np.repeat(np.arange(len(raw)), sizes)
        for n in LENGTHS:
            if len(octets) < n:
                continue
            inside = of[n - 1 :] == of[: len(of) - n + 1]
            h = np.full(len(octets) - n + 1, 2 * n + kind, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + octets[j : len(octets) - n + 1 + j] + np.uint64(1)
            owners.append(of[n - 1 :][inside])
            buckets.append((mix(h[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
    none = np.zeros(0, dtype=np.int64)
    owner, bucket = np.concatenate([none, *owners]), np.concatenate([none, *buckets])
    return owner, bucket, np.bincount(owner, minlength=len(hosts))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def linear(owner: np.ndarray, bucket: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of a row's n-gram weights over the root of their number."""
    return np.bincount(owner, weights=weight[bucket], minlength=len(counts)) / np.sqrt(np.maximum(counts, 1))


def fit(hosts: list[str], paths: list[str], labels: np.ndarray, prior: float = 0.2, steps: int = 1500, rate: float = 4.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights, the bias last, by gradient descent on the logistic loss with a ridge; the rows to block weigh `prior` of all, whatever their share of the table. One class only: its own answer for all."""
    w = np.zeros((1 << BITS) + 1)
    if not len(labels) or labels.min() == labels.max():
        w[-1] = 0.0 if not len(labels) else 5.0 * (2 * labels[0] - 1)
        return w
    owner, bucket, counts = grams(hosts, paths)
    share = np.where(labels == 1, prior / labels.sum(), (1 - prior) / (len(labels) - labels.sum()))
    scale = 1 / np.sqrt(np.maximum(counts, 1))
    for _ in range(steps):
        wrong = share * (sigmoid(linear(owner, bucket, counts, w[:-1]) + w[-1]) - labels)
        w[:-1] -= rate * (np.bincount(bucket, weights=(wrong * scale)[owner], minlength=1 << BITS) + ridge * w[:-1])
        w[-1] -= rate * wrong.sum()
    return w


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block): every name four times, in surroundings that go round alike in both classes, so that these say nothing."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def labelled_rows() -> list[tuple[str, int]]:
    """The small labelled table, some 500 rows."""
    of = lambda name, j: f"https://{BEFORE[j % 4]}{name}.example.{TOPS[j % 3]}{AFTER[j % 7]}"
    return [(of(name, 5 * k + j), label) for label, table in ((1, UNWANTED), (0, WANTED)) for k, name in enumerate(table.split()) for j in range(4)]


def train(labelled: DataFrame, most: int = MAX_LABELLED) -> np.ndarray:
    """Fit on labelled (url, label), at most `most` rows of it, drawn by a hash of the URL. Null labels and URLs are not used; an empty table gives a score of one half throughout."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(host.alias("host"), path.alias("path"), F.col("label").cast("int").alias("label"), F.xxhash64("url").alias("drawn"))
    found = rows.orderBy("drawn", "host", "path", "label").limit(most).toPandas()
    return fit(found["host"].tolist(), found["path"].tolist(), found["label"].to_numpy(dtype=np.float64))


def judge(pages: DataFrame, model: np.ndarray, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (0 to 1, higher: block): one row per row of pages.

    The longest rule that fits decides; without one, a score of at least `threshold` blocks. Null URLs and those without
    :// have an empty host and path and the score of an empty URL. URLs of any length are read whole; null ids and
    repeated rows are kept; other columns are not read; an empty table gives no rows.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    chosen = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", chosen.alias("chosen")).select("page_id", "host", "path", "chosen.rule", "chosen.verdict")
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for by_path in slices(batch, "path"):
                for part in slices(by_path, "host"):
                    score = sigmoid(linear(*grams(part.column(1).to_pylist(), part.column(2).to_pylist()), w[:-1]) + w[-1])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    of_id = pages.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"page_id {of_id}, host string, path string, rule string, verdict string, score double")
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(labelled_urls(spark)))
