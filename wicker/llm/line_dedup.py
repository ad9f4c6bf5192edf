"""Fuzzy line dedup.

Lines are normalised (lower case, no ASCII punctuation, single spaces). Equal ones, by 128 bits of hash, are one node. An
edit of a word changes two of a line's word pairs at most, so lines within the edit distance share many pairs, and one at
least of the rarest of each (prefixes under one order of all pairs): these are the index tokens. Candidates whose parity
maps of words do not rule it out are verified by the edit similarity of their words, and of every connected group one
occurrence stays: the first by document id, then by place in the document. Every pair of lines that reaches the
similarity is found.

SimHash with pigeonhole blocks cannot do this: at an edit similarity of 0.9 the 64 sign bits of ten words differ in nine,
beyond any radius that blocks can join on. A parity map keeps the idea with a bound: an edit flips two bits at most.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.common import by_marks, discard, documents, hash_words, id_marks, kept, marked_rows, mix, slices, stash, texts_of
from wicker.llm.linking import REST_BITS, find_groups
from wicker.llm.ngram_join import CHUNK, COUNTERS, classes_of

SIMILARITY = 0.8
#: Bits of a line's parity map.
MAP_BITS = 256
PUNCTUATION = string.punctuation.encode()


def normal_lines(text: str | None) -> list[list[bytes]]:
    """The words of each line, normalised; line k is line k of text.split(newline)."""
    if text is None:
        return []
    return [line.split() for line in text.lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split(b"\n")]


def edit_similarity(a: list[str], b: list[str], at_least: float) -> float:
    """1 - edit distance of the words / longer length; 0 as soon as it is clear that at_least is out of reach.

    A column of the distance table is held as two integers, the places where it rises and where it falls.
    """
    longer = max(len(a), len(b))
    limit = int((1 - at_least) * longer + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return 0.0
    lo, short = 0, min(len(a), len(b))
    while lo < short and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < short - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = sorted((a[lo : len(a) - hi], b[lo : len(b) - hi]), key=len)
    distance = len(x)
    if not distance:
        return 1 - len(y) / longer if longer else 1.0
    where: dict[str, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    full, last = (1 << len(x)) - 1, 1 << (len(x) - 1)
    up, down = full, 0
    for left, w in zip(range(len(y) - 1, -1, -1), y, strict=True):
        same = where.get(w, 0)
        level = same | down
        flat = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(flat | up)), up & flat
        distance += 1 if rises & last else -1 if falls & last else 0
        if distance - left > limit:
            return 0.0
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = falls | (full & ~(level | rises)), rises & level
    return 1 - distance / longer


def edits(longer: np.ndarray | int, similarity: float) -> np.ndarray:
    """Edits that lines may differ in when the longer one has so many words, as edit_similarity counts them."""
    return np.floor((1 - similarity) * longer + 1e-9).astype(np.int64)


def words_a_token(similarity: float) -> int:
    """Pairs of words where enough of them outlast the edits, else single words."""
    return 2 if similarity >= 0.7 else 1


def prefix_length(size: int, similarity: float) -> int:
    """Tokens of a line of that size that go into the index: all but those that each line alike must share, and one."""
    each = words_a_token(similarity)
    longer = np.arange(size, int(size / similarity + 1e-9) + 1)
    shared = longer + each - 1 - each * edits(longer, similarity)
    return size + each - int(shared.min())


def line_tokens(lines: list[list[bytes]], each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line, token of each run of `each` words (pairs reach over both ends of a line), and the hash of each word."""
    counts = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    h = hash_words([w for line in lines for w in line])
    if each == 1:
        return np.repeat(np.arange(len(lines)), counts), mix(h), h
    ends = np.cumsum(counts)
    # One more token than words: each word with the one before it, and the last with the end.
    left, right = np.insert(h, ends - counts, 0), np.insert(h, ends, 0)
    return np.repeat(np.arange(len(lines)), counts + 1), mix(left * np.uint64(0x9E3779B97F4A7C15) + right), h


def parity_maps(lines: list[list[bytes]], h: np.ndarray) -> np.ndarray:
    """Bytes [line, MAP_BITS / 8]: which places an odd number of a line's words falls on."""
    line = np.repeat(np.arange(len(lines)), np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)))
    cells = np.bincount(line * MAP_BITS + (h >> np.uint64(40)).astype(np.int64) % MAP_BITS, minlength=len(lines) * MAP_BITS)
    return np.packbits((cells & 1).astype(np.uint8).reshape(-1, MAP_BITS), axis=1)


def prefixes(lines: list[list[bytes]], line: np.ndarray, token: np.ndarray, classes: np.ndarray, each: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index tokens of all lines, one after another, rarest first, and how many each line has.

    The order is by frequency class, hash and which repeat of its token in the line it is; a repeat is a token of its own.
    """
    key = (classes[token % np.uint64(COUNTERS)].astype(np.uint64) << np.uint64(57)) | (token >> np.uint64(7))
    order = np.argsort(key)
    order = order[np.argsort(line[order].astype(np.uint16 if len(lines) < 1 << 16 else np.int64), kind="stable")]
    key, line = key[order], line[order]
    at = np.arange(len(key))
    fresh = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])] if len(key) else np.empty(0, dtype=bool)
    again = at - np.maximum.accumulate(np.where(fresh, at, 0))
    key = np.where(again > 0, mix(key + again.astype(np.uint64)), key)
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    lengths = {n: prefix_length(n, similarity) for n in np.unique(sizes).tolist()}
    prefix, tokens = np.array([lengths[n] for n in sizes.tolist()], dtype=np.int64), sizes + each - 1
    start = np.cumsum(tokens) - tokens
    return key[at - np.repeat(start, tokens) < np.repeat(prefix, tokens)].astype(np.int64), prefix


def scan(docs: DataFrame, similarity: float, least: int) -> DataFrame:
    """Two kinds of rows (stashed): every line with a word (doc_id, version, line, node and more: 128 bits of its hash, size, and from `least` words on its parity map sig), and counts of the tokens of these longer lines (chunk, counts). docs: doc_id, version, text."""
    each = words_a_token(similarity)
    kinds = {"doc_id": pa.int64(), "version": pa.int64(), "line": pa.int32(), "node": pa.int64(), "more": pa.int64(), "size": pa.int64(), "sig": pa.binary(), "chunk": pa.int64(), "counts": pa.binary()}

    def rows(n: int, **columns: np.ndarray | list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("lines", dict)
        table = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lines = [normal_lines(t) for t in texts_of(part)]
                real = [np.array([k for k, line in enumerate(x) if line], dtype=np.int32) for x in lines]
                own = [line for x in lines for line in x if line]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(line)) for line in own), dtype=">u8").astype(np.uint64).astype(np.int64).reshape(-1, 2)
                n = np.array([len(x) for x in real])
                doc, version = (np.repeat(np.asarray(part.column(k), dtype=np.int64), n) for k in (0, 1))
                sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
                long = [line for line in own if len(line) >= least]
                _, token, h = line_tokens(long, each)
                maps = iter(parity_maps(long, h))
                sig = [next(maps).tobytes() if n >= least else None for n in sizes.tolist()]
                yield rows(len(own), doc_id=doc, version=version, line=np.concatenate(real) if real else [], node=digest[:, 1].copy(), more=digest[:, 0].copy(), size=sizes, sig=sig)
                np.add.at(table, token % np.uint64(COUNTERS), 1)
        chunks = table.reshape(-1, CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield rows(len(used), chunk=used, counts=[zlib.compress(chunks[i].tobytes(), 1) for i in used])

    return stash(docs.select("doc_id", "version", "text").mapInArrow(run, "doc_id bigint, version bigint, line int, node bigint, more bigint, size bigint, sig binary, chunk bigint, counts binary"))


def node_of(line: list[bytes]) -> int:
    return xxhash.xxh3_128_intdigest(b" ".join(line)) & (2**64 - 1)


def index_tokens(docs: DataFrame, classes: np.ndarray, similarity: float, least: int) -> DataFrame:
    """node, size, prefix (index tokens) of the lines of at least so many words; a line may come once from each slice of the texts."""
    each = words_a_token(similarity)
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lines = {node_of(line): line for t in texts_of(part) for line in normal_lines(t) if len(line) >= least}
                words = list(lines.values())
                line, token, _ = line_tokens(words, each)
                keys, counts = prefixes(words, line, token, held.value, each, similarity)
                nodes = np.fromiter(lines, dtype=np.uint64, count=len(lines)).astype(np.int64)
                found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([len(w) for w in words], pa.int64()), found], names=["node", "size", "prefix"])

    return docs.select("text").mapInArrow(run, "node bigint, size bigint, prefix array<bigint>")


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, words of the lines in wanted (node, doc_id)."""
    held, place = id_marks(wanted.select(F.col("doc_id").alias("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(marked_rows(batch, held.value, 1), "text", 1 << 20):
                lines = {node_of(line): b" ".join(line) for t in texts_of(part) for line in normal_lines(t) if line}
                nodes = np.fromiter(lines, dtype=np.uint64, count=len(lines)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.decode("utf-8", "replace") for x in lines.values()], pa.string())], names=["node", "words"])

    found = docs.select("text", place(F.col("doc_id")).alias("place")).mapInArrow(run, "node bigint, words string")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, version, drop (line numbers to drop, from 0; stashed) of documents (doc_id, version, text) that lose a line."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    real = docs.where("doc_id IS NOT NULL")
    each = words_a_token(similarity)
    # The longer line of a pair has five words at least (at 0.8), or one edit already leaves less; shorter ones only match when equal.
    least = max(1, int(np.ceil(1 / (1 - similarity) - 1e-9)) - 1) if similarity < 1 else 1 << 62
    scanned = scan(real, similarity, least)
    seen = scanned.where("chunk IS NULL").select("doc_id", "version", "line", "node", "more")
    lines = scanned.where("chunk IS NULL").groupBy("node", "more")
    nodes = stash(lines.agg(F.min(F.struct("doc_id", "version", "line")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig")))
    fuzzy = index_tokens(real, classes_of(scanned.where("chunk IS NOT NULL").select("chunk", "counts")), similarity, least)
    rest = F.least(F.col("size") + (each - 1) - F.col("nth"), F.lit((1 << REST_BITS) - 1))
    entries = fuzzy.select("node", "size", F.posexplode("prefix").alias("nth", "token")).select("token", "node", F.shiftleft("size", REST_BITS).bitwiseOR(rest).alias("place"))
    payload = nodes.where("sig IS NOT NULL").select("node", "size", "sig")

    def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        longer = np.maximum(n, m)
        return longer + each - 1 - each * edits(longer, similarity)

    def limit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        # A replaced word changes two bits at most, an added one a single bit.
        most, apart = edits(np.maximum(n, m), similarity), np.abs(n - m)
        return np.where(apart <= most, 2 * most - apart, -1)

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = stash(ends.join(nodes.select("node", F.col("first.doc_id").alias("doc_id")), "node"))
        words = stash(line_texts(real, wanted))
        both = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("of_a")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("of_b")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (c.to_pylist() for c in (batch.column(2), batch.column(3)))
                alike = [edit_similarity(x.split(" "), y.split(" "), similarity) >= similarity - 1e-9 for x, y in zip(a, b, strict=True)]
                yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

        linked = stash(both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint"))
        discard(words, wanted)
        return linked

    groups = find_groups(entries, payload, limit, need, verify, similarity)
    grouped = nodes.join(groups, "node", "left").where("n > 1 OR component IS NOT NULL")
    key = F.when(F.col("component").isNull(), F.struct("node", "more")).otherwise(F.struct(F.col("component").alias("node"), F.lit(0).cast("long").alias("more")))
    grouped = grouped.select("node", "more", "first", key.alias("group"))
    stays = grouped.groupBy("group").agg(F.min("first").alias("stay"))
    stay = stash(grouped.select("node", "more", "group").join(stays, "group").select("node", "more", "stay"))
    gone = seen.join(stay, ["node", "more"]).where(F.struct("doc_id", "version", "line") != F.col("stay"))
    found = stash(gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.col("line").cast("long"))).alias("drop")))
    discard(scanned, nodes, stay)
    return found


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with repeated lines taken out of the text, and two columns more: n_lines, n_dropped.

    Lines without a word (blank, or punctuation only) stay and are never compared. Null text stays null with no lines.
    Rows with a null id are left as they are. Rows that repeat id and text count as one document. A document may be left
    with an empty text. Other columns pass through; an empty table gives no rows. Texts are read whole.
    """
    rows = docs.withColumns({"_line_id": F.col(id_col).cast("long"), "_line_version": F.xxhash64(text_col)})
    gone = duplicate_lines(rows.select(F.col("_line_id").alias("doc_id"), F.col("_line_version").alias("version"), F.col(text_col).alias("text")), similarity)
    held, place = id_marks(gone.select(F.col("doc_id").alias("id")))
    gone = gone.select(F.col("doc_id").alias("_drop_id"), F.col("version").alias("_drop_version"), F.col("drop").alias("_line_drop"))
    # Only documents that may lose a line meet the answers in a shuffle of their texts.
    touched, others = by_marks(rows.withColumn("_line_place", F.when(F.col("_line_id").isNotNull(), place(F.col("_line_id")))), held, "_line_place")
    joined = touched.join(gone, (F.col("_line_id") == F.col("_drop_id")) & (F.col("_line_version") == F.col("_drop_version")), "left")
    joined = joined.drop("_drop_id", "_drop_version").unionByName(others.withColumn("_line_drop", F.lit(None).cast("array<bigint>")))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_line_drop", i.cast("long"))), "\n")
    text = F.when(F.col("_line_drop").isNull(), F.col(text_col)).otherwise(kept)
    own = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*own, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_line_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")
