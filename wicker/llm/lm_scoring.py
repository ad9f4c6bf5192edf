"""Stupid-backoff scores of every document under n-gram counts of the rest of the corpus.

Documents are dealt into blocks. A block sends its distinct trigrams with their counts to the partition of their last
two words' hash (exploded n-grams, packed and counted before the shuffle); its distinct words go to the partition of
their own hash. Frequent words go as places in a code book that all tasks hold, others as hashes; the book, from a
sample, only makes messages small, and any book gives the same counts. Each partition sums its part of the count tables
over all blocks, a range of hashes at a time, and answers every block in the order it asked. A block then joins the answers to its documents' n-grams and sums log scores per document. A bigram's count is
the sum over the trigrams that end in it, as text starts are padded, so a trigram's partition holds its bigram too.

Score of word c after a b, with counts f over all documents but the one that is scored (so that a text's own n-grams do
not vouch for it, and no n-gram has to be dropped for being rare): f(abc) / f(ab) if abc occurs there; else
0.4 * f(bc) / f(b) if bc does; else 0.16 * f(c) / N if c does; else 0.064 / N.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.common import ascii_words, documents, hash_words, mix, slices, stash, texts_of

ALPHA = 0.4
#: Text bytes per block, and words that one partition of the count tables sums, about.
BLOCK_BYTES, PARTITION_WORDS = 16 << 20, 5_000_000
#: Text bytes of which the words are held one by one.
SLICE_BYTES = 1 << 20
#: Words in the code book, documents that it is made from (about), bits of a hash that tell the ranges that are summed one after another.
BOOK_WORDS, BOOK_DOCS, RANGE_BITS = 1 << 17, 20_000, 4
#: Stands before each text's first word, twice.
START = np.uint64(0x5EED0F57A27)
#: A code book of no words: START, which has place 0 in all of them.
NO_WORDS = np.array([START])


def planes(x: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes, and so on: small values leave whole planes of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def pack(*columns: np.ndarray, rising: bool = True) -> bytes:
    """Columns of one length, compressed; a rising first one by its differences."""
    first = np.diff(columns[0], prepend=columns[0][:1] * 0) if rising else columns[0]
    raw = b"".join(map(planes, (first, *columns[1:])))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, *kinds: str, rising: bool = True) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T).view(k).ravel())
        at += n * size
    return [np.cumsum(out[0], dtype=kinds[0]) if rising else out[0], *out[1:]]


def bigram_hash(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(mix(b) * np.uint64(0x9E3779B97F4A7C15) + c)


def places(book: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word's hash in the code book; the book's length if it is not there."""
    order = np.argsort(book)
    found = order[np.minimum(np.searchsorted(book, words, sorter=order), len(book) - 1)]
    return np.where(book[found] == words, found, len(book))


def code_book(docs: DataFrame, share: float) -> np.ndarray:
    """START and the most frequent words (hashes) of a share of the texts, falling. What it holds is of no account to any result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, uses = np.unique(hash_words(ascii_words(texts_of(part))[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(uses)], names=["word", "uses"])

    some = docs.select("text").sample(share, 1) if share < 1 else docs.select("text")
    found = some.mapInArrow(count, "word bigint, uses bigint").groupBy("word").agg(F.sum("uses").alias("uses")).where("uses > 1").orderBy(F.desc("uses"), "word").limit(BOOK_WORDS).select("word").toArrow()
    words = np.asarray(found.column(0).combine_chunks(), dtype=np.int64).astype(np.uint64)
    return np.r_[START, words[words != START]]


class Block:
    """The n-grams of a run of texts: `words` (hashes, in an order of their own), `number` (of each word in turn, from 1; 0 is the text start), `counts` (words of each text)."""

    def __init__(self, words: np.ndarray, number: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.number, self.counts = words, number, counts
        self.hash_of, n = np.r_[START, words], np.int64(len(words) + 1)
        at = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.n, self.first, early = n, at == 0, at < 2
        del at

        def before(k: int, none: np.ndarray) -> np.ndarray:
            found = np.roll(number, k)
            found[none] = 0
            return found

        # Columns of a block's words are made one at a time and numbers kept in four bytes: a worker's memory is theirs.
        key = before(1, self.first)
        key *= n
        key += number
        self.pairs, nth = np.unique(key, return_inverse=True)
        self.pair_at = nth.astype(np.int32)
        key = nth
        key *= n
        key += before(2, early)
        del nth
        self.triples, at, uses = np.unique(key, return_inverse=True, return_counts=True)
        self.triple_at, self.uses = at.astype(np.int32), uses.astype(np.int32)

    @classmethod
    def of_hashes(cls, h: np.ndarray, counts: np.ndarray, book: np.ndarray = NO_WORDS) -> Block:
        """Words of the book come first, in its order, then others by hash: so places in the book rise with numbers."""
        words, number = np.unique(h, return_inverse=True)
        order = np.argsort(places(book, words), kind="stable")
        new = np.empty(len(order), dtype=np.int64)
        new[order] = np.arange(1, len(order) + 1)
        return cls(words[order], new[number], counts)

    def stored(self, book: np.ndarray) -> bytes:
        at = places(book, self.words)
        known = at < len(book)
        return join([pack(at[known].astype(np.uint32)), pack(self.words[~known]), pack(self.number.astype(np.uint32), rising=False), pack(self.counts, rising=False)])

    @classmethod
    def of_stored(cls, data: bytes, book: np.ndarray) -> Block:
        known, others, number, counts = split(data)
        words = np.concatenate([book[unpack(known, "<u4")[0]], unpack(others, "<u8")[0]])
        return cls(words, unpack(number, "<u4", rising=False)[0].astype(np.int64), unpack(counts, "<i8", rising=False)[0])

    def parts(self, partitions: int) -> tuple[np.ndarray, np.ndarray]:
        """The partition of each trigram, by its last two words, and of each word."""
        p = np.uint64(partitions)
        pair = (bigram_hash(self.hash_of[self.pairs // self.n], self.hash_of[self.pairs % self.n]) % p).astype(np.int64)
        return pair[self.triples // self.n], (mix(self.words) % p).astype(np.int64)

    def request(self, mine: np.ndarray, own: np.ndarray, totals: np.ndarray, book: np.ndarray = NO_WORDS, at: np.ndarray | None = None) -> bytes:
        """Some trigrams as (bigram number, first word, uses), and some words with uses. A word is its place in the book (at: of hash_of) or, from there on, in the list of other words sent with it."""
        at = places(book, self.hash_of) if at is None else at
        pairs, nth = np.unique(self.triples[mine] // self.n, return_inverse=True)
        a, b, c = self.triples[mine] % self.n, self.pairs[pairs] // self.n, self.pairs[pairs] % self.n
        own = own + 1
        need = np.unique(np.concatenate([a, b, c, own]))
        need = need[at[need] == len(book)]
        local = lambda x: np.where(at[x] < len(book), at[x], len(book) + np.searchsorted(need, x)).astype(np.uint32)
        return join([pack(self.hash_of[need]), pack(local(b), local(c)), pack(nth.astype(np.uint32), local(a), self.uses[mine].astype(np.uint32)), pack(local(own), totals[own - 1].astype(np.uint32))])


def join(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def read_request(data: bytes, book: np.ndarray = NO_WORDS) -> tuple[np.ndarray, ...]:
    """Hash of each trigram's bigram, of itself, its uses; words, their uses."""
    parts = split(data)
    (need,), (b, c), (nth, a, uses), (words, totals) = unpack(parts[0], "<u8"), unpack(parts[1], "<u4", "<u4"), unpack(parts[2], "<u4", "<u4", "<u4"), unpack(parts[3], "<u4", "<u4")
    all_words = np.concatenate([book, need])
    pair = bigram_hash(all_words[b], all_words[c])[nth]
    return pair, mix(pair * np.uint64(0xD6E8FEB86659FD93) + all_words[a]), uses, all_words[words], totals


def read_counts(data: bytes, n: int) -> np.ndarray:
    """Counts of an answer, in four bytes each or in eight."""
    found = unpack(data, "<u4", rising=False)[0]
    return found if len(found) == n else unpack(data, "<u8", rising=False)[0]


def totals_of(keys: list[np.ndarray], uses: list[np.ndarray]) -> list[bytes]:
    """Of each request's keys, in their order, the uses over all requests, packed. Sorts and sums a range of hashes at a time."""
    found = [np.empty(len(k), dtype=np.uint64) for k in keys]
    shift = np.uint64(64 - RANGE_BITS)
    for low in range(1 << RANGE_BITS):
        at = [np.flatnonzero(k >> shift == low) for k in keys]
        _, nth = np.unique(np.concatenate([k[i] for k, i in zip(keys, at, strict=True)]), return_inverse=True)
        sums = np.bincount(nth, weights=np.concatenate([u[i] for u, i in zip(uses, at, strict=True)])).astype(np.uint64)[nth]
        for f, i, part in zip(found, at, np.split(sums, np.cumsum([len(i) for i in at])[:-1]), strict=True):
            f[i] = part
    return [pack(f.astype(np.uint32) if f.max(initial=0) < 2**32 else f, rising=False) for f in found]


def answer(requests: list[bytes], book: np.ndarray = NO_WORDS) -> list[bytes]:
    """Counts over all requests, in the order each one asked: trigrams, their bigrams, words."""
    pairs, triples, uses, words, totals = (list(x) for x in zip(*(read_request(r, book) for r in requests), strict=True))
    third = totals_of(triples, uses)
    del triples
    second = totals_of(pairs, uses)
    del pairs, uses
    return [join(list(x)) for x in zip(third, second, totals_of(words, totals), strict=True)]


def partial_scores(block: Block, answers: dict[int, bytes], partitions: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: sum of log scores without the corpus totals, words that divide by the number of other texts, words that divide by the number of words of other texts."""
    triple_part, word_part = block.parts(partitions)
    f3, f2, f1 = np.zeros(len(block.triples)), np.zeros(len(block.pairs)), np.zeros(len(block.words) + 1)
    for part, data in answers.items():
        mine = np.flatnonzero(triple_part == part)
        f3[mine], f2[block.triples[mine] // block.n], f1[1:][word_part == part] = (read_counts(x, n) for x, n in zip(split(data), (len(mine), len(mine), int((word_part == part).sum())), strict=True))
    of = np.repeat(np.arange(len(block.counts)), block.counts)

    def elsewhere(f: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, nth, own = np.unique(of * len(f) + at, return_inverse=True, return_counts=True)
        return f[at] - own[nth]

    t, p, w = elsewhere(f3, block.triple_at), elsewhere(f2, block.pair_at), elsewhere(f1, block.number)
    # The pair and the word that come before a word are those of the place before it.
    context, before = (np.where(block.first, 1.0, np.roll(x, 1)) for x in (p, w))
    whole, half = t > 0, (t <= 0) & (p > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        last = np.where(w > 0, 2 * np.log(alpha) + np.log(w), 3 * np.log(alpha))
        each = np.where(whole, np.log(t) - np.log(context), np.where(half, np.log(alpha) + np.log(p) - np.log(before), last))
    add = lambda x: np.bincount(of, weights=x, minlength=len(block.counts)).astype(np.float64)
    return add(each), add(block.first & (whole | half)), add(~whole & ~half)


def score(docs: DataFrame, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, partition_words: int = PARTITION_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (mean natural log of the words' scores), n_words, log_sum (their sum).

    Words are runs without ASCII white space, A-Z lower-cased, and equal when their 64-bit hashes are. Null and empty
    texts have no words, log_sum 0 and a null score. Repeated rows count as often as they stand, each vouches for the
    others, and they get equal scores; ids and nulls pass through; other columns are not read; an empty table gives no
    rows. Counts cover every row and whole texts. docs should read a table, so that a task that runs again sees its rows
    in the same order.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    partitions = int(size // 6 // partition_words) + 1
    schema = f"dest bigint, block bigint, kind int, part int, data binary, ids array<{kind}>"
    names = ["dest", "block", "kind", "part", "data", "ids"]
    held_book = docs.sparkSession.sparkContext.broadcast(code_book(rows, BOOK_DOCS / max(n_rows, 1)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = made = 0
        book = held_book.value

        def emit(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            """A row a batch, so that no more than one request is held."""
            together = np.concatenate(hashes)
            hashes.clear()
            block = Block.of_hashes(together, np.concatenate(counts), book)
            del together
            name = (TaskContext.get().partitionId() << 32) + made
            triple_part, word_part = block.parts(partitions)
            at = places(book, block.hash_of)
            totals = np.bincount(block.number, minlength=len(block.hash_of))[1:]
            by_triple, by_word = np.argsort(triple_part, kind="stable"), np.argsort(word_part, kind="stable")
            cut3, cut1 = (np.searchsorted(x[o], np.arange(partitions + 1)) for x, o in ((triple_part, by_triple), (word_part, by_word)))
            row = lambda dest, kind, part, data, ids: pa.RecordBatch.from_arrays([pa.array([dest], pa.int64()), pa.array([name], pa.int64()), pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(id_type))], names=names)
            for k in range(partitions):
                yield row(k, 0, k, block.request(by_triple[cut3[k] : cut3[k + 1]], by_word[cut1[k] : cut1[k + 1]], totals, book, at), None)
            yield row(name % partitions, 1, 0, block.stored(book), ids)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                words, n = ascii_words(texts_of(part))
                hashes.append(hash_words(words))
                counts.append(n)
                ids += part.column(0).to_pylist()
                held += sum(map(len, words)) + len(words)
                del words
                if held > block_bytes:
                    yield from emit(part.schema.field(0).type)
                    ids, hashes, counts, held, made = [], [], [], 0, made + 1
        if ids:
            yield from emit(part.schema.field(0).type)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, requests = None, [], []

        def emit(like: pa.Schema) -> pa.RecordBatch:
            n = len(blocks)
            columns = [[0] * n, blocks, [0] * n, [now] * n, answer(requests, held_book.value), [None] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, like, strict=True)], schema=like)

        for batch in batches:
            # A batch may hold all of a task's rows, so only the requests of one partition are copied out of it.
            for k, (block, kind, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                if kind == 1:
                    yield batch.slice(k, 1)
                    continue
                if part != now and requests:
                    yield emit(batch.schema)
                    blocks, requests = [], []
                now = part
                blocks.append(block)
                requests.append(batch.column(4)[k].as_py())
        if requests:
            yield emit(batch.schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, bytes] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(2)[k].as_py() == 0:
                    answers[batch.column(3)[k].as_py()] = batch.column(4)[k].as_py()
                    continue
                block = Block.of_stored(batch.column(4)[k].as_py(), held_book.value)
                total, texts, singles = partial_scores(block, answers, partitions, alpha)
                answers = {}
                yield pa.RecordBatch.from_arrays([batch.column(5)[k].values, pa.array(block.counts), pa.array(total), pa.array(texts), pa.array(singles)], names=["doc_id", "n_words", "total", "by_texts", "by_words"])

    asked = rows.mapInArrow(ask, schema)
    summed = asked.repartition("dest").sortWithinPartitions("dest", "kind").mapInArrow(sum_up, schema)
    scored = stash(summed.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(finish, f"doc_id {kind}, n_words bigint, total double, by_texts double, by_words double"))
    all_words, all_texts = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.count(F.when(F.col("n_words") > 0, 1))).first()
    others = F.log(F.greatest(F.lit(all_words) - F.col("n_words"), F.lit(1)).cast("double"))
    log_sum = F.col("total") - F.col("by_texts") * F.lit(float(np.log(max(all_texts - 1, 1)))) - F.col("by_words") * others
    return scored.select("doc_id", F.when(F.col("n_words") > 0, log_sum / F.col("n_words")).alias("score"), "n_words", log_sum.alias("log_sum"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
