"""Language identification with segmentation-marginalised unigrams.

A public vocabulary fixes the pieces; each language has a probability per piece. The probability of a word is the sum
over all its segmentations into pieces, by a forward algorithm; a text's is the product over its words. Piece
probabilities come from expected counts (forward and backward) on a bounded, stated number of labelled documents per
language; the expectation runs on the executors, and the driver only sees one number per language and piece.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicker.llm.common import discard, documents, kept, mix, slices, stash, texts_of

#: Documents per language that training reads, about; the documented bound on the labelled sample.
TRAIN_DOCS = 1500
ROUNDS = 3
#: Characters of words whose scores a worker remembers, from task to task, before it starts afresh; a bound on memory only.
REMEMBERED = 3_000_000
#: Table cells that the forward algorithm works on at a time, about; a longer word is a batch of its own.
CELLS = 1 << 18
LETTER = regex.compile(r"\p{L}")


class Pieces:
    """The fixed vocabulary: text of each piece to its number. Number 0 stands for a character outside it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = (i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
        names = dict.fromkeys(sp.id_to_piece(i).lower() for i in usable)
        self.number = {name: k + 1 for k, name in enumerate(names)}
        self.size = len(self.number) + 1
        # Every beginning of a piece by length: sorted hashes, and the piece's number where the beginning is one, else 0.
        self.beginnings: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, max(map(len, self.number), default=0) + 1):
            found = {name[:n]: self.number.get(name[:n], 0) for name in self.number if len(name) >= n}
            h = self.hashes(list(found))
            order = np.argsort(h)
            self.beginnings.append((h[order], np.fromiter(found.values(), dtype=np.int64, count=len(found))[order]))

    @staticmethod
    def extend(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return mix(h * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64) + np.uint64(1))

    def hashes(self, texts: list[str]) -> np.ndarray:
        """64-bit hashes of texts of one length, character by character."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").reshape(len(texts), -1)
        h = np.zeros(len(texts), dtype=np.uint64)
        for c in codes.T:
            h = self.extend(h, c)
        return h

    def matches(self, words: list[str]) -> np.ndarray:
        """Rows (word, start, end, piece, bytes outside the vocabulary), for every piece at every place of every word."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word, ends = np.repeat(np.arange(len(words)), lengths), np.cumsum(lengths)
        left, start = ends[word] - np.arange(len(codes)), np.arange(len(codes)) - (ends - lengths)[word]
        live, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        single = np.zeros(len(codes), dtype=bool)
        at, size, piece = [], [], []
        for n, (known, number) in enumerate(self.beginnings, 1):
            fits = left[live] >= n
            live, h = live[fits], h[fits]
            h = self.extend(h, codes[live + n - 1])
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            begins = known[place] == h
            live, h, place = live[begins], h[begins], place[begins]
            whole = number[place] > 0
            at.append(live[whole])
            size.append(np.full(len(at[-1]), n))
            piece.append(number[place][whole])
            if n == 1:
                single[at[-1]] = True
        at.append(other := np.flatnonzero(~single))
        size.append(np.ones(len(other), dtype=np.int64))
        piece.append(np.zeros(len(other), dtype=np.int64))
        at, size, piece = np.concatenate(at), np.concatenate(size), np.concatenate(piece)
        c = codes[at]
        outside = np.where(piece == 0, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), 0)
        return np.stack([word[at], start[at], start[at] + size, piece, outside], axis=1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def units(text: str) -> list[str]:
    """Lower-cased words with the vocabulary's word mark."""
    return [f"▁{w}" for w in text.lower().split()]


def batches_of(words: list[str], languages: int) -> Iterator[np.ndarray]:
    """Places of words of about one length, so that a batch's table has about CELLS cells, or one row."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    cells = np.cumsum((lengths[order] + 1) * max(languages, 1)) // CELLS
    bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]) if len(words) else []
    yield from (order[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True))


def _sum_into(table: np.ndarray, word: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """table[word, at] = log of the sum of exp(value) over rows with equal (word, at), which stand together."""
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (at[1:] != at[:-1])])
    size = np.diff(np.r_[first, len(word)])
    top = np.maximum.reduceat(value, first, axis=0)
    table[word[first], at[first]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size, axis=0)), first, axis=0))


def _steps(keys: np.ndarray) -> Iterator[slice]:
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
    yield from map(slice, cuts, [*cuts[1:], len(keys)])


def forward(m: np.ndarray, lengths: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log sums over the segmentations of every prefix, [word, end, language], and each match's own log probability."""
    own = logp[m[:, 3]] - (m[:, 4] * np.log(256.0))[:, None]
    table = np.full((len(lengths), int(lengths.max()) + 1, logp.shape[1]), -np.inf)
    table[:, 0] = 0.0
    order = np.argsort(m[:, 2] * len(lengths) + m[:, 0])
    for s in _steps(m[order, 2]):
        rows = order[s]
        _sum_into(table, m[rows, 0], m[rows, 2], table[m[rows, 0], m[rows, 1]] + own[rows])
    return table, own


def word_scores(p: Pieces, words: list[str], logp: np.ndarray) -> np.ndarray:
    """log P(word | language) for each word and language."""
    out = np.empty((len(words), logp.shape[1]))
    for at in batches_of(words, logp.shape[1]):
        some = [words[i] for i in at.tolist()]
        lengths = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        out[at] = forward(p.matches(some), lengths, logp)[0][np.arange(len(some)), lengths]
    return out


def expected_counts(p: Pieces, words: list[str], weight: np.ndarray, column: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, [piece, language], of words with a weight and a language each."""
    total = np.zeros_like(logp)
    for at in batches_of(words, logp.shape[1]):
        some = [words[i] for i in at.tolist()]
        lengths = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        m = p.matches(some)
        ahead, own = forward(m, lengths, logp)
        behind = np.full_like(ahead, -np.inf)
        behind[np.arange(len(some)), lengths] = 0.0
        order = np.argsort(-m[:, 1] * len(some) + m[:, 0])
        for s in _steps(m[order, 1]):
            rows = order[s]
            _sum_into(behind, m[rows, 0], m[rows, 1], behind[m[rows, 0], m[rows, 2]] + own[rows])
        k = column[at][m[:, 0]]
        pick = np.arange(len(m))
        share = ahead[m[:, 0], m[:, 1], k] + own[pick, k] + behind[m[:, 0], m[:, 2], k] - ahead[m[:, 0], lengths[m[:, 0]], k]
        np.add.at(total, (m[:, 3], k), np.exp(share) * weight[at][m[:, 0]])
    return total


def train(labelled: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = TRAIN_DOCS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probability [piece, language]. Rows without text or label are not used; no rows give no languages."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND length(trim(text)) > 0")
    seen = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(seen)
    vocabulary = pieces(path)
    logp = np.full((vocabulary.size, len(langs)), -np.log(vocabulary.size))
    if not langs:
        return langs, logp
    share = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, docs_per_language / seen[lang])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.where(draw < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found: Counter = Counter()
                for text, lang in zip(texts_of(part), texts_of(part, "lang"), strict=True):
                    found.update((lang, u) for u in units(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "unit", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, unit string, n bigint").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    counted = stash(counted)
    column = {lang: k for k, lang in enumerate(langs)}
    for _ in range(rounds):
        held = labelled.sparkSession.sparkContext.broadcast(logp.astype(np.float32))

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            p, now = pieces(path), held.value.astype(np.float64)
            total = np.zeros_like(now)
            for batch in batches:
                at = np.array([column[x] for x in texts_of(batch, "lang")], dtype=np.int64)
                total += expected_counts(p, texts_of(batch, "unit"), np.asarray(batch.column(2), dtype=np.float64), at, now)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

        uses = counted.mapInArrow(expect, "piece bigint, lang bigint, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.zeros_like(logp)
        total[uses["piece"], uses["lang"]] = uses["uses"]
        total += 0.05
        logp = np.log(total / total.sum(axis=0))
    discard(counted)
    return langs, logp


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (posterior of the predicted language, equal priors). With carry, the input's own columns and _lang_pred, _lang_score instead.

    `und` with score 0 where the text is null, empty or has no letter, or no language was learned. Ties go to the first
    language by code point. Texts are scored whole; repeated rows get equal results; other columns are not read.
    """
    langs, logp = model
    held = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))
    name_of_model = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, now = pieces(path), held.value.astype(np.float64)
        memory = kept(name_of_model, lambda: [{}, np.empty((0, len(langs))), 0])
        index, known, held_chars = memory
        for batch in batches:
            for part in slices(batch, text_name, 1 << 20):
                texts = [t if t and langs and LETTER.search(t) else None for t in texts_of(part, text_name)]
                if held_chars > REMEMBERED:
                    index, known, held_chars = {}, known[:0], 0
                ids: list[int] = []
                ends = []
                for text in texts:
                    ids += [index.setdefault(u, len(index)) for u in units(text)] if text else []
                    ends.append(len(ids))
                fresh = list(index)[len(known) :]
                if fresh:
                    known = np.concatenate([known, word_scores(p, fresh, now)])
                    held_chars += sum(map(len, fresh))
                    memory[:] = index, known, held_chars
                sums = np.zeros((len(ids) + 1, len(langs)))
                if langs:
                    np.cumsum(known[ids], axis=0, out=sums[1:])
                total = np.diff(sums[np.r_[0, ends]], axis=0) if langs else np.zeros((len(texts), 1))
                best = total.argmax(axis=1)
                score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                name = [langs[b] if t else "und" for b, t in zip(best.tolist(), texts, strict=True)]
                score = np.where([t is not None for t in texts], score, 0.0)
                lead = part.columns if carry else [part.column(0)]
                yield pa.RecordBatch.from_arrays([*lead, pa.array(name, pa.string()), pa.array(score, pa.float64())], names=[*carried, *added])

    added = ["_lang_pred", "_lang_score"] if carry else ["lang_pred", "score"]
    rows = docs if carry else docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    carried = rows.columns if carry else ["doc_id"]
    text_name = text_col if carry else "text"
    schema = T.StructType([*(rows.schema[c] for c in carried), T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), vocabulary_path()
    model = train(docs.where(~held_out()), path)
    return identify(docs, model, path).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
