"""Byte-level BPE encoding and decoding by speculation and verification.

Texts are cut into words by the vocabulary's pattern. For each distinct word, greedy longest match proposes tokens. A
row of tokens is what the merges give exactly if each adjacent pair of them, taken alone, merges to itself; so all
adjacent pairs of a slice of text are looked up at once in a sorted table of pairs already judged, pairs seen for the
first time are judged by merging the two tokens' bytes, and only words with a pair that fails are merged in full.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.common import documents, kept, slices, texts_of

#: Fixed value: the published byte-level pattern that cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of distinct words whose tokens a worker remembers before it starts afresh, and judged pairs; bounds on memory only.
REMEMBERED, JUDGED = 2_000_000, 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}


class Codec:
    """Encoder and decoder of one vocabulary file. Texts without an added token's string never touch the added tokens."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.tokens = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.bytes_of = [b""] * (max([*self.tokens.values(), *self.added.values()]) + 1)
        for s, i in self.tokens.items():
            self.bytes_of[i] = s
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.longest = max(map(len, self.tokens))
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # A token that its own merges never give must not be proposed.
        self.proposable = {s: i for s, i in self.tokens.items() if self.merge(s) == [i]}
        self.judged = np.empty(0, dtype=np.uint64)
        self.verdict = np.empty(0, dtype=bool)
        self.known: dict[str, bytes] = {}
        self.known_chars = 0
        self.repaired = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of least rank first, leftmost among equals."""
        if len(word) > 128:
            return self.merge_long(word)
        rank, none = self.rank.get, len(self.rank)
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return [self.tokens[p] for p in parts]

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, so that a word of many bytes takes n log n steps."""
        n = len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if part[i] != left or j >= n or part[j] != right:
                continue
            part[i], part[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.rank.get((part[x], part[y]))) is not None:
                    heapq.heappush(waiting, (r, x, part[x], part[y]))
        return [self.tokens[p] for p in part if p is not None]

    def propose(self, word: bytes) -> list[int]:
        whole = self.proposable.get(word)
        if whole is not None:
            return [whole]
        found, at, end, get = [], 0, len(word), self.proposable.get
        while at < end:
            stop = min(end, at + self.longest)
            while (token := get(word[at:stop])) is None:
                stop -= 1
            found.append(token)
            at = stop
        return found

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (first id << 32 | second id) merges to itself; unjudged ones are judged and kept, sorted."""
        new = np.setdiff1d(pairs, self.judged)
        if len(new):
            good = np.fromiter((self.merge(self.bytes_of[p >> 32] + self.bytes_of[p & 0xFFFFFFFF]) == [p >> 32, p & 0xFFFFFFFF] for p in new.tolist()), dtype=bool, count=len(new))
            order = np.argsort(both := np.concatenate([self.judged, new]), kind="stable")
            self.judged, self.verdict = both[order], np.concatenate([self.verdict, good])[order]
        return self.verdict[np.searchsorted(self.judged, pairs)]

    def learn(self, words: set[str]) -> None:
        """Tokens of the distinct words not yet known, proposed one by one and verified all together."""
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        if self.known_chars > REMEMBERED:
            self.known.clear()
            self.known_chars = 0
            fresh = list(words)
        self.known_chars += sum(map(len, fresh))
        if len(self.judged) > JUDGED:
            self.judged, self.verdict = self.judged[:0], self.verdict[:0]
        raws = [w.encode("utf-8", "surrogatepass") for w in fresh]
        proposals = [self.propose(r) for r in raws]
        sizes = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), dtype=np.uint64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(fresh)), sizes)
        inside = owner[1:] == owner[:-1]
        pairs = ((flat[:-1] << np.uint64(32)) | flat[1:])[inside]
        failing = np.unique(owner[1:][inside][~self.compatible(pairs)]) if len(pairs) else []
        self.repaired += len(failing)
        for i in failing:
            proposals[i] = self.merge(raws[i])
        for word, tokens in zip(fresh, proposals, strict=True):
            self.known[word] = np.array(tokens, dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            pieces, at = [], 0
            for m in self.special.finditer(text) if self.special and any(s in text for s in self.added) else ():
                pieces += [self.words.findall(text[at : m.start()]), self.added[m.group()]]
                at = m.end()
            split.append([*pieces, self.words.findall(text[at:] if at else text)])
        self.learn({w for pieces in split for p in pieces if isinstance(p, list) for w in p})
        get = self.known.__getitem__
        return [b"".join(b"".join(map(get, p)) if isinstance(p, list) else int(p).to_bytes(4, "little") for p in pieces) for pieces in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return kept(f"codec {path}", lambda: Codec(path))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids (array of long), decoded (the text that the ids give). With carry, the id, the text and _ids, _decoded instead.

    path names a vocabulary file that every executor has. Null text counts as empty, which has no ids. Ids and repeated
    rows pass through; other columns are not read; an empty table gives no rows. Texts are handled whole, a few
    megabytes at a time.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ("text string, _ids array<bigint>, _decoded string" if carry else "ids array<bigint>, decoded string")
    names = ["doc_id", "text", "_ids", "_decoded"] if carry else ["doc_id", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                coded = c.encode_batch([t or "" for t in texts_of(part)])
                offsets = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names) - 2], ids, pa.array([c.decode(x) for x in coded], pa.string())], names=names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), but with n_tokens and SHA-256 digests of ids and decoded text in place of the long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                coded = c.encode_batch([t or "" for t in texts_of(part)])
                ids = [hashlib.sha256(x).hexdigest() for x in coded]
                back = [hashlib.sha256(c.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in coded]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary_path())
