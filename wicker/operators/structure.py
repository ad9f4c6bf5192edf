"""Documents' text to structure, over Arrow batches: frontmatter entries, links, headings and code blocks with their places, or the first fault.

What fields mean, which links count and what they point to is left to Column expressions and joins over these columns.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicker.functions import commonmark, plain, yaml

#: Bytes (and units) and lines that one document may have.
MOST_BYTES, MOST_LINES = 320 * 1024 + 16, 24_002
SIGNS = bytes(k for k in range(128) if yaml.SIGNS.match(chr(k)))
PLACES = ("start", "line", "character", "end", "end_line", "end_character")
#: Offsets are UTF-16 units of the text as it was read; lines and characters count from 0.
RANGE = "struct<" + ",".join(f"{n}:int" for n in PLACES) + ">"
COLUMNS = {
    "front": "string", "body": "string", "front_range": RANGE, "keys": "array<string>", "fields": f"map<string,struct<kind:string,value:string,tag:string,size:int,range:{RANGE}>>",
    "marks": f"array<struct<label:string,target:string,range:{RANGE}>>", "heads": f"array<struct<level:int,text:string,range:{RANGE}>>", "code": "array<struct<start:int,fenced:boolean>>",
    "work": "struct<front_units:int,front_signs:int,body_units:int,body_lines:int,body_signs:int>", "newline": "string", "fault": "string", "fault_message": "string", "fault_range": RANGE,
}


class Places:
    """Ranges in a text as read, from offsets in the same text with LF line ends."""

    def __init__(self, raw: str):
        self.raw = raw
        self.pairs: list[int] = []
        at = raw.find("\r\n")
        while at >= 0:
            self.pairs.append(at - len(self.pairs))
            at = raw.find("\r\n", at + 2)
        self.wide = [] if raw.isascii() else [k for k, c in enumerate(raw) if c > "￿"]
        self.even = not self.pairs and not self.wide
        self.starts = [0]
        at = 0
        if "\r" in raw:
            for line in raw.replace("\r\n", "\0\n").replace("\r", "\n").split("\n")[:-1]:
                at += len(line) + 1
                self.starts.append(at)
        else:
            while (at := raw.find("\n", at) + 1) > 0:
                self.starts.append(at)

    def units(self, at: int) -> int:
        return at + bisect_left(self.wide, at)

    def point(self, at: int) -> tuple[int, int, int]:
        at = min(max(at + bisect_left(self.pairs, at), 0), len(self.raw))
        line = bisect_right(self.starts, at) - 1
        return self.units(at), line, self.units(at) - self.units(self.starts[line])

    def range(self, start: int, end: int) -> tuple[int, ...]:
        if self.even and 0 <= start <= end <= len(self.raw):
            starts = self.starts
            line = last = bisect_right(starts, start) - 1
            if last + 1 < len(starts) and end >= starts[last + 1]:
                last = bisect_right(starts, end) - 1
            return start, line, start - starts[line], end, last, end - starts[last]
        return (*self.point(start), *self.point(max(start, end)))


def region(text: str) -> tuple[int, int] | None:
    """Where the frontmatter's own text begins and ends; None without an opening line, (0, -1) without a closing one."""
    if not text.startswith("---\n") and text != "---":
        return None
    end = text.find("\n---\n", 3)
    if end < 0:
        end = len(text) - 4 if text.endswith("\n---") and len(text) > 4 else -1
    return (4, end + 1) if end >= 0 else (0, -1)


def structure(raw: str, reserved: bool) -> dict:
    """One document's columns."""
    raw = raw.removeprefix("\ufeff")
    text = raw.replace("\r\n", "\n").replace("\r", "\n")
    first = min((k for k in (raw.find("\n"), raw.find("\r")) if k >= 0), default=-1)
    out = {"newline": "\n" if first < 0 or raw[first] == "\n" else "\r\n" if raw[first : first + 2] == "\r\n" else "\r", "entries": [], "marks": [], "heads": [], "code": []}

    def fault(reason: str, message: str, start: int, end: int) -> dict:
        return out | {"entries": [], "marks": [], "heads": [], "code": [], "fault": reason, "fault_message": message, "fault_range": places.range(start, end)}

    places = Places(raw)
    if (len(raw) if raw.isascii() else len(raw.encode("utf-8", "surrogatepass"))) > MOST_BYTES or len(places.starts) - (len(raw) == places.starts[-1]) > MOST_LINES:
        return fault("resource-limit", "the document is too large", 0, len(text))
    found = region(text)
    body_at = 0
    if found == (0, -1):
        return fault("frontmatter", "the frontmatter has no closing line", 0, min(4, len(text)))
    if found is None and not reserved:
        return fault("frontmatter", "a concept needs frontmatter", 0, len(text))
    if found is not None:
        begin, end = found
        body_at = min(end + 4, len(text))
        out |= {"front": text[begin:end], "front_range": places.range(begin, end)}
    body = text[body_at:]
    out["work"] = (*work(out.get("front", ""))[::2], *work(body))
    if found is not None:
        try:
            entries = plain.front(text[begin:end])
            if entries is None:
                entries = yaml.read(text[begin:end])
        except yaml.Failure as problem:
            whole = str(problem).startswith("the frontmatter must")
            return fault("resource-limit" if problem.limit else "frontmatter", str(problem), begin if whole else begin + problem.start, end if whole else begin + problem.end)
        sizes: dict[str, int] = {}
        for pointer, *_ in entries[1:]:
            above = pointer[: pointer.rindex("/")]
            sizes[above] = sizes.get(above, 0) + 1
        out["entries"] = [(p, kind, value, tag, sizes.get(p, 0), places.range(begin + s, begin + e)) for p, kind, value, tag, s, e in entries]
    out["body"] = body
    try:
        links, heads, code = plain.body(body) or commonmark.read(body)
    except yaml.Failure as problem:
        return fault("resource-limit", str(problem), body_at, len(text))
    out["marks"] = [(label, target, places.range(body_at + s, body_at + e)) for label, target, s, e in links]
    out["heads"] = [(level, said, places.range(body_at + s, body_at + e)) for level, said, s, e in heads]
    out["code"] = [(places.point(body_at + s)[0], fenced) for s, fenced in code]
    return out


def work(text: str) -> tuple[int, int, int]:
    """Units, lines and signs of a part of a document: what reading it may cost."""
    lines = text.count("\n") + (bool(text) and not text.endswith("\n"))
    if text.isascii():
        octets = text.encode()
        return len(text), lines, len(octets) - len(octets.translate(None, SIGNS))
    return len(text) + sum(c > "\uffff" for c in text), lines, len(yaml.SIGNS.findall(text))


def emptied(when: Column) -> dict[str, Column]:
    """The structure's columns, empty where the condition holds: what a document has that was not read."""
    none = {"keys": "array()", "fields": "map()", "marks": "array()", "heads": "array()", "code": "array()"}
    return {c: F.when(when, F.expr(none[c]).cast(t) if c in none else F.lit(None).cast(t)).otherwise(F.col(c)) for c, t in COLUMNS.items() if c in ("front", "body", *none)}


def ranges(rows: list[tuple | None]) -> pa.StructArray:
    mask = pa.array([r is None for r in rows], pa.bool_())
    numbers = np.fromiter(chain.from_iterable(r or (0,) * 6 for r in rows), dtype=np.int32, count=6 * len(rows)).reshape(-1, 6)
    return pa.StructArray.from_arrays([pa.array(numbers[:, k].copy()) for k in range(6)], names=list(PLACES), mask=mask)


def works(rows: list[tuple | None]) -> pa.StructArray:
    names = ["front_units", "front_signs", "body_units", "body_lines", "body_signs"]
    return pa.StructArray.from_arrays([pa.array([0 if r is None else r[k] for r in rows], pa.int32()) for k in range(5)], names=names, mask=pa.array([r is None for r in rows], pa.bool_()))


def lists(per_row: list[list], make) -> pa.ListArray:
    offsets = [0]
    for items in per_row:
        offsets.append(offsets[-1] + len(items))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), make([x for items in per_row for x in items]))


def structs(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def batch_of(rows: list[dict], made: Collection[str] = COLUMNS) -> list[pa.Array]:
    """Those columns of COLUMNS that are named, in its order, for a batch of structures; a document without text has nulls and empty lists."""
    pick = lambda name: [r.get(name) for r in rows]
    lists_of = lambda name: [r.get(name) or [] for r in rows]
    text = lambda values: pa.array(values, pa.string())
    entries = lists_of("entries")

    def fields() -> pa.MapArray:
        keyed = lists(entries, lambda es: structs(kind=text([e[1] for e in es]), value=text([e[2] for e in es]), tag=text([e[3] for e in es]), size=pa.array([e[4] for e in es], pa.int32()), range=ranges([e[5] for e in es])))
        return pa.MapArray.from_arrays(keyed.offsets, text([e[0] for es in entries for e in es]), keyed.values)

    makes = {
        "front": lambda: text(pick("front")), "body": lambda: text(pick("body")), "front_range": lambda: ranges(pick("front_range")),
        "keys": lambda: pa.array([[e[0][1:].replace("~1", "/").replace("~0", "~") for e in es if e[0].count("/") == 1] for es in entries], pa.list_(pa.string())), "fields": fields,
        "marks": lambda: lists(lists_of("marks"), lambda ms: structs(label=text([m[0] for m in ms]), target=text([m[1] for m in ms]), range=ranges([m[2] for m in ms]))),
        "heads": lambda: lists(lists_of("heads"), lambda hs: structs(level=pa.array([h[0] for h in hs], pa.int32()), text=text([h[1] for h in hs]), range=ranges([h[2] for h in hs]))),
        "code": lambda: lists(lists_of("code"), lambda cs: structs(start=pa.array([c[0] for c in cs], pa.int32()), fenced=pa.array([c[1] for c in cs], pa.bool_()))),
        "work": lambda: works(pick("work")), "newline": lambda: text(pick("newline")), "fault": lambda: text(pick("fault")), "fault_message": lambda: text(pick("fault_message")), "fault_range": lambda: ranges(pick("fault_range")),
    }
    return [makes[c]() for c in COLUMNS if c in made]


def with_structure(docs: DataFrame, rows_at_once: int = 512, made: Collection[str] = COLUMNS, carried: Collection[str] | None = None) -> DataFrame:
    """docs (with source, a text or null, and reserved) with the columns of COLUMNS, or those named in made. carried: docs' columns that are given too, all unless named. Documents are read whole in any case. Offsets do not count a byte-order mark."""
    at, kind = docs.columns.index("source"), docs.columns.index("reserved")
    own = [k for k, c in enumerate(docs.columns) if carried is None or c in carried]
    names = [docs.columns[k] for k in own] + [c for c in COLUMNS if c in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(lo, rows_at_once)
                found = [{} if raw is None else structure(raw, reserved is not None) for raw, reserved in zip(batch.column(at).to_pylist(), batch.column(kind).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in own], *batch_of(found, made)], names=names)

    added = T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in COLUMNS.items() if n in made))
    return docs.mapInArrow(run, T.StructType([docs.schema.fields[k] for k in own] + added.fields))
