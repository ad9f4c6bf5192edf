"""Exact linking over index lists, shared by line dedup and the n-gram join.

Nodes that can link share an index token. An entry says where in its node's order of tokens the token stands, and so how
many tokens follow; entries of one token meet in order of size and position, and pairs that cannot reach the overlap they
need from there are skipped before anything is written, in blocks of a list too. Three passes follow. The first compares
all nodes of a list and verifies what may link, which settles the list, as long as these pairs are few; where near copies
make them many it only compares with a few leaders. Of these lists the second takes each node's nearest few outside its
group, which is where a link is if there is one. The third derives the rest from those answers: nodes already joined are
not compared again, a group far from a node by its leader's distance and its own radius is skipped as a whole, and only
pairs across groups are left, all of them. So m near copies cost some m verified pairs, while no link between different
groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicker.llm.common import discard, stash

#: Nodes per block of a long list; leaders of a list in the first pass; nodes up to which a list's pairs are tested one by one; neighbours of a node in the second pass; pairs within the limit, for each node of a list, up to which the first pass takes all; lists that a node's row names in the first pass, and in the others.
BLOCK, LEADERS, SHORT, NEAREST, FEW, HOMES, OPEN_HOMES = 500, 16, 16, 4, 2, 4, 16
#: Bits of the count of following tokens in an entry's place; a count that fills them stands for any larger one.
REST_BITS = 16
#: Largest difference of two parity maps that nodes of two sizes may have if they link, -1 where the sizes rule it out.
Limit = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Tokens that nodes of two sizes must share to link.
Need = Callable[[np.ndarray, np.ndarray], np.ndarray]


def place_of(size: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """An entry's place: the node's size, then how many of its tokens stand from the entry's on."""
    return (size.astype(np.int64) << REST_BITS) | np.minimum(rest, (1 << REST_BITS) - 1).astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for the nodes of edges (a, b), by alternating large and small stars.

    Every round is written to the shared folder, with what it changed, and the one before is deleted; the driver only sees
    whether anything changed. A round shuffles twice: edges that meet again are told apart in the next round's shuffle.
    """
    now = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").withColumn("changed", F.lit(True)))
    least = F.min("b").over(Window.partitionBy("a"))
    while not now.where("changed").isEmpty():
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.repartition("a").distinct().withColumn("m", F.least("a", least))
        large = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("a")).alias("moved")).withColumn("m", least)
        small = large.select((F.col("moved") | (F.col("b") != F.col("m"))).alias("changed"), "m", F.explode(F.array("a", "b")).alias("a"))
        before, now = now, stash(small.where("a <> m").select("a", F.col("m").alias("b"), "changed"))
        discard(before)
    # A round that changes nothing gives every edge once.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined_groups(groups: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups (node, component) after the links found (a, b), and what follows for single nodes and for components that some link touches: node, component. Both stashed; only what the links touch is gone through again."""
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    touched = stash(groups.join(ends, "node", "left_semi"))
    changes = stash(components(found.select("a", "b").unionByName(touched.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    named = touched.select("node").unionByName(touched.select(F.col("component").alias("node")))
    single = changes.join(named, "node", "left_anti")
    renamed = groups.join(changes.select(F.col("node").alias("component"), F.col("component").alias("after")), "component", "left")
    after = stash(renamed.select("node", F.coalesce("after", "component").alias("component")).unionByName(single.select("node", "component")))
    discard(touched)
    return after, changes


def _columns(batch: pa.RecordBatch, *numbers: int) -> list[np.ndarray]:
    return [np.asarray(batch.column(k)) for k in numbers]


def _lists(token: np.ndarray, node: np.ndarray, place: np.ndarray, need: Need, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """token, node, list number, by size in each list, of the entries that some other entry of their token may match. Entries are in order of token."""

    def alone(*columns: np.ndarray) -> np.ndarray:
        """Rows that equal no neighbour."""
        same = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
        return ~(np.r_[False, same] | np.r_[same, False])

    keep = ~alone(token)
    token, node, place = token[keep], node[keep], place[keep]
    order = np.lexsort((node, place, token))
    token, node, place = token[order], node[order], place[order]
    fresh = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])][: len(token)]
    token, node, place = token[fresh], node[fresh], place[fresh]
    size, rest = place >> REST_BITS, place & ((1 << REST_BITS) - 1)
    rest = np.where(rest == (1 << REST_BITS) - 1, np.int64(1) << 40, rest)

    def numbers(token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(token):
            return token, token
        # A list also ends where the next size is out of reach of the one before.
        at = np.cumsum(np.r_[True, (token[1:] != token[:-1]) | (size[1:] * ratio > size[:-1] + 1e-9)]) - 1
        return at, np.bincount(at)[at]

    at, count = numbers(token, size)
    keep = count > 1
    token, node, size, rest, at, count = (x[keep] for x in (token, node, size, rest, at, count))
    alive = count > SHORT
    for step in range(1, SHORT):
        i = np.flatnonzero((at[step:] == at[:-step]) & ~(count[step:] > SHORT))
        if not len(i):
            break
        j = i + step
        ok = (np.minimum(rest[i], rest[j]) >= need(size[i], size[j])) & (size[j] * ratio <= size[i] + 1e-9)
        alive[i[ok]] = alive[j[ok]] = True
    token, node, size = token[alive], node[alive], size[alive]
    at, count = numbers(token, size)
    keep = count > 1
    token, node, size, at = token[keep], node[keep], size[keep], at[keep]
    order = np.lexsort((node, size, at))
    return token[order], node[order], at[order]


def index_lists(entries: DataFrame, need: Need, ratio: float, block: int = BLOCK) -> DataFrame:
    """list, part, nodes (stashed): node arrays for every token with nodes that may match, equal arrays once.

    entries: token, node, place. ratio: nodes link only if the smaller size is at least so much of the other. A list over
    two blocks long comes in parts from 1 on, blocks in order of size that overlap by LEADERS nodes; others are part 0.
    Entries come in order of token, so a task holds one Arrow batch and the last token's rows, and of a list without an end
    in sight only some blocks: these go out as parts as they come, unfiltered.
    """
    names = ["token", "part", "nodes"]

    def made(token: np.ndarray, part: np.ndarray, starts: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.r_[starts, len(node)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(part.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(node))], names=names)

    def blocks(token: int, node: np.ndarray, before: int) -> pa.RecordBatch:
        """Parts before + 1 and so on of one long list."""
        cuts = [node[s : s + block + LEADERS] for s in range(0, max(len(node) - LEADERS, 1), block)]
        return made(np.full(len(cuts), token), before + 1 + np.arange(len(cuts)), np.cumsum([0, *map(len, cuts[:-1])]), np.concatenate(cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64)] * 3
        parts = 0  # of the list that held goes on with

        def long(rows: list[np.ndarray]) -> np.ndarray:
            order = np.lexsort((rows[1], rows[2]))
            node = rows[1][order]
            return node[np.r_[True, node[1:] != node[:-1]]]

        def done(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, node, at = _lists(*rows, need, ratio)
            if not len(at):
                return
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sizes = np.diff(np.r_[starts, len(at)])
            short = np.repeat(sizes <= 2 * block, sizes)
            if short.any():
                some = at[short]
                firsts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
                yield made(np.zeros(len(firsts)), np.zeros(len(firsts)), firsts, node[short])
            numbered: dict[int, int] = {}
            for lo, n in zip(starts[sizes > 2 * block].tolist(), sizes[sizes > 2 * block].tolist(), strict=True):
                found = blocks(int(token[lo]), node[lo : lo + n], numbered.get(int(token[lo]), 0))
                numbered[int(token[lo])] = numbered.get(int(token[lo]), 0) + found.num_rows
                yield found

        for batch in batches:
            rows = [np.concatenate([h, x]) for h, x in zip(held, _columns(batch, 0, 1, 2), strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[last:] for x in rows]
            if last:
                begins = 0
                if parts:
                    begins = int(np.searchsorted(rows[0], rows[0][0], side="right"))
                    yield blocks(int(rows[0][0]), long([x[:begins] for x in rows]), parts)
                    parts = 0
                # Two long lists may follow each other, with no other between.
                if last > begins:
                    yield from done([x[begins:last] for x in rows])
            if len(held[0]) > 8 * block:
                # Entries that a node gave from several slices are no longer list.
                own = np.unique(np.stack(held[1:]), axis=1)
                held = [held[0][: own.shape[1]], *own]
            if len(held[0]) > 8 * block:
                found = blocks(int(held[0][0]), long(held), parts)
                parts += found.num_rows
                yield found
                held = [x[-LEADERS:] for x in held]
        if parts:
            yield blocks(int(held[0][0]), long(held), parts)
        elif len(held[0]):
            yield from done(held)

    # One sort key only: Spark then sorts by radix.
    ordered = entries.select("token", "node", "place").repartition("token").sortWithinPartitions("token")
    found = ordered.mapInArrow(run, "token bigint, part int, nodes array<bigint>").distinct()
    return stash(found.select(F.when(F.col("part") == 0, F.xxhash64("nodes")).otherwise(F.col("token")).alias("list"), "part", "nodes"))


def _by_list(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows (list, part, columns numbers, sig) sorted by list and part: whole lists at a time, as columns with the maps last, starts and lengths of the lists."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch.column(2 + columns)
        offsets = np.frombuffer(sig.buffers()[1], dtype=np.int32)[sig.offset : sig.offset + len(sig) + 1]
        maps = np.frombuffer(sig.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(len(sig), -1).view(np.uint64)
        rows = [*_columns(batch, *range(2 + columns)), maps]
        if held is not None:
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
        ends = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        last = int(ends[-1]) if len(ends) else 0
        held = [x[last:] for x in rows]
        if last:
            starts = np.r_[0, ends[:-1]]
            yield [x[:last] for x in rows], starts, np.diff(np.r_[starts, last])
    if held is not None:
        yield held, np.zeros(1, dtype=np.int64), np.array([len(held[0])])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def all_pairs(starts: np.ndarray, counts: np.ndarray, size: np.ndarray, sig: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within the limit of the lists that have at most FEW a node of them, and which lists these are. All lists go on together, a distance in the list at a time; a list with more is left as soon as that shows."""
    ends, at = np.repeat(starts + counts, counts), np.repeat(np.arange(len(starts)), counts)
    made, settled = np.zeros(len(starts), dtype=np.int64), np.ones(len(starts), dtype=bool)
    first, found = np.arange(len(size)), [(np.empty(0, dtype=np.int64),) * 2]
    for step in range(1, int(counts.max(initial=0))):
        first = first[(first + step < ends[first]) & settled[at[first]]]
        if not len(first):
            break
        ok = first[_differ(sig[first], sig[first + step]) <= limit(size[first], size[first + step])]
        found.append((ok, ok + step))
        made += np.bincount(at[ok], minlength=len(starts))
        settled = made <= FEW * counts
    x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return x[settled[at[x]]], y[settled[at[x]]], settled


def leader_pairs(lists: np.ndarray, size: np.ndarray, sig: np.ndarray, limit: Limit) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a leader and each later node of its list within the limit of it; what a leader takes is not compared again. All lists go on together, a leader each at a time."""
    rest = np.arange(len(size))
    for _ in range(LEADERS):
        if not len(rest):
            return
        here = lists[rest]
        heads = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        head = rest[np.repeat(heads, np.diff(np.r_[heads, len(rest)]))]
        ok = (_differ(sig[rest], sig[head]) <= limit(size[rest], size[head])) & (rest != head)
        yield head[ok], rest[ok]
        rest = rest[~ok & (rest != head)]


def lesser_lists(own: int, homes: np.ndarray) -> np.ndarray:
    """Bits [row, words]: two rows of a list whose bits meet are also in one list of a lesser number than own. homes: [row, any], numbers of lists that the row's node is in."""
    row, k = np.nonzero(homes < own)
    _, at, uses = np.unique(homes[row, k], return_inverse=True, return_counts=True)
    shared = uses[at] > 1
    row, at = row[shared], (np.cumsum(uses > 1) - 1)[at[shared]]
    bits = np.zeros((len(homes), (int((uses > 1).sum()) + 63) // 64), dtype=np.uint64)
    np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return bits


#: Of a row and some others, those that it is to be compared with, before their maps are; and of those within the limit, the ones not left to a lesser list.
Choice = tuple[Callable[[int, np.ndarray], np.ndarray], Callable[[int, np.ndarray], np.ndarray]]
EVERY: Choice = (lambda i, others: others, lambda i, others: others)


def choice_of(side: np.ndarray, own: int, homes: np.ndarray) -> Choice:
    """Each pair of nodes is given by one list: the least that both name, and of a long list's pairs of blocks the one that has their two blocks on two sides, or their one block alone."""
    met = lesser_lists(own, homes)
    new = (lambda i, others: others[~(met[others] & met[i]).any(axis=1)]) if met.shape[1] else EVERY[1]
    return (lambda i, others: others[side[others] != side[i]]) if (side != side[0]).any() else EVERY[0], new


def cross_pairs(size: np.ndarray, sig: np.ndarray, group: np.ndarray, limit: Limit, choice: Choice = EVERY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the limit whose groups differ, of those in the choice.

    Maps obey the triangle inequality, so a node's distance to a group's first member, less the group's radius, bounds its
    distance to all members: from that one answer it follows for most nodes that the group holds nothing for them.
    """
    order = np.argsort(group, kind="stable")
    bounds = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        members, others = order[lo:hi], order[hi:]
        if not len(others):
            return
        if len(members) > 4:
            far = _differ(sig[others], sig[members[0]]) - _differ(sig[members], sig[members[0]]).max()
            allowed = np.max([limit(size[others], np.full(len(others), n)) for n in np.unique(size[members])], axis=0)
            others = others[(far <= allowed) & (allowed >= 0)]
        for i in members.tolist():
            own = choice[0](i, others)
            ok = choice[1](i, own[_differ(sig[own], sig[i]) <= limit(size[own], np.full(len(own), size[i]))])
            yield np.full(len(ok), i), ok


def nearest_pairs(size: np.ndarray, sig: np.ndarray, group: np.ndarray, limit: Limit, choice: Choice = EVERY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each node, the NEAREST nodes of other groups within the limit, of those in the choice; so over all lists its nearest are among them."""
    for i in range(len(size)):
        others = choice[0](i, np.flatnonzero(group != group[i]))
        others = choice[1](i, others[_differ(sig[others], sig[i]) <= limit(size[others], np.full(len(others), size[i]))])
        others = others[np.argsort(_differ(sig[others], sig[i]), kind="stable")[:NEAREST]]
        yield np.full(len(others), i), others


def _pairs(found: list[tuple[np.ndarray, np.ndarray]], opened: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (a, b, opened): pairs of nodes, the lesser first, once each; then lists and parts to open."""
    none = np.empty(0, dtype=np.int64)
    a, b = (np.concatenate([none, *(f[k] for f in found)]) for k in (0, 1))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    lists, parts = (np.concatenate([none, *(f[k] for f in opened)]) for k in (0, 1))
    columns = [np.concatenate([pairs[:, 0], lists]), np.concatenate([pairs[:, 1], parts]), np.repeat([False, True], [len(pairs), len(lists)])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "opened"])


def met_before(x: np.ndarray, y: np.ndarray, own: np.ndarray, homes: np.ndarray) -> np.ndarray:
    """Which pairs of rows also meet in a lesser list. own: the number of each row's list. homes: [row, HOMES], the least numbers of the lists that its node is in."""
    met = np.zeros(len(x), dtype=bool)
    for k in range(homes.shape[1]):
        met |= (homes[y] == homes[x, k][:, None]).any(axis=1) & (homes[x, k] < own[x])
    return met


def homes_of(rows: DataFrame, most: int) -> DataFrame:
    """node, home_0 and so on: the least numbers (own) of its rows, as many as `most`; the largest long where there are fewer."""
    named = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("own")), 1, most).alias("homes"))
    return named.select("node", *[F.coalesce(F.get("homes", F.lit(k)), F.lit((1 << 63) - 1)).alias(f"home_{k}") for k in range(most)])


def first_pairs(lists: DataFrame, payload: DataFrame, limit: Limit) -> DataFrame:
    """a, b, opened (stashed): pairs to verify (opened false), and the lists (a) and parts (b) whose pairs are not all answered by that.

    Near copies meet in most of their lists. A leader's pair whose rows name a common list of a lesser number is left to that
    one, which gives all pairs, or this one, or is opened; so near copies give some rows a node, not one for each list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lists, parts, node, size, own, *homes, sig), starts, counts in _by_list(batches, 3 + HOMES):
            named = np.stack(homes, axis=1)
            x, y, settled = all_pairs(starts, counts, size, sig, limit)
            dense = np.flatnonzero(np.repeat(~settled, counts))
            led = leader_pairs(np.repeat(np.arange(len(starts)), counts)[dense], size[dense], sig[dense], limit)
            found = [(x, y)]
            for i, j in ((dense[i], dense[j]) for i, j in led):
                new = ~met_before(i, j, own, named)
                found.append((i[new], j[new]))
            # The parts of a long list say nothing of pairs across them.
            open_ = starts[~settled | (parts[starts] > 0)]
            yield _pairs([(node[i], node[j]) for i, j in found], [(lists[open_], parts[open_].astype(np.int64))])

    rows = lists.select("list", "part", F.xxhash64("list", "part").alias("own"), F.explode("nodes").alias("node"))
    named = homes_of(rows, HOMES)
    rows = rows.join(payload, "node").join(named, "node").select("list", "part", "node", "size", "own", *named.columns[1:], "sig")
    return stash(rows.repartition("list", "part").sortWithinPartitions("list", "part", "size", "node").mapInArrow(run, "a bigint, b bigint, opened boolean").distinct())


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of lists that hold more than one group."""
    mixed = rows.groupBy("list", "part").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    return rows.join(mixed.select("list", "part"), ["list", "part"], "left_semi")


def open_rows(lists: DataFrame, opened: DataFrame, groups: DataFrame, payload: DataFrame) -> DataFrame:
    """list, part, node, size, group (stashed) of the opened lists that hold more than one group. All parts of a long list count as one list."""
    picked = lists.join(opened.select(F.col("a").alias("list"), F.col("b").cast("int").alias("part")), ["list", "part"], "left_semi")
    rows = picked.select("list", F.least("part", F.lit(1)).alias("part"), F.explode("nodes").alias("node")).distinct()
    rows = rows.join(groups.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    return stash(_mixed(rows).join(payload.select("node", "size"), "node"))


def regrouped(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows (stashed) of open_rows that are left under the changes of joined_groups."""
    rows = rows.join(changes.select(F.col("node").alias("group"), F.col("component").alias("after")), "group", "left")
    return stash(_mixed(rows.withColumn("group", F.coalesce("after", "group")).select("list", "part", "node", "size", "group")))


def cells_of(long: DataFrame, ratio: float, block: int = BLOCK) -> DataFrame:
    """list, part, node, group, own (number of the long list), side (the node's block): pairs of blocks of the long lists, as lists of their own.

    Blocks hold nodes of about one size, and of one group where the list holds over a block of that group. Two blocks of
    the same such group answer nothing new, nor do blocks of sizes out of reach; all other pairs of blocks are kept.
    """
    bulk = long.groupBy("list", "group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("list", "group", F.col("group").alias("bulk"))
    keyed = long.join(bulk, ["list", "group"], "left").withColumn("band", F.floor(F.log("size") * 20))
    spread = keyed.groupBy("list", "bulk", "band").agg(F.ceil(F.count(F.lit(1)) / block).alias("salts")).withColumnsRenamed({"list": "s_list", "bulk": "s_bulk", "band": "s_band"})
    keyed = keyed.join(spread, (F.col("list") == F.col("s_list")) & F.col("bulk").eqNullSafe(F.col("s_bulk")) & (F.col("band") == F.col("s_band")))
    keyed = keyed.withColumn("block", F.xxhash64(F.coalesce("bulk", F.lit(0)), F.col("bulk").isNull(), "band", F.pmod(F.xxhash64("node"), "salts"))).select("list", "node", "size", "group", "bulk", "block")
    spans = keyed.groupBy("list", "bulk", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = spans.select("list", *[F.col(c).alias(f"o_{c}") for c in ("bulk", "block", "low", "high")])
    near = (F.col("high") >= ratio * F.col("o_low") - 1e-9) & (F.col("o_high") >= ratio * F.col("low") - 1e-9)
    same = F.coalesce(F.col("bulk") == F.col("o_bulk"), F.lit(False))
    cells = spans.join(other, "list").where((F.col("block") <= F.col("o_block")) & near & ~same)
    cells = cells.select("list", F.xxhash64("list", "block", "o_block").alias("cell"), F.explode(F.array_distinct(F.array("block", "o_block"))).alias("block"))
    own = F.xxhash64("list", F.lit(1)).alias("own")
    return keyed.join(cells, ["list", "block"]).select(F.col("cell").alias("list"), F.lit(1).alias("part"), "node", "group", own, F.col("block").alias("side"))


def pairs_across(rows: DataFrame, payload: DataFrame, limit: Limit, ratio: float, block: int, choose: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """a, b (stashed): pairs to verify across the groups of the opened lists, those that nearest_pairs or cross_pairs choose. rows: as open_rows gives them.

    Nodes that may link meet in most of their lists; choice_of leaves each pair to one list, as far as rows name their lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, node, size, group, own, side, *homes, sig), starts, counts in _by_list(batches, 5 + OPEN_HOMES):
            named = np.stack(homes, axis=1)
            found = []
            for lo, n in zip(starts.tolist(), counts.tolist(), strict=True):
                here = slice(lo, lo + n)
                if n > 1 and (group[here] != group[lo]).any():
                    choice = choice_of(side[here], int(own[lo]), named[here])
                    found += [(node[lo + x], node[lo + y]) for x, y in choose(size[here], sig[here], group[here], limit, choice) if len(x)]
            yield _pairs(found, [])

    own = F.xxhash64("list", "part").alias("own")
    short = rows.where("part = 0").select("list", "part", "node", "group", own, F.lit(0).cast("long").alias("side"))
    named = homes_of(rows.select("node", own), OPEN_HOMES)
    long = rows.where("part > 0")
    every = short if long.isEmpty() else short.unionByName(cells_of(long, ratio, block))
    full = every.join(payload, "node").join(named, "node").select("list", "part", "node", "size", "group", "own", "side", *named.columns[1:], "sig")
    return stash(full.repartition("list", "part").sortWithinPartitions("list", "part", "size", "node").mapInArrow(run, "a bigint, b bigint, opened boolean").select("a", "b").distinct())


def find_groups(entries: DataFrame, payload: DataFrame, limit: Limit, need: Need, verify: Callable[[DataFrame], DataFrame], ratio: float, block: int = BLOCK) -> DataFrame:
    """node, component for every node that has a verified link.

    entries: token, node, place. payload: node, size, sig (binary parity map, whole 64-bit words). verify: pairs (a, b) to
    those of them that link, stashed. ratio: nodes link only if the smaller size is at least so much of the other.
    """
    lists = index_lists(entries, need, ratio, block)
    firsts = first_pairs(lists, payload, limit)
    links = verify(firsts.where("NOT opened").select("a", "b"))
    groups = stash(components(links))
    discard(links)
    opened = firsts.where("opened")
    if not opened.isEmpty():
        rows, tried = open_rows(lists, opened, groups, payload), None
        for choose in (nearest_pairs, cross_pairs):
            more = pairs_across(rows, payload, limit, ratio, block, choose)
            found = verify(more if tried is None else more.join(tried, ["a", "b"], "left_anti"))
            if not found.isEmpty():
                before, (groups, changes) = groups, joined_groups(groups, found)
                discard(before)
                if choose is nearest_pairs:
                    before, rows = rows, regrouped(rows, changes)
                    discard(before)
                discard(changes)
            discard(found, *([] if tried is None else [tried]))
            tried = more
        discard(rows, tried)
    discard(lists, firsts)
    return groups
