"""Change streams: changes coalesce into refresh batches, in batch form and as Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A batch closes after this quiet time, or this long after its first change; more distinct paths than this become one rescan.
QUIET_MS, LONGEST_MS, MOST_PATHS = 250, 1000, 512
CHANGES = "bundle_id string, ts timestamp, kind string, uri string, previous_uri string"


def sessions(changes: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """bundle_id, start, end (last change), changes, paths: a quiet gap closes a session. ts may be with or without a zone."""
    changes = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("bundle_id").orderBy("ts")
    gap = F.unix_millis("ts") - F.lag(F.unix_millis("ts")).over(w)
    numbered = changes.withColumn("_new", F.when(gap.isNull() | (gap >= quiet_ms), 1).otherwise(0)).withColumn("_session", F.sum("_new").over(w))
    return numbered.groupBy("bundle_id", "_session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("changes"), F.count_distinct("uri").alias("paths")).drop("_session")


def capped_batches(changes: DataFrame, quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS) -> DataFrame:
    """changes with batch_start: as sessions, but a batch also ends longest_ms after its first change.

    Where a batch starts depends on all before it, so a bundle's changes are walked in order, one step per batch: the
    next batch begins at the first quiet gap or at the first change past the cap, whichever comes first, and both are
    looked up. A task carries one start and one last time from frame to frame.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, first, last = None, 0, 0
        for frame in frames:
            ms, starts = frame["_ms"].to_numpy(), np.empty(len(frame), dtype=np.int64)
            cuts = np.flatnonzero((frame["bundle_id"] != frame["bundle_id"].shift()).to_numpy()).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(frame)], strict=True):
                if frame["bundle_id"].iat[lo] != bundle or ms[lo] - last >= quiet_ms:
                    bundle, first = frame["bundle_id"].iat[lo], ms[lo]
                quiet = lo + 1 + np.flatnonzero(np.diff(ms[lo:hi]) >= quiet_ms)
                at = lo
                while at < hi:
                    if ms[at] - first >= longest_ms:
                        first = ms[at]
                    gap = np.searchsorted(quiet, at, side="right")
                    end = min(int(quiet[gap]) if gap < len(quiet) else hi, at + int(np.searchsorted(ms[at:hi], first + longest_ms)))
                    starts[at:end] = first
                    at = end
                    if at < hi:
                        first = ms[at]
                last = ms[hi - 1]
            yield frame.assign(batch_start=starts).drop(columns="_ms")

    rows = changes.withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    ordered = rows.repartition("bundle_id").sortWithinPartitions("bundle_id", "_ms")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema) + ", batch_start bigint"
    return ordered.mapInPandas(run, schema)


def coalesced(batches: DataFrame, *by: str, most_paths: int = MOST_PATHS) -> DataFrame:
    """Per batch: distinct (kind, previous_uri, uri), distinct paths, and whether it collapses into one rescan."""
    unique = batches.groupBy(*by, "kind", "previous_uri", "uri").agg(F.min("ts").alias("ts"))
    out = unique.groupBy(*by).agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("uri").alias("paths"), F.max((F.col("kind") == "rescan").cast("int")).alias("asked"))
    rescan = (F.col("paths") > most_paths) | (F.col("changes") > most_paths + 1) | (F.col("asked") == 1)
    return out.select(*by, F.when(rescan, 1).otherwise(F.col("changes")).cast("long").alias("changes"), "paths", rescan.alias("rescan"))


def newest(messages: DataFrame, key: str, *order: str) -> DataFrame:
    """Messages that are accepted in arrival order: a later revision, or a later delivery (delivery_id) of the same one.

    Messages without a column delivery_id cannot be told apart within a revision, so those of the current one pass. The
    window reads a key's rows in order and holds one maximum.
    """
    w = Window.partitionBy(key).orderBy(*order)
    told = "delivery_id" in messages.columns
    now = F.struct("revision", "delivery_id") if told else F.struct("revision")
    before = F.max(now).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = now > F.col("_top") if told else now >= F.col("_top")
    return messages.withColumn("_top", before).where(F.col("_top").isNull() | later).drop("_top")


def newest_stream(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Streaming twin of newest: each key keeps the last accepted revision and delivery as a value state, and nothing else.

    Rows of a micro-batch are taken in order of `order`; across batches, as they arrive.
    """
    schema, names = messages.schema, messages.columns

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.top = handle.getValueState("top", "revision bigint, delivery_id bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            top = tuple(self.top.get()) if self.top.exists() else (-1, 0)
            batch = pd.concat(list(rows)).sort_values([order, "revision", "delivery_id"], kind="stable")
            said = list(zip(batch["revision"].tolist(), batch["delivery_id"].tolist(), strict=True))
            taken = []
            for pair in said:
                taken.append(pair > top)
                top = max(top, pair)
            self.top.update(top)
            yield batch[np.array(taken, dtype=bool)][names]

        def close(self) -> None:
            pass

    return messages.groupBy(key).transformWithStateInPandas(Latest(), schema, "Append", "None")


def coalesce_stream(changes: DataFrame, late: str = "10 seconds", quiet_ms: int = QUIET_MS, most_paths: int = MOST_PATHS) -> DataFrame:
    """Streaming twin of sessions and coalesced: equal changes once, one row per closed session."""
    session = F.session_window("ts", f"{quiet_ms} milliseconds")
    marked = changes.withWatermark("ts", late)
    found = marked.groupBy("bundle_id", session.alias("session")).agg(F.collect_set(F.struct("kind", "previous_uri", "uri")).alias("all"), F.max((F.col("kind") == "rescan").cast("int")).alias("asked"))
    paths = F.size(F.array_distinct(F.transform("all", lambda c: c["uri"])))
    rescan = (paths > most_paths) | (F.size("all") > most_paths + 1) | (F.col("asked") == 1)
    none: Column = F.array().cast("array<struct<kind:string,previous_uri:string,uri:string>>")
    return found.select("bundle_id", F.col("session.start").alias("start"), rescan.alias("rescan"), F.when(rescan, none).otherwise(F.col("all")).alias("changes"))


def capped_stream(changes: DataFrame, late: str = "10 seconds", quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS, most_paths: int = MOST_PATHS) -> DataFrame:
    """Streaming twin of capped_batches and coalesced: bundle_id, batch_start (ms), changes, paths, rescan, one row per closed batch.

    The state of a bundle is one open batch: its start, its last change and the distinct changes, of which no more are
    kept than it takes to become a rescan. A change of kind `context` closes what is open and begins with a rescan, as
    nothing known before it holds. A batch closes by a later change or once the watermark passes its deadline; changes
    should come in order of time within what `late` allows.
    """
    names = ["bundle_id", "batch_start", "changes", "paths", "rescan"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, all_, context = (*state.get[:2], json.loads(state.get[2]), state.get[3]) if state.exists else (None, 0, [], False)
        known, closed = {tuple(c) for c in all_}, []

        def close() -> None:
            paths = len({c[2] for c in known})
            rescan = context or paths > most_paths or len(known) > most_paths + 1 or any(c[0] == "rescan" for c in known)
            closed.append((key[0], start, 1 if rescan else len(known), paths, rescan))

        if state.hasTimedOut:
            close()
            start, known = None, set()
        else:
            rows = pd.concat(list(frames))
            rows = rows.sort_values("_ms", kind="stable")
            for ms, kind, before, uri in zip(rows["_ms"].tolist(), rows["kind"], rows["previous_uri"], rows["uri"], strict=True):
                if start is not None and (ms - last >= quiet_ms or ms - start >= longest_ms or kind == "context"):
                    close()
                    start = None
                if start is None:
                    start, known, context = ms, set(), kind == "context"
                last = ms
                if len(known) <= most_paths + 1:
                    known.add((kind, before, uri))
        if start is None:
            state.remove()
        else:
            state.update((start, last, json.dumps(sorted(known, key=repr)), context))
            state.setTimeoutTimestamp(max(min(last + quiet_ms, start + longest_ms), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=names)

    grouped = changes.withColumn("_ms", F.unix_millis(F.col("ts").cast("timestamp"))).withWatermark("ts", late).groupBy("bundle_id")
    return grouped.applyInPandasWithState(step, "bundle_id string, batch_start bigint, changes bigint, paths bigint, rescan boolean", "start bigint, last bigint, pending string, context boolean", "append", GroupStateTimeout.EventTimeTimeout)


def publish(batches: DataFrame, views: dict[str, Callable[[DataFrame, int], DataFrame]], write: Callable[[str, DataFrame, int], None], checkpoint: str, failed: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Recomputes every view of the bundles that a micro-batch touches and hands each to write(name, rows, revision).

    failed(touched) gives the touched bundles whose root cannot be read: their views are written empty, while documents
    that fail alone leave theirs as they are. The revision is the micro-batch's number, so a batch that runs again
    overwrites itself.
    """

    def run(df: DataFrame, revision: int) -> None:
        touched = df.select("bundle_id").distinct()
        sound = touched.join(failed(touched).select("bundle_id"), "bundle_id", "left_anti")
        for name, view in views.items():
            write(name, view(touched, revision).join(sound, "bundle_id", "left_semi"), revision)

    return batches.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(run).start()


def refresh(batches: DataFrame, recompute, checkpoint: str) -> StreamingQuery:
    """Runs recompute(touched bundles, batch id) for each micro-batch; the batch id is the revision, so a repeated batch overwrites itself."""
    return batches.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(lambda df, k: recompute(df.select("bundle_id").distinct(), k)).start()
