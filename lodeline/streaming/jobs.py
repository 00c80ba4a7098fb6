"""Structured Streaming versions of the store's stateful steps."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeline.operators.index import SnapshotStore, refresh


def commit_once(turns: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each turn_id once: copies that arrive within `delay` of the watermark change nothing. created_at may be without a zone."""
    timed = turns.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["turn_id"])


def events_per_window(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Count and sum of values by event type and tumbling window; events later than `delay` are left out once their window is closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def quota(calls: DataFrame, limit: int = 6) -> DataFrame:
    """(turn_id, tool, call_id, call_no, allowed) for calls of tools within a turn, counted across micro-batches; failures count too. A counter is dropped after a day without calls."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values("call_id", kind="stable", ignore_index=True)
            n = done + 1 + pdf.index.to_numpy()
            done += len(pdf)
            yield pd.DataFrame({"turn_id": key[0], "tool": key[1], "call_id": pdf["call_id"], "call_no": n, "allowed": n <= limit})
        state.update((done,))
        state.setTimeoutDuration(86_400_000)

    return calls.groupBy("turn_id", "tool").applyInPandasWithState(count, "turn_id string, tool string, call_id long, call_no long, allowed boolean", "done long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _summary(before: str, new: str, most: int) -> str:
    """The start of what there was and the end of what is new, within `most` characters."""
    if not before:
        return new if len(new) <= most else "…" + new[len(new) - most + 1 :]
    fresh = new if len(new) <= int(most * 0.6) else "…" + new[len(new) - int(most * 0.6) + 1 :]
    room = most - len(fresh) - 1
    return (before if len(before) <= room else before[: room - 1] + "…") + "\n" + fresh


def rolling_compaction(messages: DataFrame, trigger: int = 24, keep: int = 11, summary_chars: int = 1_600, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Keyed conversation state: messages (thread_id, id, line) are appended, a null line removes its id, and beyond `trigger` only the last `keep` stay, the rest going into a summary of bounded length.

    The state of a thread is thus bounded too, and is dropped after `idle_ms` without messages. The oldest part of a summary is kept at its start, as without streaming. Result for each thread and micro-batch: thread_id, kept ids, removed ids, summary.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, summary = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], "")
        removed: list[int] = []
        for pdf in batches:
            for r in pdf.sort_values("id", kind="stable").itertuples():
                held = [m for m in held if m[0] != int(r.id)]
                if r.line is not None:
                    held.append([int(r.id), r.line])
                if len(held) >= trigger:
                    old, held = held[:-keep], held[-keep:]
                    removed += [m[0] for m in old]
                    summary = _summary(summary, "\n".join(m[1] for m in old), summary_chars)
        state.update((json.dumps(held), summary))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"thread_id": [key[0]], "kept": [[m[0] for m in held]], "removed": [removed], "summary": [summary]})

    return messages.groupBy("thread_id").applyInPandasWithState(fold, "thread_id string, kept array<long>, removed array<long>, summary string", "held string, summary string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def refresh_on_change(files: DataFrame, store: SnapshotStore, settings: dict, build: Callable[[DataFrame], DataFrame], seen: Callable[[], DataFrame]) -> DataStreamWriter:
    """A writer that brings the index up to date with each micro-batch of changed files; `seen` gives all chunk rows as they are now, of which only sources and digests are compared, and texts of changed buckets read. A batch that is run again after a failure changes nothing."""

    def one_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh(store, seen(), settings, build)

    return files.writeStream.foreachBatch(one_batch)
