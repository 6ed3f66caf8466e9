"""A work queue kept as the state of a stream: commands in, an append-only log of transitions out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmart.functions.durable import ensure_checkpoint_dir

LOG = "target long, item long, at_ms long, event_id long, command string, before string, after string, verdict string, attempts int"
STATE = "item long, status string, attempts int, lease_ms long, last_ms long, last_id long"
#: Attempts after which an item has failed for good, and milliseconds for which a claim holds.
MOST_ATTEMPTS, LEASE_MS = 3, 12 * 3600 * 1000
#: The event of a transition that no command made.
NO_EVENT = -1


@dataclass
class Item:
    """The item of a target that was queued last."""

    item: int = 0
    status: str = "none"
    attempts: int = 0
    lease_ms: int = 0
    last_ms: int = -(2**62)
    last_id: int = -(2**62)

    def missed(self) -> tuple[str, str]:
        """An attempt that came to nothing: back to the queue, or failed for good."""
        self.attempts += 1
        self.status = "failed" if self.attempts >= MOST_ATTEMPTS else "pending"
        return self.status, "failed" if self.status == "failed" else "retry"

    def expired(self, now_ms: int) -> bool:
        return self.status == "running" and self.lease_ms < now_ms

    def apply(self, command: str, now_ms: int) -> str:
        """The verdict on a command; only legal ones change anything."""
        if command == "enqueue":
            if self.status in ("pending", "running"):
                return "duplicate"
            self.item, self.status, self.attempts = self.item + 1, "pending", 0
            return "accepted"
        if command == "claim" and self.status == "pending":
            self.status, self.lease_ms = "running", now_ms + LEASE_MS
            return "accepted"
        if self.status == "running" and command in ("extend", "complete", "fail"):
            if command == "extend":
                self.lease_ms = now_ms + LEASE_MS
            elif command == "complete":
                self.status = "completed"
            else:
                return self.missed()[1]
            return "accepted"
        return "rejected"


def _run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    item = Item(*state.get) if state.exists else Item()
    rows: list[tuple] = []

    def expire() -> None:
        before = item.status
        after, verdict = item.missed()
        rows.append((key[0], item.item, item.lease_ms, NO_EVENT, "expire", before, after, verdict, item.attempts))

    if state.hasTimedOut:
        if item.expired(state.getCurrentWatermarkMs()):
            expire()
    else:
        # the commands of one target in one micro-batch
        commands = pd.concat(list(frames)).sort_values(["at_ms", "event_id"], kind="stable")
        for now, event, command in zip(commands["at_ms"], commands["event_id"], commands["command"], strict=True):
            now, event = int(now), int(event)
            if (now, event) <= (item.last_ms, item.last_id):
                continue  # a replay, or a command that comes after later ones
            if item.expired(now):
                expire()
            before = item.status
            verdict = item.apply(command, now)
            item.last_ms, item.last_id = now, event
            rows.append((key[0], item.item, now, event, command, before, item.status, verdict, item.attempts))
    state.update((item.item, item.status, item.attempts, item.lease_ms, item.last_ms, item.last_id))
    if item.status == "running":
        state.setTimeoutTimestamp(max(item.lease_ms, state.getCurrentWatermarkMs() + 1, 1))
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in LOG.split(", ")])
    yield frame


def queue_log(spark: SparkSession, commands: DataFrame, lateness: str = "1 hour", base: str | None = None) -> DataFrame:
    """The log of every transition of a stream of commands (target, event_id, event_time, command).

    A target has one open item at most: enqueue is a duplicate while it is pending or running. A claim holds for
    LEASE_MS, which ``extend`` renews; a claim that has run out, noticed by the target's next command or by the
    watermark, counts as a missed attempt at the time it ran out, as ``fail`` does. A missed attempt goes back to the
    queue until there have been MOST_ATTEMPTS. Everything else is rejected and logged as such.

    State is one row a target. Commands at or before the last one of their target are replays and change nothing; those
    later than ``lateness`` are dropped. With the same ``base`` folder a run goes on where the last one ended, and each
    batch is in the log once, whatever is run again.
    """
    ensure_checkpoint_dir(spark)
    base = base or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/queue-{uuid.uuid4().hex}"
    rows = commands.withWatermark("event_time", lateness)
    rows = rows.select("target", "event_id", "event_time", F.unix_millis("event_time").alias("at_ms"), "command")
    log = rows.groupBy("target").applyInPandasWithState(_run, LOG, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    query = log.writeStream.format("parquet").option("path", f"{base}/log").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(LOG).parquet(f"{base}/log")


def commands_of(spark: SparkSession, folder: str, files: str, schema: str, names: dict[str, str]) -> DataFrame:
    """A stream of commands out of event files: one for each event whose type has a name."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    command = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in names.items()])
    return rows.select(F.col("user_id").alias("target"), "event_id", F.col("ts").cast("timestamp").alias("event_time"), command.alias("command")).where("command IS NOT NULL AND target IS NOT NULL AND event_time IS NOT NULL AND event_id IS NOT NULL")
