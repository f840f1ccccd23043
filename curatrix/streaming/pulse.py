"""Micro-batch mirror of the scheduled pulse: the same operators over streams, with the same results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from curatrix.buckets import BucketedTable
from curatrix.functions import status as S
from curatrix.functions.dates import days_since
from curatrix.lineage import cut
from curatrix.operators import upsert
from curatrix.store import Store


def read_batches(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def merge_stream(stream: DataFrame, store: Store, table: str, now, content: list[str], checkpoint: str, key: str = "source_url"):
    """Merges every micro-batch into the stored table; equal content makes a replayed batch change nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        stored = store.read(table)
        store.write(table, upsert.snapshot(batch, stored, now(number), content, key))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(stream: DataFrame, table: BucketedTable, now, content: list[str], evidence, checkpoint: str, name: str = "ingest", pos: str = "pos", between=lambda step: None):
    """Merges every micro-batch into a bucketed table with its run rows, once each.

    Data, run rows and the batch's number are one commit, so a batch that Spark repeats after a failure, whichever write
    it came after, is found in the table and left out.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(cut(batch), now(number), content, pos, name, number, evidence, between=between)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Microseconds.
DAY = 86_400_000_000
FAILURES = "artifact_id long, run long, verdict string, checked_at timestamp"


def failure_counters(checks: DataFrame, watermark: str = "90 days") -> DataFrame:
    """Consecutive transient observations of each record, with state that an ok resets.

    checks (artifact_id, checked_at, id, http_status), with event time; one row per observation. State of a record ends
    when the watermark has passed its last observation, so when the newest one of all is that much newer.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run, latest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["checked_at", "id"])
        out = []
        for v, at in zip(rows["verdict"], rows["checked_at"], strict=True):
            run = 0 if v == "ok" else run + (v == "transient")
            out.append((key[0], run, v, at))
        # A late batch does not bring the end of the state nearer. A timeout has to be behind the watermark.
        latest = max(latest, int(rows["checked_at"].iloc[-1].timestamp() * 1000))
        state.update((run, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["artifact_id", "run", "verdict", "checked_at"])

    v = checks.withColumn("verdict", S.verdict(F.col("http_status"))).withWatermark("checked_at", watermark)
    return v.groupBy("artifact_id").applyInPandasWithState(count, FAILURES, "run long, latest long", "append", GroupStateTimeout.EventTimeTimeout)


MACHINE = "artifact_id long, terminal boolean, run long"


def reason_states(checks: DataFrame, keep_days: int = 365) -> DataFrame:
    """(artifact_id, terminal, run) of each record that a micro-batch has seen, as `checks.trailing_runs` has them of all
    observations; to be written in update mode. checks (artifact_id, checked_at, id, http_status).

    A record's state does not depend on the order of what comes, nor on repeats: whether any observation was terminal
    (kept for good), the last ok, and for each day the last transient observation. A late ok takes back the days before
    it, a late failure behind a newer ok counts for nothing. Days ``keep_days`` before the record's newest observation end.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        terminal, ok, newest, days = json.loads(state.get[0]) if state.exists else (False, None, 0, {})
        for rows in batches:
            micros = rows["checked_at"].astype("datetime64[us]").astype("int64")
            for verdict, at, number in zip(rows["verdict"], micros, rows["id"], strict=True):
                seen, newest = [int(at), int(number)], max(newest, int(at))
                terminal = terminal or verdict == "terminal"
                if verdict == "ok":
                    ok = seen if ok is None else max(ok, seen)
                elif verdict == "transient":
                    day = str(int(at) // DAY)
                    days[day] = max(days.get(day, seen), seen)
        days = {d: s for d, s in days.items() if (ok is None or s > ok) and s[0] > newest - keep_days * DAY}
        state.update((json.dumps([terminal, ok, newest, days]),))
        yield pd.DataFrame({"artifact_id": [key[0]], "terminal": [terminal], "run": [len(days)]})

    v = checks.select("artifact_id", "checked_at", "id", S.verdict(F.col("http_status")).alias("verdict"))
    return v.groupBy("artifact_id").applyInPandasWithState(fold, MACHINE, "content string", "update", GroupStateTimeout.NoTimeout)


def reasons_of(states: DataFrame, last_seen: DataFrame, now: str, key: str = "artifact_id") -> DataFrame:
    """(key, terminal, run, days_old, reason) from the last states, as `checks.inactive_reasons` has them."""
    joined = last_seen.join(states, key, "left")
    terminal, run = F.coalesce("terminal", F.lit(False)), F.coalesce("run", F.lit(0))
    days = days_since(F.col("last_seen_at"), now)
    return joined.select(key, terminal.alias("terminal"), run.alias("run"), days.alias("days_old"), S.inactive_reason(terminal, run, days).alias("reason"))


def windowed_tally(checks: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Verdict counts by window of event time, late rows included up to a watermark."""
    v = checks.withColumn("verdict", S.verdict(F.col("http_status"))).withWatermark("checked_at", late)
    return v.groupBy(F.window("checked_at", width).alias("w"), "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "verdict", "n")


def without_replays(checks: DataFrame, late: str = "90 days") -> DataFrame:
    """Observations once each, however often they are sent within the watermark."""
    return checks.withWatermark("checked_at", late).dropDuplicatesWithinWatermark(["id"])
