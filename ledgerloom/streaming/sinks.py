"""Events published at least once: as a stream with one line per event, or one event at a time.

The stream writes each micro-batch as JSON lines into a folder named by its number, so
that a repeated batch overwrites its own lines; the single-event publisher appends to one
file on the driver, repairs a partial last line first, takes a short write back, and
syncs before it reports success.  Readers deduplicate by event id.
"""

from __future__ import annotations

import json
import os
import sys
from datetime import datetime
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup
from ..operators.events import attempted, oldest_pending

MAX_REPORT = 8 * 1024 * 1024


def event_lines(events: DataFrame) -> DataFrame:
    """Each event as one JSON line."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def publish_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of events as JSON lines, one run over what is there."""

    def write(batch: DataFrame, number: int) -> None:
        event_lines(batch).write.mode("overwrite").text(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated_stream(deliveries: DataFrame, path: str, checkpoint: str, id_col: str, order_cols: list[str]) -> StreamingQuery:
    """Append one row of each id that the table at ``path`` does not hold yet.

    A micro-batch goes to a folder of its own number and is compared with the batches
    before it alone, so a batch that is repeated after a failure gives the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number and Path(path.removeprefix("file:")).exists() or number and _exists(spark, path):
            stored = spark.read.schema(batch.schema.add("batch", "long")).parquet(path).filter(F.col("batch") < number)
            batch = dedup.admit_new(stored, batch, id_col, order_cols)
        else:
            batch = dedup.keep_one(batch, id_col, order_cols)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return deliveries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def windowed_counts(events: DataFrame, time_col: str, window: str, lateness: str, keys: list[str]) -> DataFrame:
    """Counts per key and window of a stream, closed once the watermark has passed."""
    return events.withWatermark(time_col, lateness).groupBy(F.window(time_col, window), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def append_line(path: str | Path, record: dict) -> None:
    """Append one record as a line, durable when this returns; a failed write leaves the file as it was."""
    line = (json.dumps(record, ensure_ascii=False, separators=(",", ":")) + "\n").encode()
    handle = os.open(path, os.O_RDWR | os.O_CREAT, 0o600)
    try:
        size = os.lseek(handle, 0, os.SEEK_END)
        keep = _whole_lines(handle, size)
        if keep < size:
            os.ftruncate(handle, keep)
        os.lseek(handle, keep, os.SEEK_SET)
        try:
            if os.write(handle, line) != len(line):
                raise OSError("short write")
            os.fsync(handle)
        except OSError:
            os.ftruncate(handle, keep)
            raise
    finally:
        os.close(handle)


def _whole_lines(handle: int, size: int, block: int = 65536) -> int:
    """The length of the file up to its last line end, looking from the end."""
    end = size
    while end:
        start = max(0, end - block)
        at = os.pread(handle, end - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def write_report(path: str | Path, report: dict) -> None:
    """Write a new report within the size cap; an existing file is never replaced."""
    data = json.dumps(report, ensure_ascii=False, indent=2).encode() + b"\n"
    if len(data) > MAX_REPORT:
        raise ValueError("the report is too large")
    with open(path, "xb") as out:
        out.write(data)
        out.flush()
        os.fsync(out.fileno())


def print_json(rows: DataFrame, out: TextIO | None = None, limit: int = 1000) -> None:
    """A bounded frame as one indented JSON list on standard output; more than ``limit`` rows are an error."""
    held = [json.loads(r) for r in rows.limit(limit + 1).toJSON().collect()]
    if len(held) > limit:
        raise ValueError("the result is too large to print")
    (out or sys.stdout).write(json.dumps(held, ensure_ascii=False, indent=2) + "\n")


def distinct_outputs(*paths: str | Path) -> None:
    """Fail unless all output paths differ and none exists."""
    real = [Path(p).resolve() for p in paths]
    if len(set(real)) < len(real) or any(p.exists() for p in real):
        raise FileExistsError("output paths must be distinct and absent")


def failure_category(error: BaseException) -> str:
    """A failed publication as a fixed category."""
    return "timeout" if isinstance(error, TimeoutError) else "transport"


def publish_next(events: DataFrame, outbox: DataFrame, path: str | Path, now: datetime | None = None) -> DataFrame | None:
    """Publish the oldest pending event to a file and give its next outbox version, at ``now``; None where nothing is pending.

    The line is durable before the version exists, so a crash in between repeats the same event id: at least once.
    """
    chosen = oldest_pending(events, outbox).select(*events.columns, "attempt_count").collect()  # at most one row
    if not chosen:
        return None
    row = chosen[0].asDict(recursive=True)
    expected = row.pop("attempt_count")
    failure = None
    try:
        append_line(path, {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in row.items()})
    except OSError as error:
        failure = failure_category(error)
    attempt = events.sparkSession.createDataFrame([(row["event_id"], expected, failure)], "event_id string, expected long, failure string")
    return attempted(outbox, attempt.withColumn("at", F.current_timestamp() if now is None else F.lit(now)))
