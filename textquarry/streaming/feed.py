"""Change feeds with Structured Streaming: debouncing by session windows, incremental refresh, progress."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changes(spark: SparkSession, folder: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    """New Parquet files of change events as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def debounced(events: DataFrame, gap: str = "2 seconds", *, late: str = "10 seconds", at: str = "ts", path: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, [keys,] paths, events): changes with no quiet gap between them are one session, with its sorted
    distinct paths. Works on streams, with a watermark for late events, and on tables alike."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    one = [] if keys else [(F.coalesce(F.length(path), F.lit(0)) * 0).alias("_one")]  # streams need a key besides the window
    found = source.groupBy(F.session_window(F.col(at), gap).alias("w"), *keys, *one).agg(F.array_sort(F.collect_set(path)).alias("paths"), F.count(F.lit(1)).alias("events"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "paths", "events")


def windowed(events: DataFrame, size: str, slide: str | None = None, *, late: str = "1 hour", at: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """(start, end, [keys,] events) in tumbling or sliding windows."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(F.col(at), size, slide) if slide else F.window(F.col(at), size)
    return source.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events")


def latest(events: DataFrame, key: str, at: str = "ts", tie: str | None = None) -> DataFrame:
    """The last event of each key: one aggregate, no sort."""
    order = F.struct(at, tie) if tie else F.col(at)
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("e")).select(key, "e.*")


def refreshing(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Runs refresh(batch, id) for each micro-batch, at most every so often; restarts go on from the checkpoint."""
    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def debounce_to_table(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, gap: str, *, at: str = "ts", path: str = "path", keys: tuple[str, ...] = ()) -> StreamingQuery:
    """A whole debouncing job over a folder, with what there is now; finished sessions are appended as Parquet."""
    stream = debounced(changes(spark, folder, schema), gap, at=at, path=path, keys=keys)
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """Stage and counts of a running operation."""
    last = query.lastProgress
    return {"id": str(query.id), "active": query.isActive, "status": query.status["message"], "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}


@dataclass
class Operation:
    """A run in the background: queued, running, completed or failed."""

    id: str
    kind: str
    path: str
    project: str
    status: str = "queued"
    stage: str = "queued"
    result: dict | None = None
    error: str | None = None
    started: float | None = None
    finished: float | None = None


class Operations:
    """Runs by id; a second start of the same kind for the same project and path joins the one under way."""

    def __init__(self, most: int = 128):
        self._lock, self._all, self._active, self._most = threading.Lock(), {}, {}, most
        self._threads: dict[str, threading.Thread] = {}

    def start(self, kind: str, path: str, project: str, work: Callable[[Callable[[str], None]], dict]) -> tuple[Operation, bool]:
        """The operation, and whether it was under way already. work is called with a function that names its stage."""
        key = (kind, project, path.replace("\\", "/").lower())
        with self._lock:
            if key in self._active:
                return self._active[key], True
            op = Operation(uuid.uuid4().hex[:12], kind, path, project)
            self._all[op.id] = self._active[key] = op
            for old in [o for o in self._all.values() if o.finished][: max(0, len(self._all) - self._most)]:
                del self._all[old.id]

        def run() -> None:
            op.status, op.started = "running", time.time()
            try:
                op.result = work(lambda stage: setattr(op, "stage", stage))
                op.status = op.stage = "completed"
            except Exception as e:  # told to whoever asks
                op.status, op.stage, op.error = "failed", "failed", str(e)
            finally:
                op.finished = time.time()
                with self._lock:
                    self._active.pop(key, None)

        self._threads[op.id] = threading.Thread(target=run, daemon=True)
        self._threads[op.id].start()
        return op, False

    def get(self, id: str) -> Operation | None:
        return self._all.get(id)

    def listed(self, active: bool = False, limit: int = 20) -> list[Operation]:
        """The newest first."""
        found = [o for o in reversed(list(self._all.values())) if not active or o.status in ("queued", "running")]
        return found[:limit]

    def wait(self, id: str, seconds: float | None = None) -> Operation | None:
        if id in self._threads:
            self._threads[id].join(seconds)
        return self.get(id)
