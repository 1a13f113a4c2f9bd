"""File events: cleaning, bursts, batches, and applying them to the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import Folder

GAP = "500 milliseconds"
#: Waiting events at which a batch is closed early.
FLUSH_AT = 500
#: Order in which the types of a batch are handed on.
ORDER = {"add": 0, "change": 1, "unlink": 2}
EVENT_SCHEMA = "event_type string, path string, ts timestamp"


def normal_path(path: Column, root: str | None = None) -> Column:
    """Relative to ``root``, without a leading './', with forward slashes."""
    p = F.regexp_replace(path, r"\\", "/")
    if root:
        r = root.rstrip("/") + "/"
        p = F.when(p.startswith(r), F.substring(p, len(r) + 1, 2147483647)).otherwise(p)
    return F.regexp_replace(p, r"^(?:\./)+", "")


def clean_events(events: DataFrame, root: str | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(event_type, path, ts) with normal paths and known types in lower case, the rest dropped; ``keep`` filters paths."""
    out = events.select(F.lower(F.trim("event_type")).alias("event_type"), normal_path(F.col("path"), root).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    out = out.where(F.col("event_type").isin(*ORDER) & F.col("path").isNotNull() & (F.col("path") != "") & F.col("ts").isNotNull())
    return out.where(keep(F.col("path"))) if keep else out


def bursts(events: DataFrame, gap: str = GAP) -> DataFrame:
    """(path, started, ended, events, event_types): runs of a path's events closer together than ``gap``, for a batch or a stream.

    A session window merges partially before the shuffle. On a stream give ``events`` a watermark.
    """
    w = F.session_window("ts", gap)
    g = events.groupBy("path", w).agg(F.count(F.lit(1)).alias("events"), F.array_sort(F.collect_set("event_type")).alias("event_types"))
    return g.select("path", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events", "event_types")


def debounced_batches(events: DataFrame, gap_seconds: float = 0.5) -> DataFrame:
    """(batch, event_type, path): batches of all paths' events, closed when nothing has come for the gap; each pair once per batch.

    The batch is the time of its first event. The gaps of the whole log need one order: the
    events are first reduced to the distinct times per range of time, and only the ends of
    ranges are compared across ranges.
    """
    times = events.select(F.unix_micros("ts").alias("t")).distinct()
    width = 3600 * 1_000_000
    gap = F.lit(int(gap_seconds * 1_000_000))
    ranged = times.withColumn("r", F.floor(F.col("t") / width))
    inside = Window.partitionBy("r").orderBy("t")
    edges = ranged.groupBy("r").agg(F.max("t").alias("last"))
    before = edges.select("r", F.lag("last").over(Window.orderBy("r")).alias("before"))  # a row per hour of the log
    marked = ranged.join(before, "r").withColumn("prev", F.coalesce(F.lag("t").over(inside), F.col("before")))
    starts = marked.where(F.col("prev").isNull() | (F.col("t") - F.col("prev") > gap)).select("r", F.col("t").alias("s"))
    last_start = starts.groupBy("r").agg(F.max("s").alias("m"))
    carried = edges.select("r").join(last_start, "r", "left").select("r", F.last("m", ignorenulls=True).over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    labelled = ranged.join(carried, "r").join(starts.withColumnRenamed("s", "t").withColumn("s", F.col("t")), ["r", "t"], "left")
    batch = F.coalesce(F.last("s", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("carry"))
    of_time = labelled.select("t", batch.alias("b"))
    return events.withColumn("t", F.unix_micros("ts")).join(of_time, "t").select(F.timestamp_micros("b").alias("batch"), "event_type", "path").distinct()


def in_order(batch: DataFrame) -> DataFrame:
    """Distinct events of a batch, added files first, then changed, then removed ones."""
    place = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))
    return batch.select("event_type", "path").distinct().orderBy(F.element_at(place, F.col("event_type")), "path")


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of events from Parquet files that appear in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_bursts(events: DataFrame, gap: str = GAP, late: str = "10 minutes") -> DataFrame:
    """Bursts of a stream, given out once the watermark has passed them; later events are dropped."""
    return bursts(events.withWatermark("ts", late), gap)


def flush_by_count(events: DataFrame, at: int = FLUSH_AT, gap_ms: int = 500) -> DataFrame:
    """(group, batch, event_type, path): the events of each group in batches, closed at ``at`` events or after ``gap_ms`` without one.

    ``events`` is a stream with a column ``group`` (for instance a hash of the folder, so that
    groups spread over tasks), event_type and path. An event is waiting once per type and path. A batch comes out whole, added files
    first, then changed, then removed ones. State is the waiting events, fewer than ``at``, and the batch's number.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, types, paths = state.get if state.exists else (0, [], [])
        waiting = dict.fromkeys(zip(types, paths))
        out = []

        def flush() -> None:
            nonlocal count
            out.extend((key[0], count, t, p) for t, p in sorted(waiting, key=lambda e: (ORDER.get(e[0], len(ORDER)), e[1])))
            count += 1
            waiting.clear()

        if state.hasTimedOut:
            if waiting:
                flush()
        else:
            for pdf in batches:
                for event in zip(pdf["event_type"], pdf["path"]):
                    if event[1] is not None:
                        waiting[event] = None
                        if len(waiting) >= at:
                            flush()
        state.update((count, [t for t, _ in waiting], [p for _, p in waiting]))
        if waiting:
            state.setTimeoutDuration(gap_ms)
        yield pd.DataFrame(out, columns=["group", "batch", "event_type", "path"])

    return events.groupBy("group").applyInPandasWithState(
        step, "group long, batch long, event_type string, path string", "count long, types array<string>, paths array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def listing_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """(event_type, path, ts): what happened between two listings (path, size, modified_at): add, change, unlink.

    One row per path in each; null paths are left out. A removed file's time is that of the comparison.
    """
    a = before.where(F.col("path").isNotNull()).select("path", F.struct("size", "modified_at").alias("a"))
    b = now.where(F.col("path").isNotNull()).select("path", F.struct("size", "modified_at").alias("b"))
    kind = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "unlink").when(~F.col("a").eqNullSafe(F.col("b")), "change")
    both = a.join(b, "path", "full_outer").select(kind.alias("event_type"), "path", F.coalesce(F.col("b.modified_at"), F.current_timestamp()).alias("ts"))
    return both.where(F.col("event_type").isNotNull())


class Watcher:
    """Watches a tree by listing it again: each ``poll`` writes what changed as a file of events for ``read_events``.

    ``listing()`` gives (path, size, modified_at) of the files that count. The last listing is kept in
    ``folder`` and replaced after the events are written, so a poll that broke off tells its events again
    rather than never. The first poll only takes the listing down.
    """

    def __init__(self, spark: SparkSession, folder: str, listing: Callable[[], DataFrame]):
        self.spark, self.at, self.listing = spark, Folder(spark, folder), listing
        self.at.make("events")
        self.counts: dict[str, int] = dict.fromkeys(ORDER, 0)

    @property
    def events(self) -> str:
        """The folder that ``read_events`` reads."""
        return self.at.path("events")

    def poll(self) -> dict[str, int]:
        """Events of each type since the last poll."""
        last = max((int(n) for n in self.at.names("listings")), default=0)
        self.listing().select("path", "size", "modified_at").write.mode("overwrite").parquet(self.at.path(f"listings/{last + 1}"))
        found = dict.fromkeys(ORDER, 0)
        if last:
            of = lambda n: self.spark.read.parquet(self.at.path(f"listings/{n}"))
            changed = listing_events(of(last), of(last + 1))
            changed.coalesce(1).write.mode("append").parquet(self.events)
            found |= {r["event_type"]: r["n"] for r in changed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
            self.at.delete(f"listings/{last}")
        self.counts = {t: self.counts[t] + n for t, n in found.items()}
        return found


def progress(done: int, total: int, width: int = 10) -> tuple[int, str]:
    """(percent, bar): how much is done, as a number and as a bar of ``width`` characters. Nothing to do is all done."""
    percent = round(100 * done / total) if total > 0 else 100
    filled = round(width * percent / 100)
    return percent, "=" * filled + (">" + " " * (width - filled - 1) if filled < width else "")


def progress_listener(spark: SparkSession, tell: Callable[[dict], None]):
    """Calls ``tell`` with phase, batch and rows at the start, after each batch and at the end of the session's streams.

    Gives the listener, for ``spark.streams.removeListener``.
    """
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            tell({"phase": "started", "query": str(event.id)})

        def onQueryProgress(self, event):
            p = event.progress
            tell({"phase": "batch", "query": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            tell({"phase": "error" if event.exception else "done", "query": str(event.id)})

    listener = Listener()
    spark.streams.addListener(listener)
    return listener


def apply_batches(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a query that hands each micro-batch, distinct and in order, to ``apply(batch, id)``.

    A batch that failed comes again with the same id, so ``apply`` should write by it.
    """
    writer = events.writeStream.foreachBatch(lambda df, i: apply(in_order(df), i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
