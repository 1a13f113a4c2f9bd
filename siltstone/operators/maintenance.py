"""Keeping an index in step with its files: changes, upserts, deletes, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import scalar


def modified_since(events: DataFrame, since: str) -> DataFrame:
    """(path): files added or changed after a time, each once; null times and paths are left out."""
    return events.where(F.lower("event_type").isin("add", "change") & (F.col("ts") > F.lit(since).cast("timestamp")) & F.col("path").isNotNull()).select("path").distinct()


def union_files(committed: DataFrame, working: DataFrame, untracked: DataFrame) -> DataFrame:
    """Paths of the first two, each once, and all of the third, repeats included; further columns of theirs stay and count for what is once."""
    return committed.unionByName(working).distinct().unionByName(untracked)


def within_size(files: DataFrame, body: str, max_kb: float) -> DataFrame:
    """Files of at most ``max_kb`` kilobytes; null texts are left out."""
    return files.where(F.octet_length(body) / F.lit(1024.0) <= max_kb)


def orphans(indexed: DataFrame, tracked: DataFrame) -> DataFrame:
    """(file_path): indexed files that are tracked no more. The indexed paths are made distinct before the shuffle."""
    return indexed.select("file_path").where(F.col("file_path").isNotNull()).distinct().join(tracked.select("file_path").distinct(), "file_path", "left_anti")


def changed_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (file_path, file_hash) of ``now`` whose path and hash aren't stored together; a null hash equals nothing."""
    return now.join(stored.select("file_path", "file_hash").distinct(), ["file_path", "file_hash"], "left_anti").select("file_path", "file_hash")


def upsert_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the files of ``new`` replaced as a whole, so that no chunk of a longer old version stays.

    Both have the same columns, file_path among them. Stored rows are dropped by an anti-join
    on the new paths, which Spark broadcasts if they are few and shuffles otherwise.
    """
    paths = new.select("file_path").distinct()
    return stored.join(paths, "file_path", "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def delete_files(stored: DataFrame, paths: DataFrame) -> DataFrame:
    """The table without the chunks of the given files (file_path)."""
    return stored.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*stored.columns)


def plan_sync(events: DataFrame, now: DataFrame, stored: DataFrame, max_kb: float = 500.0) -> DataFrame:
    """(file_path, action): what a batch of changes asks for, one row per path.

    ``events`` has path, event_type and ts; ``now`` file_path, file_hash and size in bytes of the
    existing files as they are (``incremental.current_files``); ``stored`` file_path and file_hash of
    what was committed last (``incremental.committed_manifest``). The last event of a path counts; of
    equal times the type later in the alphabet. unlink or a missing file: delete. Larger than
    ``max_kb``: too_big. The stored hash: unchanged, a null hash never. Otherwise: upsert. One row
    per path in ``now`` and ``stored``; rows that repeat don't repeat the result.
    """
    last = events.where(F.col("path").isNotNull() & F.col("event_type").isNotNull()).groupBy("path").agg(F.max(F.struct("ts", "event_type")).alias("e")).select(F.col("path").alias("file_path"), F.col("e.event_type").alias("event_type"))
    files = now.select("file_path", F.col("file_hash").alias("new_hash"), "size", F.lit(True).alias("there")).distinct()
    old = stored.select("file_path", F.col("file_hash").alias("old_hash")).distinct()
    action = (
        F.when((F.col("event_type") == "unlink") | F.col("there").isNull(), "delete").when(F.col("size") / 1024.0 > max_kb, "too_big")
        .when(F.col("new_hash") == F.col("old_hash"), "unchanged").otherwise("upsert")
    )
    return last.join(files, "file_path", "left").join(old, "file_path", "left").select("file_path", action.alias("action"))


def diff_sync(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, action) between what exists and what is stored: reindex what is new or changed, delete orphans."""
    changed = changed_files(now, stored).select("file_path").distinct().withColumn("action", F.lit("reindex"))
    gone = orphans(stored, now).withColumn("action", F.lit("delete"))
    return changed.unionByName(gone)


def dimension_check(chunks: DataFrame, dim: int) -> DataFrame:
    """(size, vectors, matches): how many vectors have each length, null vectors left out."""
    return chunks.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("vectors")).withColumn("matches", F.col("size") == dim)


def pending_vectors(chunks: DataFrame) -> DataFrame:
    """(id) of the chunks whose vector is still to be made, each once."""
    return chunks.where(F.col("vector_pending")).select("id").distinct()


def file_rows(files: DataFrame, path: str, body: str) -> DataFrame:
    """(file_path, file_hash, size) of texts, as a listing for the functions above."""
    return files.select(F.col(path).alias("file_path"), scalar.file_hash(F.col(body)).alias("file_hash"), F.octet_length(body).cast("long").alias("size"))
