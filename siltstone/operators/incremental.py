"""Processing only new or changed files: manifest, anti-join, idempotent batch, commit.

Problem 3. The state store records, for each file and run, the hash that was processed.
Its committed part is the manifest; the listing of stored versions is anti-joined against
it. ``IncrementalRunner`` does the same for plain input files, with size and checksum,
and commits a batch only after its output is complete.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import Folder

_OLDEST = "0001-01-01 00:00:00"


def _field(value: Column, name: str) -> Column:
    """A field of an entry, whether JSON or ``name=value`` pairs, with or without quotes."""
    found = F.regexp_extract(value, rf'(?i)(?:^|[{{,;\s"]){name}"?\s*[:=]\s*"?([^",;}}\s]*)', 1)
    return F.when(found == "", None).otherwise(found)


def file_entries(sync_state: DataFrame) -> DataFrame:
    """Entries ``file:<path>`` as (file_path, run, state, file_hash); state and hash in lower case.

    Null keys, null values and entries without a run number give no row.
    """
    key, value = F.col("key"), F.col("value")
    return (
        sync_state.where(key.startswith("file:") & value.isNotNull())
        .select(
            F.expr("substring(key, 6)").alias("file_path"),
            F.regexp_extract(_field(value, "run"), r"^(\d{1,18})$", 1).alias("run"),
            F.lower(_field(value, "state")).alias("state"),
            F.lower(_field(value, "hash")).alias("file_hash"),
        )
        .where(F.col("run") != "")
        .withColumn("run", F.col("run").cast("long"))
    )


def undone_runs(sync_state: DataFrame) -> DataFrame:
    """Numbers of the runs with a ``rolled_back`` record, one row each."""
    return (
        sync_state.where(F.col("key").rlike(r"^run:\d{1,18}$"))
        .where(F.lower(_field(F.col("value"), "status")) == "rolled_back")
        .select(F.expr("substring(key, 5)").cast("long").alias("run"))
        .distinct()
    )


def committed_manifest(sync_state: DataFrame) -> DataFrame:
    """(file_path, file_hash) of the latest ``done`` entry whose run was not rolled back.

    The entries are reduced to one row per file before the shuffle. Of several hashes in
    the same latest run the greatest counts; an entry without a hash matches nothing.
    """
    done = file_entries(sync_state).where(F.col("state") == "done")
    kept = done.join(undone_runs(sync_state), "run", "left_anti")
    return kept.groupBy("file_path").agg(F.max(F.struct("run", "file_hash")).alias("last")).select("file_path", F.col("last.file_hash").alias("file_hash"))


def current_versions(chunks: DataFrame) -> DataFrame:
    """(file_path, file_hash) of each file's newest version.

    A null ``updated_at`` is older than any other. The reduction is partial before the
    shuffle, so a file with a third of all rows sends one row per task. Between two hashes
    with the same newest time the greater counts. Rows without a path give nothing.
    """
    seen = F.coalesce(F.col("updated_at"), F.lit(_OLDEST).cast("timestamp"))
    return (
        chunks.where(F.col("file_path").isNotNull())
        .select("file_path", F.struct(seen.alias("seen"), F.lower("file_hash").alias("file_hash")).alias("v"))
        .groupBy("file_path").agg(F.max("v").alias("v"))
        .select("file_path", F.col("v.file_hash").alias("file_hash"))
    )


def current_files(chunks: DataFrame) -> DataFrame:
    """(file_path, file_hash, size) of each file's newest version: size is the bytes of its chunks' texts, repeated ids once.

    Three sums, each partial before the shuffle and the first by id, so no task holds a file.
    """
    seen = F.coalesce(F.col("updated_at"), F.lit(_OLDEST).cast("timestamp"))
    rows = chunks.where(F.col("file_path").isNotNull()).select("file_path", F.lower("file_hash").alias("file_hash"), "id", seen.alias("seen"), F.coalesce(F.octet_length("chunk_text"), F.lit(0)).alias("bytes"))
    one = rows.groupBy("file_path", "file_hash", "id").agg(F.max("seen").alias("seen"), F.max("bytes").alias("bytes"))
    versions = one.groupBy("file_path", "file_hash").agg(F.max("seen").alias("seen"), F.sum("bytes").alias("size"))
    return versions.groupBy("file_path").agg(F.max(F.struct("seen", "file_hash", "size")).alias("v")).select("file_path", "v.file_hash", "v.size")


def unprocessed(listing: DataFrame, manifest: DataFrame, *content: str, path: str = "path") -> DataFrame:
    """Rows of ``listing`` whose path and content the manifest doesn't hold: an anti-join. Null contents equal each other."""
    a, m = listing.alias("a"), manifest.select(path, *content).distinct().alias("m")
    same = F.col(f"a.{path}") == F.col(f"m.{path}")
    for c in content:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"m.{c}"))
    return a.join(m, same, "left_anti")


def files_to_process(chunks: DataFrame, sync_state: DataFrame) -> DataFrame:
    """The files that the next run has to process, each once.

    A file is left out only if the manifest holds its current hash; a null hash equals
    nothing. With an empty manifest all files come out; with no chunks, none.
    """
    known = committed_manifest(sync_state).where(F.col("file_hash").isNotNull())
    return unprocessed(current_versions(chunks), known, "file_hash", path="file_path").select("file_path")


class IncrementalRunner:
    """Runs a transformation over new or changed inputs exactly once.

    ``root`` holds ``manifest/<batch>`` (the inputs of each committed batch: path, size, checksum and
    the number of the batch), ``note.json`` (the batch being worked on) and ``out/batch=<batch>``.
    Steps: stage the pending inputs and note the batch; write its output under its name, replacing
    whatever a broken-off try left; move the staged inputs into the manifest, which commits the
    batch; drop the note. A run that finds a note takes the same inputs and the same name again, so
    a failure neither skips nor repeats a record. An input is pending if its path is new or its
    content isn't that of the latest batch that had the path, so content that comes back is
    processed again. All work on data is distributed; the driver only moves folders, and a move
    that fails raises.
    """

    CONTENT = ("size", "checksum")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.at = spark, Folder(spark, root)
        self.at.make("manifest")

    @property
    def root(self) -> str:
        return self.at.root

    def _note(self) -> dict | None:
        found = self.at.read("note.json")
        return json.loads(found) if found else None

    def manifest(self) -> DataFrame:
        """(path, size, checksum, number): what each path held in the latest batch that had it."""
        schema = "path string, size long, checksum string, number long"
        if not self.at.names("manifest"):
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.at.path("manifest"))
        newest = Window.partitionBy("path").orderBy(F.desc("number"))  # a path has a row per batch that changed it
        return every.withColumn("_r", F.rank().over(newest)).where("_r = 1").drop("_r")

    def pending(self, listing: DataFrame) -> DataFrame:
        """Rows of ``listing`` (path, size, checksum, ...) that the manifest doesn't hold. Null paths are left out.

        Null contents equal each other, so a listing without checksums works by path and size.
        """
        return unprocessed(listing.where(F.col("path").isNotNull()), self.manifest(), *self.CONTENT)

    def _stage(self, inputs: DataFrame, name: str, number: int) -> dict | None:
        """Write the inputs of a batch down and note it; None if there are none."""
        staged = f"staged/{uuid.uuid4().hex}"
        inputs.select("path", *self.CONTENT).distinct().withColumn("number", F.lit(number).cast("long")).write.parquet(self.at.path(staged))
        if self.spark.read.parquet(self.at.path(staged)).isEmpty():
            self.at.delete(staged)
            return None
        note = {"batch": name, "staged": staged, "number": number}
        self.at.write("note.json", json.dumps(note))
        return note

    def run(self, listing: DataFrame, transform: Callable[[DataFrame], DataFrame], batch: str | None = None) -> str | None:
        """Process what is pending; the batch's name, or None if there was nothing.

        After a failure the noted batch is finished first and alone. Inputs of it that the listing no
        longer holds as they were are taken out of the batch: they are pending again when they come.
        """
        note = self._note()
        if note and self.at.exists(f"manifest/{note['batch']}"):  # committed, but the note stayed
            self.at.delete("note.json")
            note = None
        if note is None:
            name = batch or uuid.uuid4().hex
            if self.at.exists(f"manifest/{name}"):
                return name
            note = self._stage(self.pending(listing), name, len(self.at.names("manifest")) + 1)
        else:
            keys = self.spark.read.parquet(self.at.path(note["staged"]))
            there = unprocessed(keys, unprocessed(keys, listing, *self.CONTENT), *self.CONTENT)
            if there.count() < keys.count():
                before = note["staged"]
                note = self._stage(there, note["batch"], note["number"])
                self.at.delete(before)
                if note is None:
                    self.at.delete("note.json")
        if note is None:
            return None
        name, keys = note["batch"], self.spark.read.parquet(self.at.path(note["staged"]))
        a, k = listing.alias("a"), keys.alias("k")
        same = (F.col("a.path") == F.col("k.path")) & F.col("a.size").eqNullSafe(F.col("k.size")) & F.col("a.checksum").eqNullSafe(F.col("k.checksum"))
        transform(a.join(k, same, "left_semi")).write.mode("overwrite").parquet(self.at.path(f"out/batch={name}"))
        self.at.move(note["staged"], f"manifest/{name}")
        self.at.delete("note.json")
        return name

    def output(self) -> DataFrame:
        """The output of all committed batches."""
        return self.spark.read.option("basePath", self.at.path("out")).parquet(*(self.at.path(f"out/batch={p}") for p in self.at.names("manifest")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3 over all of ``chunks`` and ``sync_state``: the files to process next."""
    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet").select("file_path", "file_hash", "updated_at")
    return files_to_process(chunks, spark.read.parquet(f"{sf_dir}/sync_state.parquet"))


#: The committed hash of each file, and the hash of its newest version, in SQL.
MANIFEST_SQL = r"""
entries AS (
  SELECT substr(key, 6) AS file_path,
         CAST(regexp_extract(value, '(?i)run"?\s*[:=]\s*"?(\d+)', 1) AS BIGINT) AS run,
         lower(regexp_extract(value, '(?i)state"?\s*[:=]\s*"?(\w+)', 1)) AS state,
         lower(regexp_extract(value, '(?i)hash"?\s*[:=]\s*"?([0-9a-fA-F]+)', 1)) AS h
  FROM sync_state WHERE key LIKE 'file:%' AND regexp_matches(value, '(?i)run"?\s*[:=]\s*"?\d')),
undone AS (
  SELECT DISTINCT CAST(substr(key, 5) AS BIGINT) AS run FROM sync_state
  WHERE regexp_matches(key, '^run:\d+$') AND regexp_matches(value, '(?i)status"?\s*[:=]\s*"?rolled_back')),
manifest AS (
  SELECT file_path, h FROM (
    SELECT file_path, h, row_number() OVER (PARTITION BY file_path ORDER BY run DESC, h DESC) AS k
    FROM entries WHERE state = 'done' AND run NOT IN (SELECT run FROM undone)) WHERE k = 1),
cur AS (
  SELECT file_path, h FROM (
    SELECT file_path, lower(file_hash) AS h,
           row_number() OVER (PARTITION BY file_path ORDER BY updated_at DESC NULLS LAST, file_hash DESC NULLS LAST) AS k
    FROM chunks WHERE file_path IS NOT NULL) WHERE k = 1)
"""

P3_SQL = f"""
WITH {MANIFEST_SQL}
SELECT c.file_path FROM cur c
WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.file_path = c.file_path AND m.h = c.h)
"""
