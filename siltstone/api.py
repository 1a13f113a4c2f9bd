"""One object for building, searching and looking after an index."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import fixed, globs, scalar, text
from siltstone.operators import chunking, embed, maintenance, observe, search
from siltstone.operators.index import SearchIndex
from siltstone.sources import files
from siltstone.sources.shared import Folder


class Engine:
    """An index in a folder: versions of the chunk table, a state file, a log of metrics, settings.

    ``embed_query`` turns a query into a vector; without it vectors are placeholders. Results are
    DataFrames; a plan is run only when the caller asks for rows.
    """

    #: Age from which a run noted as in progress counts as lost.
    STALE_SECONDS = 24 * 3600.0

    def __init__(self, spark: SparkSession, root: str, settings: dict | None = None, embed_query: Callable[[str], list[float]] | None = None, model: Callable[[], embed.Embedder] | None = None):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.settings = files.merge_settings(files.DEFAULTS, settings or {})
        self.state = files.StateFile(spark, f"{self.root}/state.json")
        self.failed: list[str] = []
        self._embed = embed_query or (lambda q: embed.placeholder_vector(q, self._get("embedding.dimensions")))
        self._plans: OrderedDict[tuple, DataFrame] = OrderedDict()
        self._store: SearchIndex | None = None
        self._tag = f"siltstone-{uuid.uuid4().hex}"
        saved = self.state.get("settings")
        if saved:
            self.settings = files.merge_settings(self.settings, saved)
        self.hits = self.misses = 0
        self.latencies: list[float] = []

    def _get(self, key: str):
        return files.get_setting(self.settings, key)

    @property
    def store(self) -> SearchIndex:
        """The index, for vectors of the length that is set now."""
        dim = self._get("embedding.dimensions")
        if self._store is None or self._store.dim != dim:
            self._store = SearchIndex(self.spark, f"{self.root}/index", dim)
        return self._store

    def _listing(self, folder: str) -> DataFrame:
        black, white = self.state.get("blacklist"), self.state.get("whitelist")
        return files.read_tree(self.spark, folder, self._get("indexing.include"), self._get("indexing.exclude"), self._get("indexing.max_file_size_kb"), blacklist=black, whitelist=white)

    def _allowed(self, path) -> object:
        """Whether a path of a change is indexed, by globs and lists."""
        return globs.should_index(path, self._get("indexing.include"), self._get("indexing.exclude"), self.state.get("blacklist"), self.state.get("whitelist"))

    # ---- building

    def chunk_rows(self, listing: DataFrame) -> DataFrame:
        """Chunks of files (path, text) in the table's schema. A path and a number make an id of 64 bits."""
        c, dim = self.settings["chunking"], self._get("embedding.dimensions")
        rows = listing.where(F.col("text").isNotNull()).select("path", "text", scalar.file_hash(F.col("text")).alias("file_hash"))
        named = chunking.chunk_files(rows, "path", "path", "text", c["max_tokens"], c["overlap_tokens"], self._get("embedding.context_limit"), keep=("file_hash",)).withColumnRenamed("path", "file_path")
        vec = embed.embed(named, "text", self.model, self._get("embedding.batch_size"), self._get("embedding.document_prefix"), self._get("embedding.context_limit"), dim) if self.model else embed.embed_placeholder(named, "text", dim)
        return vec.select(
            F.xxhash64("file_path", "chunk_index").alias("id"), "file_path", "chunk_index", F.col("text").alias("chunk_text"), "start_line", "end_line", F.col("vector").alias("embedding"), "file_hash",
            F.array_join(text.extract_identifiers(F.col("text")), " ").alias("identifiers"), F.current_timestamp().alias("updated_at"), F.col("vector").isNull().alias("vector_pending"),
        )

    def reindex(self, folder: str, confirm: bool = False) -> dict:
        """Build the index anew. The old version stays in place until the new one is complete.

        A run that is noted as in progress holds others back, but no longer than STALE_SECONDS: one that
        lost its driver can't take the note away.
        """
        if not confirm:
            return {"success": False, "message": "reindex replaces the index; call it with confirm=True"}
        began = time.time()
        if self.state.get("sync_status") == "in_progress" and began - float(self.state.get("sync_started_at") or 0) < self.STALE_SECONDS:
            return {"success": False, "message": "a run is in progress"}
        self.state.set(sync_status="in_progress", sync_started_at=began)
        self.spark.addTag(self._tag)
        try:
            version = self.store.write(self.chunk_rows(self._listing(folder)))
        except Exception as e:
            self.state.set(sync_status="error", sync_error=str(e)[:500])
            raise
        finally:
            self.spark.removeTag(self._tag)
        self._plans.clear()
        self.state.set(sync_status="idle", last_full_sync=time.time(), indexed_dimensions=self._get("embedding.dimensions"), indexed_model=self._get("embedding.model"))
        self._record("reindex_ms", (time.time() - began) * 1000)
        return {"success": True, "version": version} | self.status()["index"]

    def _record(self, name: str, value: float) -> None:
        files.append_metric(self.spark, f"{self.root}/metrics", name, value)

    def needs_reindex(self) -> bool:
        """Whether there is no index yet, or it was made with vectors of another length or by another model."""
        made = self.state.all()
        return not self.store.version() or made.get("indexed_dimensions") != self._get("embedding.dimensions") or made.get("indexed_model") != self._get("embedding.model")

    def apply_changes(self, listing: DataFrame, deleted: list[str] = ()) -> int:
        """Upsert the files of ``listing`` (path, text) that are allowed, small enough and not stored as they are; delete others by path.

        Writes a segment with the new chunks; the rest of the index stays as it is. Gives the version,
        which is the old one if nothing changed.
        """
        if not self.store.version():
            return self.store.write(self.chunk_rows(listing))
        files_ = listing.where(F.col("text").isNotNull() & self._allowed(F.col("path")) & (F.octet_length("text") / 1024.0 <= self._get("indexing.max_file_size_kb")))
        known = self.store.read().select(F.col("file_path").alias("path"), F.col("file_hash").alias("known")).distinct()
        new = files_.join(known, (files_["path"] == known["path"]) & (scalar.file_hash(files_["text"]) == known["known"]), "left_anti")
        rows = self.chunk_rows(new)
        gone = self.spark.createDataFrame([(p,) for p in deleted], "file_path string").unionByName(new.select(F.col("path").alias("file_path")))
        self._plans.clear()
        if not deleted and new.isEmpty():
            return self.store.version()
        return self.store.change(rows, gone)

    def apply_batch(self, batch: DataFrame, read: Callable[[DataFrame], DataFrame]) -> int:
        """Apply a batch of events (event_type, path): ``read`` turns added and changed paths (path) into (path, text); paths it can't read are deleted."""
        paths = batch.where(F.col("event_type") != "unlink").select("path").distinct()
        found = read(paths)
        gone = [r["path"] for r in batch.select("path").distinct().join(found.select("path"), "path", "left_anti").collect()]  # a batch is bounded (FLUSH_AT)
        return self.apply_changes(found, gone)

    def retry_pending(self) -> int:
        """Embed the chunks whose vector is still to be made once more; how many still are. What failed keeps its flag."""
        table = self.store.read()
        waiting = table.where(F.col("vector_pending"))
        paths = waiting.select("file_path").distinct()
        if self.model is None or waiting.isEmpty():
            return waiting.count()
        done = embed.embed(table.join(paths, "file_path", "left_semi"), "chunk_text", self.model, self._get("embedding.batch_size"), self._get("embedding.document_prefix"), self._get("embedding.context_limit"), self._get("embedding.dimensions"))
        keep = F.coalesce("vector", "embedding")
        rows = done.withColumn("embedding", keep).withColumn("vector_pending", F.col("embedding").isNull()).drop("vector")
        self._plans.clear()
        self.store.change(rows)
        left = self.store.read().where(F.col("vector_pending"))
        self.failed = [r[0] for r in left.select("file_path").distinct().orderBy("file_path").limit(10).collect()]
        return left.count()

    def collect_garbage(self, tracked: DataFrame) -> int:
        """Drop the chunks of files that are tracked no more (path)."""
        gone = maintenance.orphans(self.store.read(), tracked.select(F.col("path").alias("file_path")))
        self._plans.clear()
        return self.store.change(self.store.read().limit(0), gone)

    # ---- searching

    def search(self, query: str, top_k: int | None = None, threshold: float | None = None, path_prefix: str | None = None, no_hybrid: bool = False, literal: bool = False) -> tuple[str, DataFrame]:
        """(mode, results): literal, bm25-only, vector-only, hybrid, or bm25-fallback if the vectors don't fit."""
        top_k = top_k or self._get("search.top_k")
        threshold = self._get("search.similarity_threshold") if threshold is None else threshold
        options = {"query": query, "topK": top_k, "threshold": threshold, "pathPrefix": path_prefix, "noHybrid": no_hybrid, "literal": literal, "version": self.store.version()}
        key = (scalar.options_hash(options), *options.values())
        if key in self._plans:
            self.hits += 1
            self._plans.move_to_end(key)
            return self._plans[key]
        self.misses += 1
        began = time.time()
        index = self.store
        vector = None if literal or not self._get("embedding.enabled") else self._embed(self._get("embedding.query_prefix") + query)
        if literal:
            found = "literal", search.literal_search(index.read(), query, top_k, path_prefix)
        elif vector is None:
            found = "bm25-only", search.keyword_search(index, query, top_k, path_prefix)
        elif len(vector) != index.state()["dim"]:
            found = "bm25-fallback", search.keyword_search(index, query, top_k, path_prefix).withColumn("note", F.lit("vectors of another length; keyword search instead"))
        elif no_hybrid:
            found = "vector-only", search.vector_search_index(index, vector, top_k, threshold, path_prefix, exact=False)
        else:
            h = self._get("search.hybrid")
            fused = search.hybrid_search(index, query, vector, top_k, threshold, path_prefix, (h["weight_vector"], h["weight_bm25"], h["weight_rrf"]), h["identifier_boost"], exact=False)
            found = "hybrid", search.heuristic_rerank(fused, query)
        self._plans[key] = found
        if len(self._plans) > 200:
            self._plans.popitem(last=False)
        self.latencies.append((time.time() - began) * 1000)
        return found

    def similar(self, vector: list[float], top_k: int = 10, path_prefix: str | None = None) -> DataFrame:
        """(id, similarity, rank, ...): the chunks nearest to a vector, from the cells next to it."""
        return search.vector_search_index(self.store, vector, top_k, -1.0, path_prefix, exact=False)

    def grep(self, command: str) -> DataFrame | None:
        """Results in place of a grep command, or None if the index can't answer it."""
        row = self.spark.range(1).select(text.is_code_grep(F.lit(command)).alias("ok"), text.grep_pattern(F.lit(command)).alias("q")).first()
        if not row["ok"] or not row["q"]:
            return None
        mode, found = self.search(row["q"], 10, 0.01)
        return found.withColumn("chunk_text", F.substring("chunk_text", 1, 200)) if mode == "hybrid" else found

    # ---- looking after it

    def index_overview(self) -> tuple[dict, DataFrame]:
        """Statistics, and the indexed files in order."""
        return self.status()["index"], observe.indexed_files(self.store.read())

    def status(self) -> dict:
        index = observe.index_stats(self.store.read()).first().asDict() if self.store.version() else {"files": 0, "chunks": 0, "mean_chunks": 0.0}
        return {"state": self.state.all(), "index": index, "version": self.store.version(), "failed": self.failed}

    def performance(self, action: str = "summary"):
        """cache: hits and misses; metrics or summary: figures per metric; benchmark: seconds of a few searches; report: all of it with the index's figures."""
        self._flush_latencies()
        if action == "cache":
            return {"hits": self.hits, "misses": self.misses, "hit_rate": self.hits / max(1, self.hits + self.misses)}
        if action == "benchmark":
            out = {}
            for q in ("function", "class", "export", "interface"):
                began = time.time()
                self.search(q, 5)[1].collect()
                out[q] = time.time() - began
            return out
        if action == "report":
            return {"index": self.status()["index"], "store": self.store.stats(), "cache": self.performance("cache"), "metrics": [r.asDict() for r in self.performance("metrics").orderBy("name").collect()]}
        if not Folder(self.spark, self.root).exists("metrics"):
            return observe.metrics_summary(self.spark.createDataFrame([], "name string, value double, recorded_at timestamp"))
        return observe.metrics_summary(self.spark.read.parquet(f"{self.root}/metrics"))

    def _flush_latencies(self) -> None:
        """What planning of each search took; written together."""
        if self.latencies:
            rows = [("search_plan_ms", float(v)) for v in self.latencies]
            self.latencies.clear()
            self.spark.createDataFrame(rows, "name string, value double").withColumn("recorded_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/metrics")

    def config(self, action: str = "view", key: str | None = None, value=None):
        """view the settings or the one at a dotted key, set one, or reset all."""
        if action == "set":
            self.settings = files.set_setting(self.settings, key, value)
            self.state.set(settings=files.set_setting(self.state.get("settings") or {}, key, value))
        elif action == "reset":
            self.settings = files.DEFAULTS
            self.state.clear("settings")
        return files.get_setting(self.settings, key) if key else self.settings

    def blacklist(self, action: str = "list", entry: str | None = None, name: str = "blacklist") -> list[str]:
        """list, add or remove entries of the blacklist (or, by ``name``, the whitelist), sorted."""
        entries = set(self.state.get(name, fixed.BLACKLIST if name == "blacklist" else []))
        if action == "add":
            entries.add(entry)
        elif action == "remove":
            entries.discard(entry)
        if action != "list":
            self.state.set(**{name: sorted(entries)})
        return sorted(entries)

    def whitelist(self, action: str = "list", entry: str | None = None) -> list[str]:
        return self.blacklist(action, entry, "whitelist")

    def terminate(self) -> bool:
        """Cancel the jobs of this index's rebuild, none of others, and mark the run as ended; the last whole version stays."""
        running = self.state.get("sync_status") == "in_progress"
        self.spark.interruptTag(self._tag)
        if running:
            self.state.set(sync_status="idle")
        return running
