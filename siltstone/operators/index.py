"""A search index in a folder: chunks, keyword postings and vectors in segments.

A segment is written whole and then named in a small file, so readers see the old or the new
index. A change writes one segment with the new chunks of the changed files and the list of the
chunks that it replaces; nothing else is rewritten until ``compact``. Per segment:

* ``docs``: the chunks, by buckets of their ids, so that the few best hits are fetched from few files;
* ``postings``: (stem, term, id, dl, positions) by buckets of the stem, sorted: a query reads the
  buckets of its own stems, and of these the row groups with its terms;
* ``vectors``: (cell, id, file_path, v) by groups of the cells of a k-means partition, which is fitted
  once, on a bounded sample; an approximate search reads the cells next to the query;
* ``dead``: (seg, id) of the chunks of older segments that this one replaces.

Scores, ranks and ties are those of ``search``: rounded to six decimals, equal ones by id.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import scalar, text
from siltstone.session import ensure_checkpoint_dir, hashed_sample
from siltstone.sources.shared import Folder

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
DECIMALS = 6
#: Buckets of stems and of ids, and groups of cells; a layout of the files, no limit on what they hold.
BUCKETS = 32
CELL_PARTS = 64
#: Parts into which the postings of one bucket are written, so that a word of every chunk is no single task.
SALTS = 4
#: Vectors that the cells are fitted on, at most.
TRAIN_ROWS = 32768
#: Segments from which a change ends with ``compact``.
SEGMENTS = 8
CHUNK_COLUMNS = ("id", "file_path", "chunk_index", "chunk_text", "start_line", "end_line", "embedding", "file_hash", "identifiers", "updated_at", "vector_pending")

_DOCS = "bucket int, id long, file_path string, chunk_index int, chunk_text string, start_line int, end_line int, embedding array<float>, file_hash string, identifiers string, updated_at timestamp, vector_pending boolean"
_POSTINGS = "bucket int, stem string, term string, id long, dl int, positions array<int>"


def bucket_of(value: Column | str) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def bucket_number(value: str) -> int:
    """``bucket_of`` of one text, outside of a plan."""
    return ((xxhash.xxh64_intdigest(value.encode(), 42) + 2**63) % 2**64 - 2**63) % BUCKETS


def one_per_id(chunks: DataFrame, order: str = "updated_at") -> DataFrame:
    """One row of each id, the latest, of equally late ones the one with the greater path; null ids are left out."""
    rest = [c for c in chunks.columns if c != "id"]
    by = [F.col(c) for c in (order, "file_path") if c in rest]
    packed = F.max_by(F.struct(*rest), F.struct(*by)) if by else F.first(F.struct(*rest))
    return chunks.where(F.col("id").isNotNull()).groupBy("id").agg(packed.alias("_r")).select("id", *(F.col("_r").getField(c).alias(c) for c in rest))


def numbered_words(*texts: str) -> Column:
    """(term, place) of the words of several columns. Places go on through the columns with a gap between two, so that no phrase spans them."""
    def placed(words: Column, before: Column) -> Column:
        return F.transform(words, lambda w, i: F.struct(w.alias("term"), (i + before).cast("int").alias("place")))

    out, before = [], F.lit(0)
    for words in (text.index_tokens(F.col(c)) for c in texts):
        out.append(placed(words, before))
        before = before + F.size(words) + 1
    return F.concat(*out)


def _to_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stem = lru_cache(200_000)(text.porter_stem)
    for b in batches:
        words = b.column("w")
        flat = words.flatten()
        rows = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        term, place = flat.field("term").to_pandas(), flat.field("place").to_numpy(zero_copy_only=False)
        codes, names = pd.factorize(term)
        order = np.lexsort((place, codes, rows))
        rows, codes, place = rows[order], codes[order], place[order]
        first = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (np.diff(codes) != 0)))[: len(rows)] if len(rows) else np.zeros(0, np.int64)
        ids, dl = b.column("id").to_numpy(), np.bincount(rows, minlength=len(words)).astype(np.int32)
        stems = np.array([stem(t) for t in names], dtype=object)
        out = [
            pa.array(stems[codes[first]], pa.string()) if len(first) else pa.array([], pa.string()), pa.array(np.asarray(names, dtype=object)[codes[first]], pa.string()) if len(first) else pa.array([], pa.string()),
            pa.array(ids[rows[first]]), pa.array(dl[rows[first]]), pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(place.astype(np.int32))),
        ]
        yield pa.RecordBatch.from_arrays(out, names=["stem", "term", "id", "dl", "positions"])


def positions_of(chunks: DataFrame) -> DataFrame:
    """(stem, term, id, dl, positions): the inverted index of chunks with one row per id. Null and empty texts have no word."""
    rows = chunks.select("id", numbered_words("file_path", "chunk_text", "identifiers").alias("w")).where(F.size("w") > 0)
    return rows.mapInArrow(_to_postings, "stem string, term string, id long, dl int, positions array<int>")


# ---- vectors

def fit_cells(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of a k-means partition of unit vectors by cosine; a centre that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))].copy()
    for _ in range(rounds):
        mine = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres.astype(np.float32)


def _units(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float32).reshape(-1, dim).astype(np.float64) if parts else np.zeros((0, dim))


def default_probes(cells: int) -> int:
    """Cells that a search looks into unless told otherwise: their number to the power 0.7."""
    return max(4, round(cells**0.7))


class SearchIndex:
    """An index in a folder; see the module. ``dim``: length of the vectors that take part."""

    def __init__(self, spark: SparkSession, root: str, dim: int):
        self.spark, self.dim = spark, dim
        self.at = Folder(spark, root)
        self.at.make()
        self._open: tuple[int, dict] | None = None
        self._frames: dict = {}

    # ---- versions

    def version(self) -> int:
        """Number of the current version, 0 if there is none."""
        return max((int(n.split(".")[1]) for n in self.at.names() if n.startswith("CURRENT.")), default=0)

    def state(self, version: int | None = None) -> dict:
        """segments, docs (live chunks with a word), words, dim, and the segment with the cells, of a version."""
        v = version or self.version()
        if not v:
            raise FileNotFoundError(f"no index in {self.at.root}")
        if self._open is None or self._open[0] != v:
            self._open, self._frames = (v, json.loads(self.at.read(f"CURRENT.{v}"))), {}
        return self._open[1]

    def _commit(self, state: dict) -> int:
        v = self.version() + 1
        self.at.write(f"CURRENT.{v}", json.dumps(state))
        return v

    def stats(self) -> dict:
        """Version, segments, live chunks with a word, words, cells and length of the vectors."""
        state = self.state()
        return {"version": self.version(), "segments": len(state["segments"]), "docs": state["docs"], "words": state["words"], "cells": len(self.centres()), "dim": state["dim"]}

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, and the segments that only they used."""
        now = self.version()
        states = [json.loads(t) for v in range(max(1, now - keep + 1), now + 1) if (t := self.at.read(f"CURRENT.{v}"))]
        kept = {s for state in states for s in (*state["segments"], state["cells"])}
        for v in range(1, now - keep + 1):
            self.at.delete(f"CURRENT.{v}")
        for s in self.at.names("segments"):
            if int(s) not in kept:
                self.at.delete(f"segments/{s}")

    # ---- reading

    def _read(self, what: str, schema: str) -> DataFrame:
        """A table of all segments with their number; of each version once, so that files are listed once."""
        segments = tuple(self.state()["segments"])
        if what not in self._frames:
            parts = [self.spark.read.schema(schema).parquet(self.at.path(f"segments/{s}/{what}")).withColumn("seg", F.lit(s)) for s in segments]
            self._frames[what] = reduce(DataFrame.unionByName, parts)
        return self._frames[what]

    def _live(self, rows: DataFrame) -> DataFrame:
        """Without the chunks that a later segment replaces."""
        if len(self.state()["segments"]) == 1:
            return rows
        return rows.join(self._read("dead", "of int, id long").select(F.col("of").alias("seg"), "id").distinct(), ["seg", "id"], "left_anti")

    def _docs(self) -> DataFrame:
        return self._read("docs", _DOCS)

    def read(self) -> DataFrame:
        """The chunks of the current version."""
        return self._live(self._docs()).select(*CHUNK_COLUMNS)

    def postings(self) -> DataFrame:
        """(stem, term, id, tf, dl, positions) of the current version."""
        return self._live(self._read("postings", _POSTINGS)).select("stem", "term", "id", F.size("positions").alias("tf"), "dl", "positions")

    def fetch(self, keys: DataFrame, *columns: str) -> DataFrame:
        """``keys`` (a top-k list with seg and id) with columns of their chunks. The short list is broadcast and tells the scan which buckets to read."""
        short = F.broadcast(keys.withColumn("bucket", bucket_of("id")))
        return self._docs().select("seg", "bucket", "id", *columns).join(short, ["seg", "bucket", "id"]).drop("bucket")

    # ---- writing

    def _train(self, chunks: DataFrame, seg: int) -> None:
        """Fit the cells on at most TRAIN_ROWS vectors, chosen by the hash of their ids, about the root of all vectors in number."""
        good = chunks.where(scalar.usable_vector(F.col("embedding"), self.dim)).select("id", "embedding")
        total = good.count()
        n = int(2 ** round(math.log2(max(1.0, math.sqrt(total)))))
        sample = hashed_sample(good, "id", TRAIN_ROWS, total).select("embedding").toArrow().column(0).combine_chunks()
        x = sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, self.dim)
        centres = fit_cells(_units(x), n) if len(x) else np.eye(1, self.dim, dtype=np.float32)
        rows = [(i, c.tolist()) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "cell int, centre array<float>").coalesce(1).write.mode("overwrite").parquet(self.at.path(f"segments/{seg}/centres"))

    def centres(self, seg: int | None = None) -> np.ndarray:
        """The centres of the cells, about the root of the number of vectors when they were fitted."""
        seg = seg or self.state()["cells"]
        if ("centres", seg) not in self._frames:
            rows = self.spark.read.parquet(self.at.path(f"segments/{seg}/centres")).orderBy("cell").toArrow().column("centre").combine_chunks()
            self._frames["centres", seg] = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        return self._frames["centres", seg]

    def _vectors_of(self, docs: DataFrame, cells: int) -> DataFrame:
        centres, dim = self.centres(cells), self.dim

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                cell = (_units(raw.astype(np.float64)) @ centres.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell % CELL_PARTS), pa.array(cell), b.column("id"), b.column("file_path"), pa.array([v.tobytes() for v in raw], pa.binary())], names=["part", "cell", "id", "file_path", "v"])

        good = docs.where(scalar.usable_vector(F.col("embedding"), dim)).select("id", "file_path", "embedding")
        return good.mapInArrow(place, "part int, cell int, id long, file_path string, v binary")

    def _write_segment(self, chunks: DataFrame, seg: int, cells: int) -> tuple[int, int]:
        """Write the tables of a segment with the cells of segment ``cells``; (chunks with a word, their words)."""
        docs, postings, vectors = (self.at.path(f"segments/{seg}/{t}") for t in ("docs", "postings", "vectors"))
        types = dict(part.split(" ", 1) for part in _DOCS.split(", "))
        have = [(F.col(c) if c in chunks.columns else F.lit(None)).cast(types[c]).alias(c) for c in CHUNK_COLUMNS]
        rows = one_per_id(chunks.select(*have)).withColumn("bucket", bucket_of("id"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(docs)
        rows = self.spark.read.schema(_DOCS).parquet(docs)
        post = positions_of(rows).withColumn("bucket", bucket_of("stem")).withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int"))
        post.repartition("bucket", "salt").sortWithinPartitions("bucket", "stem", "term", "id").drop("salt").write.mode("overwrite").partitionBy("bucket").parquet(postings)
        if cells == seg:
            self._train(rows, seg)
        self._vectors_of(rows, cells).repartition("part").sortWithinPartitions("part", "cell").write.mode("overwrite").partitionBy("part").parquet(vectors)
        size = self._sizes(rows)
        return int(size["docs"]), int(size["words"] or 0)

    @staticmethod
    def _sizes(rows: DataFrame):
        dl = sum((F.size(text.index_tokens(F.col(c))) for c in ("file_path", "chunk_text", "identifiers")), F.lit(0))
        return rows.select(dl.alias("dl")).where("dl > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("dl").alias("words")).first()

    def write(self, chunks: DataFrame, refit: bool = True) -> int:
        """Build the index anew from chunks; rows that repeat an id count once."""
        seg = max((int(s) for s in self.at.names("segments")), default=0) + 1
        cells = seg if refit else self.state()["cells"]
        docs, words = self._write_segment(chunks, seg, cells)
        self.spark.createDataFrame([], "of int, id long").write.mode("overwrite").parquet(self.at.path(f"segments/{seg}/dead"))
        return self._commit({"segments": [seg], "docs": docs, "words": words, "dim": self.dim, "cells": cells})

    def change(self, new: DataFrame, gone: DataFrame | None = None) -> int:
        """Put the chunks of ``new`` in place of all chunks of their files, and drop the files of ``gone`` (file_path).

        Reads paths and ids of the index and the words of what is dropped; writes what is new.
        """
        state = self.state()
        seg = max(int(s) for s in self.at.names("segments")) + 1
        docs, words = self._write_segment(new, seg, state["cells"])
        paths = self.spark.read.schema(_DOCS).parquet(self.at.path(f"segments/{seg}/docs")).select("file_path")  # as written, so that ``new`` is computed once
        paths = (paths if gone is None else paths.unionByName(gone.select("file_path"))).distinct()
        old = self._live(self._docs()).join(paths, "file_path", "left_semi")
        old.select(F.col("seg").alias("of"), "id").write.mode("overwrite").parquet(self.at.path(f"segments/{seg}/dead"))
        lost = self._sizes(old)
        now = {**state, "segments": [*state["segments"], seg], "docs": state["docs"] + docs - int(lost["docs"]), "words": state["words"] + words - int(lost["words"] or 0)}
        version = self._commit(now)
        return self.compact() if len(now["segments"]) > SEGMENTS else version

    def compact(self) -> int:
        """One segment in place of all."""
        return self.write(self.read(), refit=False)

    def clear(self) -> int:
        """A new version without rows."""
        return self.write(self.read().limit(0))

    # ---- searching

    def _best(self, scored: DataFrame, k: int) -> DataFrame:
        top = scored.orderBy(F.desc("similarity"), "id").limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))

    def knn(self, query: list[float], k: int, path_prefix: str | None = None, probes: int | None = None, exact: bool = True) -> DataFrame:
        """(seg, id, similarity, rank): the k chunks of greatest cosine with ``query``.

        ``exact`` scans all vectors; otherwise those of the ``probes`` cells nearest to the query.
        Either way a task keeps the k best of its rows, and only these are sorted.
        """
        q = np.asarray(query, np.float64)
        rows, dim = self._read("vectors", "part int, cell int, id long, file_path string, v binary"), self.dim
        if len(q) != dim or not np.isfinite(q).all() or not q.any():
            return rows.select("seg", "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
        q = q / np.linalg.norm(q)
        if not exact:
            centres = self.centres()
            near = np.argsort(-(centres @ q), kind="stable")[: probes or default_probes(len(centres))].tolist()
            rows = rows.where(F.col("part").isin(sorted({c % CELL_PARTS for c in near})) & F.col("cell").isin(near))
        if path_prefix is not None:
            rows = rows.where(F.col("file_path").startswith(path_prefix))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seg, ids, score = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)
            for b in batches:
                x = _matrix(b.column("v"), dim)
                s = np.round((x @ q) / np.linalg.norm(x, axis=1), DECIMALS)
                seg, ids, score = np.append(seg, b.column("seg").to_numpy()), np.append(ids, b.column("id").to_numpy()), np.append(score, s)
                keep = np.lexsort((ids, -score))[:k]
                seg, ids, score = seg[keep], ids[keep], score[keep]
            yield pa.RecordBatch.from_arrays([pa.array(seg.astype(np.int32)), pa.array(ids), pa.array(score)], names=["seg", "id", "similarity"])

        return self._best(self._live(rows.select("seg", "id", "v")).mapInArrow(best, "seg int, id long, similarity double"), k)

    def bm25(self, query: str, k: int, path_prefix: str | None = None, stemmed: bool = True) -> DataFrame:
        """(seg, id, similarity, rank): the k best chunks for any of the query's phrases.

        BM25 with k1 = 1.2, b = 0.75 over path, text and identifiers, idf floored at 1e-6; phrases of
        stems (Porter), or of the words as they stand. Counts and lengths of all chunks go into the
        statistics whatever the prefix. Chunks without a phrase are no hits; a query without words
        finds nothing. Reads the postings of the query's own words.
        """
        phrases = [w for p in text.query_phrases(query) if (w := text.phrase_words(p))]
        return self._phrases([[text.porter_stem(w) for w in p] if stemmed else p for p in phrases], k, path_prefix, "stem" if stemmed else "term")

    def prefix_bm25(self, query: str, k: int, path_prefix: str | None = None) -> DataFrame:
        """(seg, id, similarity, rank) for words that begin like the query's: all of up to six words, any of more. For queries that expand to nothing."""
        words = [w.lower() for w in re.split(r"[^\w]+", text.prefix_query(query).replace(" AND ", " ").replace(" OR ", " ")) if w]
        rows = self._read("postings", _POSTINGS)
        if not words:
            return rows.select("seg", "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
        groups = [F.col("term").startswith(w) | F.col("stem").startswith(w) for w in words]
        hits = self._live(rows.where(reduce(lambda a, b: a | b, groups)))
        counted = self._by_chunk(hits, F.max("dl").alias("dl"), *(F.coalesce(F.sum(F.when(g, F.size("positions"))), F.lit(0)).cast("double").alias(f"tf{i}") for i, g in enumerate(groups)))
        if len(words) <= 6:
            counted = counted.where(reduce(lambda a, b: a & b, (F.col(f"tf{i}") > 0 for i in range(len(words)))))
        return self._scored(counted, len(words), k, path_prefix)

    def _phrases(self, phrases: list[list[str]], k: int, path_prefix: str | None, column: str) -> DataFrame:
        phrases = [list(p) for p in dict.fromkeys(map(tuple, phrases))]
        rows = self._read("postings", _POSTINGS)
        if not phrases:
            return rows.select("seg", "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
        words = list(dict.fromkeys(w for p in phrases for w in p))
        stems = sorted({text.porter_stem(w) if column == "term" else w for w in words})
        buckets = sorted({bucket_number(s) for s in stems})
        hits = rows.where(F.col("bucket").isin(buckets) & F.col("stem").isin(stems))
        hits = self._live(hits if column == "stem" else hits.where(F.col("term").isin(words)))
        # how often each word stands in a chunk and, of words of longer phrases, where: a chunk's own words, so no list is longer than its text
        at = {w: i for i, w in enumerate(words)}
        inner = {w for p in phrases if len(p) > 1 for w in p}
        is_ = {w: f"{column} = '{w}'" for w in words}  # words hold letters and digits only
        counts = [F.expr(f"coalesce(sum(CASE WHEN {is_[w]} THEN size(positions) END), 0) AS n{i}") for w, i in at.items()]
        places = [F.expr(f"flatten(collect_list(CASE WHEN {is_[w]} THEN positions END)) AS w{at[w]}") for w in words if w in inner]
        found = self._by_chunk(hits, F.max("dl").alias("dl"), *counts, *places)

        def count(p: list[str]) -> str:
            if len(p) == 1:
                return f"n{at[p[0]]}"
            return "size(" + reduce(lambda a, b: f"array_intersect({a}, {b})", (f"transform(w{at[w]}, x -> x - {i})" for i, w in enumerate(p))) + ")"

        counted = found.select("seg", "id", "dl", *(F.expr(f"cast({count(p)} AS double) AS tf{i}") for i, p in enumerate(phrases)))
        return self._scored(counted, len(phrases), k, path_prefix)

    def _by_chunk(self, hits: DataFrame, *figures: Column) -> DataFrame:
        """Figures of each chunk (seg, id). With one segment its number is no key: a constant key would keep two readers from sharing the shuffle."""
        segments = self.state()["segments"]
        if len(segments) > 1:
            return hits.groupBy("seg", "id").agg(*figures)
        return hits.groupBy("id").agg(*figures).withColumn("seg", F.lit(segments[0]))

    def _scored(self, counted: DataFrame, n: int, k: int, path_prefix: str | None) -> DataFrame:
        state = self.state()
        docs, mean = float(state["docs"]), state["words"] / max(1, state["docs"]) or 1.0
        # dl is asked for here too, so that statistics and scores can read one shuffle of the hits (Spark shares it unless there are lists of places)
        df = counted.agg(F.expr("array(" + ", ".join(f"count_if(tf{i} > 0 AND dl IS NOT NULL)" for i in range(n)) + ") AS df")).select("df").scalar()
        rows = counted.where(" OR ".join(f"tf{i} > 0" for i in range(n))).withColumn("df", df)
        part = "greatest(ln(({docs!r}D - df[{i}] + 0.5D) / (df[{i}] + 0.5D)), {least!r}D) * tf{i} * {k1!r}D / (tf{i} + {K1!r}D * ({rest!r}D + {B!r}D * dl / {mean!r}D))"
        total = " + ".join(part.format(i=i, docs=docs, mean=mean, least=LEAST_IDF, k1=K1 + 1, K1=K1, B=B, rest=1 - B) for i in range(n))
        if path_prefix is not None:
            rows = rows.join(self._docs().where(F.col("file_path").startswith(path_prefix)).select("seg", "id"), ["seg", "id"], "left_semi")
        scored = rows.select("seg", "id", F.round(F.expr(total), DECIMALS).alias("similarity"))
        return self._best(scored, k)


_opened: dict[tuple[str, str], SearchIndex] = {}


def index_of(spark: SparkSession, table: str, dim: int) -> SearchIndex:
    """The index of a Parquet table of chunks, kept in the shared checkpoint folder under a stamp of the table's files and built if it isn't there yet.

    It is built under another name and then moved, so of two that build it at the same time one is taken.
    """
    import hashlib
    import uuid

    stamp = hashlib.sha256(json.dumps([table, dim, Folder(spark, table).stamp()]).encode()).hexdigest()[:24]
    kept = Folder(spark, f"{ensure_checkpoint_dir(spark)}/index")
    key = (spark.sparkContext.applicationId, kept.path(stamp))
    if key not in _opened:
        if not kept.exists(stamp):
            made = f"{stamp}-{uuid.uuid4().hex}"
            SearchIndex(spark, kept.path(made), dim).write(spark.read.parquet(table))
            try:
                kept.move(made, stamp)
            except OSError:
                kept.delete(made)
                if not kept.exists(stamp):
                    raise
        _opened[key] = SearchIndex(spark, kept.path(stamp), dim)
    return _opened[key]
