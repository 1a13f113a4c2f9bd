"""Problem 6: the k most similar vectors of every vector.

Index: unit vectors are assigned to cells of a k-means partition; what is left of a vector
after its cell's centre is coded in four bits per two dimensions. The code minimises the
score-aware loss |e|^2 + (eta - 1) (e . x)^2 of the error e: error parallel to the vector x
changes large inner products most and costs eta times as much. Search: a query probes the
cells whose centres are nearest, scans the codes there through the query's tables, and the
best of each block are ranked again by exact cosine.

The table of a query holds its products with the sixteen codewords of each subspace, and a
code's score is a sum of table entries. Summing entries of tables that are themselves products
is the product with the decoded vector, so a block of queries and a block of codes take one
matrix product instead of millions of look-ups; the codes stay at four bits until then.

Copies of a vector (equal direction to four decimals) are one member of the index. Of the
copies only the k + 1 smallest ids can be anyone's neighbours, since equal scores are ordered
by id; so a group of copies of any size costs one vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import hashed_sample

DIM = 64
#: Vectors that the partition and the codebooks are fitted on: TRAIN_ROWS or, of more than 16 million vectors, eight for each cell, at most MOST_TRAIN.
TRAIN_ROWS, PER_CELL, MOST_TRAIN = 32768, 8, 262144
SUB = 2
WORDS = 16
#: Score from which parallel error counts (the threshold T of the score-aware weight).
SCORE_T = 0.5
#: Vectors or queries of one cell that are handled together, at most.
BLOCK = 4096
#: Pairs of blocks that a task scans, on average.
TASK_BLOCKS = 4
#: Candidates of a block that are ranked exactly, as a multiple of k.
RERANK = 6
#: Slack between the coded and the exact cosine when a least cosine is asked for.
SLACK = 0.15


def eta(dim: int = DIM, t: float = SCORE_T) -> float:
    """Weight of parallel against orthogonal error for scores above ``t``."""
    return (dim - 1) * t * t / (1 - t * t)


@dataclass
class Index:
    centres: np.ndarray  # (cells, dim)
    books: np.ndarray  # (subspaces, 16, 2)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """(n, subspaces / 2) bytes to (n, dim) vectors."""
        both = np.empty((len(codes), codes.shape[1] * 2), dtype=np.uint8)
        both[:, 0::2], both[:, 1::2] = codes >> 4, codes & 15
        return self.books[np.arange(both.shape[1])[None, :], both].reshape(len(codes), -1)


def _kmeans(x: np.ndarray, cells: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; empty cells take points that are farthest from their centres."""
    centres = x[rng.choice(len(x), cells, replace=len(x) < cells)].copy()
    for _ in range(rounds):
        best, score = nearest(x, centres, 1)
        order = np.argsort(best[:, 0], kind="stable")
        sums = np.zeros_like(centres)
        np.add.at(sums, best[order, 0], x[order])
        count = np.bincount(best[:, 0], minlength=cells)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            sums[empty] = x[np.argsort(score[:, 0])[: len(empty)]][: len(empty)] if len(x) >= len(empty) else x[rng.choice(len(x), len(empty))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``probes`` centres with the greatest products, best first, and the products."""
    out, score, probes = [], [], min(probes, len(centres))
    for s in range(0, max(len(x), 1), 8192):
        p = x[s : s + 8192] @ centres.T
        if probes == 1:
            top = p.argmax(1)[:, None]
        else:
            top = np.argpartition(-p, probes - 1, axis=1)[:, :probes]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(p, top, 1), axis=1), 1)
        out.append(top)
        score.append(np.take_along_axis(p, top, 1))
    return np.vstack(out).astype(np.int32), np.vstack(score)


def encode_words(res: np.ndarray, x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """Codeword of each subspace, by coordinate descent on the score-aware loss. (n, subspaces)"""
    n, m = len(res), books.shape[0]
    r, v = res.reshape(n, m, SUB), x.reshape(n, m, SUB)
    dist = ((r[:, :, None, :] - books[None]) ** 2).sum(-1)  # (n, m, 16)
    along = (v[:, :, None, :] * (r[:, :, None, :] - books[None])).sum(-1)
    code = dist.argmin(-1)
    par = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0]
    total = par.sum(1)
    for _ in range(rounds):
        for j in range(m):
            rest = total - par[:, j]
            loss = dist[:, j] + (weight - 1) * (rest[:, None] + along[:, j]) ** 2
            best = loss.argmin(1)
            code[:, j] = best
            par[:, j] = along[np.arange(n), j, best]
            total = rest + par[:, j]
    return code.astype(np.uint8)


def pack(code: np.ndarray) -> np.ndarray:
    """Two words to a byte."""
    return (code[:, 0::2] << 4) | code[:, 1::2]


def fit(x: np.ndarray, cells: int, seed: int = 7, rounds: int = 8) -> Index:
    """Partition and codebooks from unit vectors (n, dim)."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(x)))
    centres = _kmeans(x, cells, rounds, rng)
    part = x[rng.permutation(len(x))[:16384]]
    res = part - centres[nearest(part, centres, 1)[0][:, 0]]
    m, w = x.shape[1] // SUB, eta(x.shape[1])
    r, v = res.reshape(-1, m, SUB), part.reshape(-1, m, SUB)
    books = np.stack([r[rng.choice(len(r), WORDS, replace=len(r) < WORDS), j] for j in range(m)]).astype(np.float32)
    for _ in range(rounds):
        code = encode_words(res, part, books, w, 1)
        e = r - books[np.arange(m)[None, :], code]
        par = (e * v).sum(-1)
        total = par.sum(1)
        for j in range(m):
            rest = total - par[:, j] + (r[:, j] * v[:, j]).sum(-1)  # parallel error if the word were 0
            for word in range(WORDS):
                mine = code[:, j] == word
                if mine.any():
                    a = v[mine, j]
                    left = mine.sum() * np.eye(SUB) + (w - 1) * a.T @ a
                    books[j, word] = np.linalg.solve(left, r[mine, j].sum(0) + (w - 1) * (a * rest[mine, None]).sum(0))
    return Index(centres, books)


def usable(embedding: Column, dim: int = DIM) -> Column:
    """Exactly ``dim`` numbers, none null, NaN or infinite, not all zero."""
    good = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(3.0e38)))
    return (F.size(embedding) == dim) & good & F.exists(embedding, lambda v: v != 0)


def unit_vectors(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(id, v, key): usable vectors scaled to length 1, as float32 bytes, and the key of their direction.

    Vectors that are null, of another length, all zero or hold NaN take no part, nor do null ids.
    """

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x = flat / np.abs(flat).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            # + 0.0 turns a negative zero into zero
            keys = [xxhash.xxh128_digest(k.tobytes()) for k in (np.round(x, 4) + 0.0).astype(np.float32)]
            vecs = [v.tobytes() for v in x.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.binary()), pa.array(keys, pa.binary())], names=["id", "v", "key"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("e")).where(F.col("id").isNotNull() & usable(F.col("e"), dim))
    return rows.mapInArrow(scale, "id long, v binary, key binary")


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim) if len(column) else np.zeros((0, dim), np.float32)


def _cells(n: int) -> int:
    """About the square root of the number of vectors, a power of two: 32768 for a thousand million, the most that the sample can tell apart."""
    return int(min(MOST_TRAIN // PER_CELL, max(1, 2 ** round(np.log2(max(1.0, np.sqrt(n)))))))


def train_rows(n: int) -> int:
    """Vectors to fit on."""
    return max(TRAIN_ROWS, PER_CELL * _cells(n))


def default_probes(cells: int, min_cosine: float | None, symmetric: bool = False) -> int:
    """Cells that a query looks into unless told otherwise.

    The k nearest of high-dimensional vectors spread over many cells: cells^0.7 of them held
    more than 0.99 of the ten nearest in every measurement. Vectors with a cosine of 0.9 or more
    lie in one of the few nearest cells; if all vectors ask, a pair is found from either side, and
    half as many do.
    """
    if min_cosine is None or min_cosine < 0.8:
        return max(4, round(cells**0.7))
    return max(3, round(cells**0.22)) if symmetric else max(4, round(cells**0.35))


def build_index(reps: DataFrame, n: int, dim: int = DIM) -> Index:
    """Fit on a bounded number of vectors, taken by the hash of their ids; every vector is indexed later."""
    sample = hashed_sample(reps, "rep", train_rows(n), n).select("v").toArrow().column("v").combine_chunks()
    x = _floats(sample, dim)
    return fit(x, _cells(n)) if len(x) else Index(np.zeros((1, dim), np.float32), np.zeros((dim // SUB, WORDS, SUB), np.float32))


def _indexed(reps: DataFrame, index: Index, dim: int) -> DataFrame:
    """(cell, rep, v, codes) of every vector."""
    weight = eta(dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _floats(b.column("v"), dim)
            cell = nearest(x, index.centres, 1)[0][:, 0]
            codes = pack(encode_words(x - index.centres[cell], x, index.books, weight))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("rep"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "rep", "v", "codes"])

    return reps.select("rep", "v").mapInArrow(assign, "cell int, rep long, v binary, codes binary")


def _probing(queries: DataFrame, index: Index, probes: int, dim: int) -> DataFrame:
    """(cell, query, v) for each cell that a query looks into."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _floats(b.column("v"), dim)
            cells = nearest(x, index.centres, probes)[0]
            each = np.repeat(np.arange(len(x)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), b.column("rep").take(pa.array(each)), b.column("v").take(pa.array(each))], names=["cell", "query", "v"])

    return queries.select("rep", "v").mapInArrow(probe, "cell int, query long, v binary")


def _cell_counts(rows: DataFrame, index: Index, probes: int, dim: int) -> dict[int, int]:
    """How many vectors have each cell among their ``probes`` nearest: one number per cell from each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(index.centres), np.int64)
        for b in batches:
            n += np.bincount(nearest(_floats(b.column("v"), dim), index.centres, probes)[0].ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])

    found = rows.select("v").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row for each cell, at most 32768
    return {r["cell"]: r["n"] for r in found}


def _first_of_each(key: np.ndarray, other: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the ``n`` best of their key, by score at six decimals, then by ``other``."""
    order = np.lexsort((other, -np.round(score, 6), key))
    sorted_ = key[order]
    start = np.flatnonzero(np.append(True, np.diff(sorted_) != 0))[: len(order)]
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    keep = np.zeros(len(order), bool)
    keep[order[place < n]] = True
    return keep


def scan_block(index: Index, cell: int, q: np.ndarray, codes: np.ndarray, x: np.ndarray, k: int, min_cosine: float | None, both: bool = False, names: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best of one block: (row of the query, row of the vector, exact cosine).

    At most k + 1 rows of each query; with ``min_cosine`` and ``both`` also k + 1 of each vector, which
    may be a query itself. ``names`` are the ids that order equal cosines.
    """
    coded = q @ index.decode(codes).T + (q @ index.centres[cell])[:, None]
    if min_cosine is not None:
        a, b = np.nonzero(coded >= min_cosine - SLACK)
        exact = np.einsum("ij,ij->i", q[a].astype(np.float64), x[b].astype(np.float64))
        keep = exact >= min_cosine - 1e-6
        a, b, exact = a[keep], b[keep], exact[keep]
        q_names, x_names = names or (np.arange(len(q)), np.arange(len(x)))
        keep = _first_of_each(a, x_names[b], exact, k + 1)
        if both:
            keep |= _first_of_each(b, q_names[a], exact, k + 1)
        return a[keep], b[keep], exact[keep]
    width = min(len(x), RERANK * (k + 1))
    top = np.argpartition(-coded, width - 1, axis=1)[:, :width] if width < len(x) else np.tile(np.arange(len(x)), (len(q), 1))
    exact = np.einsum("ij,ikj->ik", q.astype(np.float64), x[top].astype(np.float64))
    keep = min(width, k + 1)
    best = np.argpartition(-exact, keep - 1, axis=1)[:, :keep] if keep < width else np.tile(np.arange(width), (len(q), 1))
    a = np.repeat(np.arange(len(q)), best.shape[1])
    return a, np.take_along_axis(top, best, 1).ravel(), np.take_along_axis(exact, best, 1).ravel()


def near_representatives(reps: DataFrame, queries: DataFrame, k: int, probes: int | None, min_cosine: float | None, dim: int = DIM) -> DataFrame:
    """(query, rep, cosine): for each query its best representatives, itself among them.

    The k + 1 best of each probed block, with ``min_cosine`` only those at or above it; if all vectors
    ask, also the k + 1 best askers of each vector of the block. Cells are cut into blocks of at most BLOCK vectors and
    BLOCK queries on average, so a crowded cell is many tasks.
    """
    n = reps.count()
    index = build_index(reps, n, dim)
    symmetric = queries is reps and min_cosine is not None
    probes = probes or default_probes(len(index.centres), min_cosine, symmetric)
    spark = reps.sparkSession
    base = _indexed(reps, index, dim)
    asked = _probing(queries, index, probes, dim)
    sizes, loads = _cell_counts(reps, index, 1, dim), _cell_counts(queries, index, probes, dim)
    cut = spark.createDataFrame([(c, -(-m // BLOCK), -(-loads.get(c, 1) // BLOCK)) for c, m in sizes.items()] or [(-1, 1, 1)], "cell int, vblocks int, qblocks int")
    # a few blocks for each task, however many there are
    tasks = 1 + sum(-(-m // BLOCK) * -(-loads.get(c, 1) // BLOCK) for c, m in sizes.items()) // TASK_BLOCKS
    part = lambda col, into: F.pmod(F.xxhash64(col), F.col(into)).cast("int")
    left = base.join(F.broadcast(cut), "cell").withColumn("vblock", part("rep", "vblocks")).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)))
    right = asked.join(F.broadcast(cut), "cell").withColumn("qblock", part("query", "qblocks")).withColumn("vblock", F.explode(F.sequence(F.lit(0), F.col("vblocks") - 1)))

    def scan(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        names = ["query", "rep", "cosine"]
        if not l.num_rows or not r.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        x, q = _floats(l.column("v").combine_chunks(), dim), _floats(r.column("v").combine_chunks(), dim)
        codes = np.frombuffer(b"".join(l.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        reps_, queries_ = l.column("rep").to_numpy(), r.column("query").to_numpy()
        got = [[], [], []]
        step = max(1, (1 << 22) // len(x))
        for s in range(0, len(q), step):
            a, b, c = scan_block(index, l.column("cell")[0].as_py(), q[s : s + step], codes, x, k, min_cosine, symmetric, (queries_[s : s + step], reps_))
            got[0].append(queries_[s + a])
            got[1].append(reps_[b])
            got[2].append(c)
            if symmetric:  # each side may find what the other doesn't
                got[0].append(reps_[b])
                got[1].append(queries_[s + a])
                got[2].append(c)
        return pa.Table.from_arrays([pa.array(np.concatenate(g)) for g in got], names=names)

    keys = ["cell", "vblock", "qblock"]
    left, right = left.select(*keys, "rep", "v", "codes").repartition(tasks, *keys), right.select(*keys, "query", "v").repartition(tasks, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query long, rep long, cosine double")
    if not symmetric:
        return found
    return found.groupBy("query", "rep").agg(F.max("cosine").alias("cosine"))


def nearest_neighbours(df: DataFrame, k: int = 10, probes: int | None = None, min_cosine: float | None = None, queries: Column | None = None, id_col: str = "id", vec_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(id_a, id_b, cosine, rank): the k nearest other ids of each id, by cosine at six decimals, then id.

    ``probes``: cells a query looks into; more find more, the default grows with their number. ``min_cosine``: only neighbours at or
    above it. ``queries``: a condition on ``id`` that the asking rows fulfil; all rows are
    searched in any case. A repeated id counts once, with the vector of its smallest key; ids
    without a usable vector neither ask nor are found; an empty table gives no row.
    """
    from siltstone.session import cut_lineage

    # two checkpoints: the bounded fit, the counts and the search read the same rows
    vectors = cut_lineage(unit_vectors(df, id_col, vec_col, dim))
    rows = vectors.select("id", "key").groupBy("id").agg(F.min("key").alias("key"))
    heads = cut_lineage(vectors.groupBy("key").agg(F.min(F.struct("id", "v")).alias("r")).select(F.col("r.id").alias("rep"), F.col("r.v").alias("v"), "key"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("place") <= k + 1)
    reps = heads.select("rep", "v")
    asking = rows if queries is None else rows.where(queries)
    asking_reps = reps if queries is None else asking.select("key").distinct().join(heads, "key").select("rep", "v")
    near = near_representatives(reps, asking_reps, k, probes, min_cosine, dim)
    near = near.withColumn("cosine", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")), 6))
    # of each query's representatives the k + 1 best are enough: each stands for one id at least
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "rep"))).where(F.col("place") <= k + 1)
    key_of = heads.select(F.col("rep"), "key")
    members = first.join(key_of, "key").select("rep", F.col("id").alias("id_b"))
    lists = best.join(members, "rep").select("query", "id_b", "cosine")
    lists = lists.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id_b"))).where(F.col("place") <= k + 1).select("query", "id_b", "cosine", "place")
    # every copy has its representative's list without itself
    packed = lists.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id_b", "cosine"))).alias("l"))
    mine = asking.select("id", "key").join(key_of, "key").select("id", F.col("rep").alias("query"))
    others = F.filter("l", lambda e: e.id_b != F.col("id"))
    return (
        mine.join(packed, "query").select(F.col("id").alias("id_a"), F.posexplode(F.slice(others, 1, k)).alias("at", "e"))
        .select("id_a", F.col("e.id_b").alias("id_b"), F.col("e.cosine").alias("cosine"), (F.col("at") + 1).alias("rank"))
    )


def mutual_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of ids that are in each other's lists."""
    pair = found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return pair.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id_a", "id_b")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual ten nearest with a cosine of at least 0.90, over all chunks."""
    return mutual_pairs(nearest_neighbours(spark.read.parquet(f"{sf_dir}/chunks.parquet").select("id", "embedding"), k=10, min_cosine=0.90))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every chunk whose id is divisible by 100, against all chunks."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/chunks.parquet").select("id", "embedding"), k=10, queries=F.col("id") % 100 == 0)


SQL = {
    "p6_found": """
WITH e AS (SELECT DISTINCT id, embedding FROM chunks
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, any_value(embedding)::DOUBLE[] AS v FROM e GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY c DESC, id_b) AS k FROM p WHERE c >= 0.9)
SELECT x.id_a, x.id_b FROM r x JOIN r y ON x.id_a = y.id_b AND x.id_b = y.id_a WHERE x.k <= 10 AND y.k <= 10 AND x.id_a < x.id_b
""",
    "p6_neighbours": """
WITH e AS (SELECT DISTINCT id, embedding FROM chunks
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, any_value(embedding)::DOUBLE[] AS v FROM e GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 100 = 0)
SELECT id_a, id_b, cosine, row_number() OVER (PARTITION BY id_a ORDER BY cosine DESC, id_b)::INT AS rank FROM p QUALIFY rank <= 10
""",
}
