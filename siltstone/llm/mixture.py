"""Problem 8: mixing sources to target weights.

A source's documents are put into a pseudo-random order and joined into blocks of equal size
in tokens of a public tokenizer. Slots of the mixture are given to sources by a low-discrepancy
sequence: the golden-ratio points are mapped through the cumulative weights, so that after any
number of slots every source has had its share to within a few blocks. The r-th slot of a
source takes the r-th block of the source's documents, which follow each other again and again, at most
``max_repeats`` times.

Ranks and running sums are made in two steps, inside buckets of bounded size and over the few
bucket totals, so that no task holds a whole source.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vocabulary of the tokenizer that sizes are counted with; found in /opt/tokenizers unless told otherwise.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
TOKENIZER_FOLDER = "/opt/tokenizers"
#: Pattern that byte-level vocabularies of this kind are split with (a fixed value of theirs).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Size of a block in tokens, unless the mixture is so small that its smallest source would have fewer than LEAST_BLOCKS of them.
BLOCK_TOKENS = 512
LEAST_BLOCKS = 32
#: Rows or slots that are ranked together, about.
BUCKET = 4096
GOLDEN = 0.6180339887498949

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file of ranks, kept per process."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_tokens(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): source trimmed and in lower case, size of the whole text in tokens; a null text has none."""
    path = vocabulary or os.path.join(TOKENIZER_FOLDER, VOCABULARY)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            tokens = [0 if t is None else len(enc.encode_ordinary(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": tokens})

    return documents.select("doc_id", normal_source("source").alias("source"), "text").mapInPandas(count, "doc_id long, source string, tokens long")


def normal_source(col: str):
    """Lower case, without blanks around; blank is null."""
    s = F.lower(F.trim(F.regexp_replace(F.col(col), r"[\s ]+", " ")))
    return F.when(s != "", s)


def block_size(order: list[dict], most: int = BLOCK_TOKENS) -> int:
    """Tokens of a block: shares are met to about a block, so the scarcest source gets LEAST_BLOCKS of them or more."""
    takes = [r["take"] for r in order if r["take"] > 0]
    return max(1, min([most, *(int(t // LEAST_BLOCKS) for t in takes)]))


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | str | None = None) -> list[dict]:
    """For each source of ``targets``: documents, tokens available, weight, share and tokens to take.

    One row per source, gathered by the driver (the list of sources is part of the order, not of
    the data). Sources without tokens get nothing and the others share their weight. Without
    ``total_tokens`` the mixture is the largest that meets all shares; with it (a number, or "all" for as
    many as the live sources hold), sources that would exceed ``max_repeats`` are filled up to that
    and the rest is shared among the others: their shares fall short, and they are ``capped``.
    """
    t = targets.select(normal_source("source").alias("source"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r"))
    t = t.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("w").alias("w"), F.max("r").alias("r"))
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = [r.asDict() for r in t.join(have, "source", "left").orderBy("source").collect()]
    for r in rows:
        r["tokens"], r["docs"], r["r"] = int(r["tokens"] or 0), int(r["docs"] or 0), max(0, int(r["r"] or 0))
        r["w"] = float(r["w"]) if r["w"] and r["w"] == r["w"] and r["w"] > 0 else 0.0
        r["most"] = r["tokens"] * r["r"]
    live = [r for r in rows if r["most"] > 0 and r["w"] > 0]
    weight = sum(r["w"] for r in live)
    for r in rows:
        r["target_share"] = r["w"] / weight if r in live else 0.0
        r["take"], r["capped"] = 0.0, False
    if not live:
        return rows
    if total_tokens is None:
        size = min(r["most"] / r["target_share"] for r in live)
        for r in live:
            r["take"] = size * r["target_share"]
        return rows
    left, open_ = float(sum(r["tokens"] for r in live) if total_tokens == "all" else total_tokens), list(live)
    while open_:
        weight = sum(r["w"] for r in open_)
        full = [r for r in open_ if left * r["w"] / weight >= r["most"]]
        if not full:
            for r in open_:
                r["take"] = left * r["w"] / weight
            break
        for r in full:
            r["take"], r["capped"] = float(r["most"]), True
        left -= sum(r["most"] for r in full)
        open_ = [r for r in open_ if r not in full]
    return rows


def blocks(sizes: DataFrame, order: list[dict], block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """(source, doc_id, pass, block, part): documents in pseudo-random order, cut into blocks of equal size.

    The passes over a source follow each other without a gap, so every block is whole. A
    document that crosses the border of blocks belongs to each of them with ``part`` tokens. The
    order is by a hash of the document's id; its leading bits are the bucket in which the
    running sum is made, and the buckets' totals give the rest of the sum.
    """
    spark = sizes.sparkSession
    live = [(r["source"], max(1, r["docs"] // BUCKET), r["tokens"], min(r["r"], int(r["take"] // max(1, r["tokens"])) + 1)) for r in order if r["take"] > 0]
    given = spark.createDataFrame(live or [("", 1, 0, 1)], "source string, buckets int, size long, passes int")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sizes.where(F.col("tokens") > 0).join(F.broadcast(given), "source").withColumn("h", F.shiftrightunsigned(h, 1))
    rows = rows.withColumn("bucket", F.least(F.col("buckets") - 1, F.floor(F.col("h") / F.lit(float(2**63)) * F.col("buckets"))).cast("int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    placed = rows.join(starts, ["source", "bucket"]).withColumn("last", F.col("start") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("end", F.col("last") + F.col("pass") * F.col("size")).withColumn("begin", F.col("end") - F.col("tokens"))
    size = F.lit(block_tokens)
    cut = passes.select("source", "doc_id", "pass", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("end") - 1) / size))).alias("block"))
    part = F.least(F.col("end"), (F.col("block") + 1) * size) - F.greatest(F.col("begin"), F.col("block") * size)
    return cut.select("source", "doc_id", "pass", "block", part.alias("part"))


def schedule(spark: SparkSession, order: list[dict], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, block): which block of which source stands at each slot.

    Slot i gets the source into whose part of the cumulative weights the fractional part of
    (i + 1/2) times the golden ratio falls. Slots are ranked per source inside buckets of
    consecutive slots; the bucket counts are summed up. Slots beyond what a source may give
    are left out, so no cap is exceeded.
    """
    live = [r for r in order if r["take"] > 0]
    if not live:
        return spark.createDataFrame([], "slot long, source string, block long")
    total = sum(r["take"] for r in live)
    slots = max(1, int(total / block_tokens))
    edges, at = [], 0.0
    for r in live:
        at += r["take"] / total
        edges.append(at)
    point = (F.col("slot") + 0.5) * F.lit(GOLDEN) - F.floor((F.col("slot") + 0.5) * F.lit(GOLDEN))
    source = F.lit(live[-1]["source"])
    for r, edge in reversed(list(zip(live[:-1], edges[:-1]))):
        source = F.when(point < edge, F.lit(r["source"])).otherwise(source)
    given = spark.range(slots).withColumnRenamed("id", "slot").withColumn("source", source).withColumn("bucket", F.floor(F.col("slot") / BUCKET))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = given.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("slot")
    ranked = given.join(starts, ["source", "bucket"]).withColumn("block", F.col("start") + F.row_number().over(inside) - 1)
    most = spark.createDataFrame([(r["source"], r["most"] // block_tokens) for r in live], "source string, most long")
    return ranked.join(F.broadcast(most), "source").where(F.col("block") < F.col("most")).select("slot", "source", "block")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, block_tokens: int | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: slot, source, block, pass, doc_id, part - the documents of each slot's block and how
    many tokens of each belong to it. shares: source, target_share, actual_share, tokens, available, documents,
    max_repeats, repeats, capped - of every source of ``targets``, reached with the mixture. Sources in ``documents``
    without a target and null sources take no part; a null text has no tokens and takes none.
    """
    from siltstone.session import cut_lineage

    sizes = cut_lineage(with_tokens(documents, vocabulary))
    order = plan(sizes, targets, total_tokens)
    block_tokens = block_tokens or block_size(order)
    spark = documents.sparkSession
    mixture = schedule(spark, order, block_tokens).join(blocks(sizes, order, block_tokens), ["source", "block"])
    mixture = mixture.select("slot", "source", "block", "pass", "doc_id", "part")
    planned = spark.createDataFrame([(r["source"], r["target_share"], r["tokens"], r["docs"], r["r"], r["capped"]) for r in order], "source string, target_share double, available long, documents long, max_repeats int, capped boolean")
    used = mixture.groupBy("source").agg(F.sum("part").alias("tokens"), (F.max("pass") + 1).alias("repeats"))
    shares = planned.join(used, "source", "left").fillna(0, ["tokens", "repeats"])
    whole = shares.groupBy().agg(F.sum("tokens").alias("t")).select(F.col("t").cast("double")).scalar()
    return mixture, shares.select("source", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0.0)), F.lit(0.0)), 6).alias("actual_share"), "tokens", "available", "documents", "max_repeats", "repeats", "capped")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from siltstone.session import spread

    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), "doc_id"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents to the target weights."""
    return mix(*_tables(spark, sf_dir))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of all sources."""
    return mix(*_tables(spark, sf_dir))[1]


def p8_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture as large as the documents of all sources together: scarce sources at their cap, the rest by weight."""
    return mix(*_tables(spark, sf_dir), total_tokens="all")[0]


def p8_filled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of that mixture."""
    return mix(*_tables(spark, sf_dir), total_tokens="all")[1]


SQL: dict[str, str] = {}
