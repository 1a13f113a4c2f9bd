"""Session helpers: table access, checkpoints in the shared folder, size checks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "siltstone", cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of this machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    have = sc.getCheckpointDir()
    if have:
        return have
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, by the hash of ``key`` in as many parts as there are cores if it is read in fewer: for work on rows that costs far more than moving them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, deleted when the application ends; read it as often as needed.

    Smaller than a checkpoint, and filters and columns reach its scan.
    """
    import uuid

    from siltstone.sources.shared import Folder

    folder = Folder(df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    folder.delete_at_exit()
    df.write.parquet(folder.path())
    return df.sparkSession.read.schema(df.schema).parquet(folder.path())


def hashed_sample(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """At most ``most`` of ``total`` rows, those with the smallest hashes of ``key``: the same ones whatever the layout.

    Rows that can't be among them are left out in the scan, so what comes together in the end is little more than the sample.
    """
    from pyspark.sql import functions as F

    h, span = F.pmod(F.xxhash64(F.lit(29), key), F.lit(1 << 30)), 1 << 30
    share = min(1.0, (1.1 * most + 100) / max(1, total))
    return df.where(h < int(share * span) + 1).orderBy(h, key).limit(most)


def bounded_rows(df: DataFrame, bound: int) -> list | None:
    """All rows if there are at most ``bound`` of them, else None.

    Reads at most ``bound + 1`` rows to the driver, so the check itself is bounded.
    """
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None
