"""Reading files and settings, writing results."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import fixed, globs
from siltstone.sources.shared import Folder

CHUNK_SCHEMA = (
    "id long, file_path string, chunk_index int, chunk_text string, start_line int, end_line int, embedding array<float>, "
    "file_hash string, identifiers string, updated_at timestamp, vector_pending boolean"
)
EMPTY = "path string, size long, modified_at timestamp, text string"


def read_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_kb: float = 500.0, modified_after: str | None = None, blacklist: list[str] | None = None, whitelist: list[str] | None = None) -> DataFrame:
    """(path, size, modified_at, text) of the files below ``root`` that globs and lists allow, paths relative to it.

    Size, time and path are known before a file is read, so files left out cost no read. An empty
    or missing folder gives no row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    base = root.rstrip("/")
    try:
        found = reader.load(base)
    except Exception as e:  # noqa: BLE001 - a missing folder is an empty one
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return spark.createDataFrame([], EMPTY)
        raise
    # paths come back with their file system's address in front, whatever form the root was given in
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(re.sub(r"^file:/+", "/", Folder(spark, base).path())) + "/+", "")
    rows = found.where(F.col("length") <= max_kb * 1024).select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    keep = globs.should_index(F.col("path"), include, exclude, blacklist, whitelist)
    seen = rows.where(keep).select("path", "size", "modified_at", F.decode("content", "UTF-8").alias("text"))
    hidden = _hidden_names(base.removeprefix("file://")) if spark.sparkContext.master.startswith("local") else []
    return seen.unionByName(_read_hidden(spark, base.removeprefix("file://"), hidden, max_kb, modified_after).where(keep)) if hidden else seen


def _hidden_names(base: str) -> list[str]:
    """Relative paths with a part that begins with a point or an underscore, which Spark's reader leaves out.

    Only of folders that the file system here shows; links aren't followed. Names alone are read.
    """
    import os

    out = []
    for folder, _, names in os.walk(base):
        rel = os.path.relpath(folder, base)
        inside = rel != "." and any(p[0] in "._" for p in rel.split(os.sep))
        out += [os.path.normpath(os.path.join(rel, n)) for n in names if (inside or n[0] in "._") and not os.path.islink(os.path.join(folder, n))]
    return out


def _read_hidden(spark: SparkSession, base: str, names: list[str], max_kb: float, modified_after: str | None) -> DataFrame:
    def read(batches):
        import os

        import pandas as pd

        for pdf in batches:
            rows = []
            for n in pdf["path"]:
                st = os.stat(os.path.join(base, n))
                if st.st_size <= max_kb * 1024:
                    with open(os.path.join(base, n), encoding="utf-8", errors="replace") as f:
                        rows.append((n, st.st_size, pd.Timestamp(st.st_mtime, unit="s"), f.read()))
            yield pd.DataFrame(rows, columns=["path", "size", "modified_at", "text"]).astype({"modified_at": "datetime64[us]"})

    found = spark.createDataFrame([(n,) for n in names], "path string").mapInPandas(read, EMPTY)
    return found.where(F.col("modified_at") > F.lit(modified_after).cast("timestamp")) if modified_after else found


def list_tracked(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path): a given listing, for instance of a version control system, as a table."""
    return spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")


def git_tracked(spark: SparkSession, root: str, timeout: float = 30) -> DataFrame:
    """(path): the files that git tracks below a local folder; none if it is no repository or there is no git."""
    import subprocess

    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return list_tracked(spark, [])
    return list_tracked(spark, [p for p in out.decode("utf-8", "replace").split("\0") if p])


def git_blob(root: str, path: str, ref: str = "HEAD", timeout: float = 30) -> str | None:
    """The text of a file at a commit, or None if it isn't there."""
    import subprocess

    try:
        return subprocess.run(["git", "-C", root, "show", f"{ref}:{path}"], capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")
    except (OSError, subprocess.SubprocessError):
        return None


def first_available(*sources) -> DataFrame:
    """The first of several ways to list files that gives any row; the last one if none does."""
    for make in sources:
        df = make()
        if not df.isEmpty():
            return df
    return df


# Settings unless told otherwise.
DEFAULTS = {
    "embedding": {"dimensions": 768, "batch_size": 32, "context_limit": 512, "query_prefix": "", "document_prefix": "", "enabled": True},
    "chunking": {"max_tokens": 512, "overlap_tokens": 32},
    "indexing": {"include": fixed.INCLUDE_GLOBS, "exclude": fixed.EXCLUDE_GLOBS, "max_file_size_kb": 500},
    "search": {"top_k": 10, "similarity_threshold": 0.35, "hybrid": {"weight_vector": 0.4, "weight_bm25": 0.3, "weight_rrf": 0.3, "identifier_boost": 1.5}},
}


def merge_settings(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``: nested settings merge, lists are united, None is ignored."""
    out = dict(base)
    for k, v in over.items():
        if v is None:
            continue
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merge_settings(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = list(dict.fromkeys([*out[k], *v]))
        else:
            out[k] = v
    return out


def load_settings(*files: str, ignore_file: str | None = None, blacklist_file: str | None = None) -> dict:
    """Defaults, then each JSON file that exists, then globs of an ignore file and of a blacklist."""
    out = DEFAULTS
    for f in files:
        if Path(f).exists():
            try:
                out = merge_settings(out, json.loads(Path(f).read_text()))
            except json.JSONDecodeError as e:
                raise ValueError(f"{f} is no JSON: {e}") from e
    more: list[str] = []
    if ignore_file and Path(ignore_file).exists():
        more += globs.ignore_lines_to_globs(Path(ignore_file).read_text().splitlines())
    if blacklist_file and Path(blacklist_file).exists():
        data = json.loads(Path(blacklist_file).read_text())
        more += globs.blacklist_to_globs(data if isinstance(data, list) else data.get("paths", []))
    return merge_settings(out, {"indexing": {"exclude": more}})


def get_setting(settings: dict, key: str):
    """The value at a dotted key, or None."""
    for part in key.split("."):
        if not isinstance(settings, dict) or part not in settings:
            return None
        settings = settings[part]
    return settings


def set_setting(settings: dict, key: str, value) -> dict:
    """A copy with the value at a dotted key; text that is JSON counts as what it says."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except json.JSONDecodeError:
            pass
    head, _, rest = key.partition(".")
    inner = settings.get(head)
    return {**settings, head: set_setting(inner if isinstance(inner, dict) else {}, rest, value) if rest else value}


class StateFile:
    """A small key-value store in one JSON file of any file system; each change replaces the file as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        folder, _, self.name = path.rpartition("/")
        self.folder = Folder(spark, folder or ".")
        self.folder.make()

    def all(self) -> dict:
        return json.loads(self.folder.read(self.name) or "{}")

    def get(self, key: str, default=None):
        return self.all().get(key, default)

    def set(self, **values) -> None:
        self.folder.write(self.name, json.dumps({**self.all(), **values}))

    def clear(self, *keys: str) -> None:
        self.folder.write(self.name, json.dumps({k: v for k, v in self.all().items() if k not in keys}))


def append_metric(spark: SparkSession, folder: str, name: str, value: float) -> None:
    """Append one sample (name, value, recorded_at)."""
    spark.range(1).select(F.lit(name).alias("name"), F.lit(float(value)).alias("value"), F.current_timestamp().alias("recorded_at")).coalesce(1).write.mode("append").parquet(folder)
