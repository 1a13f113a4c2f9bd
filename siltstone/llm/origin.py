"""Problem 5: files that nobody wrote by hand: generated, minified, vendored, data as code.

Weak labels come from header notices and from the conventions of names and folders that tools
follow. What gives a label is hidden from the features: notices are cut out of the text before
it is measured, and paths are no features of the first forests. These judge files by their
contents: compression ratio, token entropy, identifier lengths, comment density and a few more
figures of the same kind. So files without a notice are found by looking like those with one.
Contents can't tell a copy from another project, nor a small output of a tool; a last forest
therefore sees the conventions of names and folders beside the contents and learns from labels
and from what the contents told. It has a vote on files whose name or folder tells something. What is voted down
though its header says outright that nobody here wrote it is added by an exact reading of the
header.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import hashed_sample

#: Files that the forest is trained on, at most.
TRAIN_FILES = 20_000
#: Weight of a labelled file against one without a label in training. About half of the tools' files
#: carry no label, so where both kinds look alike the label has to outweigh its absence.
LABEL_WEIGHT = 4.0
#: Probability of the first forest from which a file without a label is no reliable negative.
DOUBTFUL = 0.14
#: Files of a leaf at least: smaller leaves would close around the few labelled files of a kind and leave their like outside.
LEAF = 6
#: Probability from which the forest's word counts.
THRESHOLD = 0.5
#: The header of a file ends before its line of code with this number; comments and blank lines don't count.
HEADER_CODE = 3

# Folders and names that tools give.
VENDOR_FOLDERS = "vendor third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages Pods Carthage site-packages dist-packages extern external externals deps Godeps".split()
OUTPUT_FOLDERS = "dist gen generated __generated__ generated-sources target out public/build assets/js .next".split()
TOOL_NAMES = r"(?:[.\-_](?:min|bundle|chunk|pack|packed)\.(?:js|mjs|cjs|css)|[._](?:g|gen|generated|pb|freezed)\.[a-z]+|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|swift)|_(?:autogen|generated|gen)\.[a-z]+|\.designer\.cs|-lock\.json|\.lock|\.map)$"

_COMMENT = r"(?:^|(?<=\n))[ \t]*(?:/\*+!?|//+!?|#+!?|\*+|<!--|--|;+|%+|\"\"\"|''')[ \t]*"
_GENERATED = regex.compile(
    _COMMENT + r"(?i:"
    r"@(?:auto-?)?generated\b|<auto-?generated\b|auto-?(?:matically )?generated\b(?:[\s:.\-]|file)"
    r"|(?:code |file |source |this (?:file|code|module|class) (?:is|was|has been) )?(?:automatically |auto-?|machine-?)?(?:generated|produced|emitted|built|created|written)\s+(?:from|by|with|using)\s+\S+[^\n]*(?:do not|don't|edit|modif|lost|overwritten|\bv?\d+\.\d|\.(?:idl|proto|schema|graphql|thrift|json|ya?ml|xsd|wsdl)\b)"
    r"|this (?:file|code) (?:is|was|has been) [^\n\"]{0,60}(?:chang\w+ will be (?:lost|overwritten)|do not (?:edit|modify|change|touch))"
    r"|do not (?:edit|modify|change)\b[^\n\"]*|[^\n\"]{0,80}\bdo not (?:edit|modify)(?: by hand|\.|!|$)"
    r"|(?:source|input|tool|generator)\s*:[^\n]*(?:machine output|tool\s*:|\.proto\b)"
    r"|diese datei (?:wird|wurde)[^\n]*(?:erzeugt|generiert|erstellt)|[^\n\"]*nicht von hand (?:ändern|bearbeiten)"
    r"|ce fichier (?:est|a été)[^\n]*(?:produit|généré|créé)|[^\n\"]*ne pas (?:modifier|éditer)"
    r"|este (?:fichero|archivo)[^\n]*(?:generado|producido|creado)|[^\n\"]*no (?:editar|modificar)\b"
    r"|этот файл[^\n]*(?:создан|сгенерирован)|[^\n\"]*не редактировать"
    r"|[^\n\"]*(?:自动生成|自動生成|请勿(?:编辑|修改|手动)|编集しないで|編集しないで|手で編集)"
    r")"
)
_VENDORED = regex.compile(
    _COMMENT + r"(?i:"
    r"(?:imported|copied|vendored|taken|forked)\s+(?:unchanged |verbatim |unmodified )?from\s+\S*(?://|\.\w)|licensed under the \w+ licen[cs]e|local copy\b|[^\n]{0,60}bundled copy\b|[^\n]{0,40}see upstream"
    r"|[\w.@/\-]+ v?\d+\.\d+(?:\.\d+)?[^\n]*(?:\(c\)|©|copyright|licen[cs]e)|permission is hereby granted|redistribution and use in source|spdx-license-identifier"
    r")"
)
_COPYRIGHT = regex.compile(_COMMENT + r"(?i:(?:copyright|\(c\)|©)\s+(?:\(c\)\s+|©\s+)?(?:\d{4}[\d,\-– ]*\s+)?(?:the\s+|by\s+)?(?P<who>[^\n.,;|]+))")
_COMMENT_LINE = regex.compile(r"[ \t]*(?:/\*|//|#|\*|<!--|--|;|%|\"\"\"|''')")
_BANG = regex.compile(r"^\s*/\*!.*?\*/", regex.S)
_BODY_OF = regex.compile(r"(?i)\b(?:the|and|its?|authors?|contributors?|developers?|maintainers?|team|project|inc|ltd|gmbh|llc|foundation|all rights reserved)\b")
_FOOT = regex.compile(r"[#/@]+ ?sourceMappingURL=\S+")
_TOKEN = regex.compile(r"[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|[^\s\w]")
_IDENT = regex.compile(r"[A-Za-z_$][A-Za-z_$0-9]*")
_COMMENTS = regex.compile(r"/\*.*?\*/|(?<![:\"'])//[^\n]*|(?<=^|\n)[ \t]*#[^\n]*|<!--.*?-->", regex.S)
_STRING = regex.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_DIGITS = regex.compile(r"\d+")

#: Summed over the chunks of a file.
SUMS = "chars zipped tokens token_bits ident_chars idents short_idents comment_chars string_chars digits spaces lines shapes long_chars numbers words_kinds".split()
PATH_FEATURES = "in_copies in_outputs tool_name".split()
FEATURES = "log_chars ratio entropy ident_length short_share comment_share string_share digit_share space_share line_length repeated long_share number_share vocabulary".split()


def header_lines(lines: list[str]) -> int:
    """How many lines the header has: comments of whatever length and blank lines, up to the HEADER_CODE-th line of code."""
    code, inside = 0, ""
    for k, line in enumerate(lines):
        if inside:
            if inside in line:
                inside = ""
            continue
        bare = line.strip()
        if not bare:
            continue
        if _COMMENT_LINE.match(line):
            opened = "*/" if bare.startswith("/*") else "-->" if bare.startswith("<!--") else bare[:3] if bare[:3] in ('"""', "'''") else ""
            if opened and opened not in bare[3 if opened == bare[:3] else 2 :]:
                inside = opened
            continue
        code += 1
        if code == HEADER_CODE:
            return k
    return len(lines)


def holder(header: str) -> str | None:
    """Whom a copyright line names, in lower case without words such as 'authors'."""
    who = _COPYRIGHT.search(header)
    return " ".join(regex.sub(r"[^\w]+", " ", _BODY_OF.sub(" ", who.group("who").lower())).split()) or None if who else None


def notice(header: str) -> tuple[bool, bool, str | None]:
    """(a tool wrote it, it was copied from somewhere, the copyright holder). Only comments at the top count."""
    return bool(_GENERATED.search(header)), bool(_VENDORED.search(header)), holder(header)


def without_notice(text: str, first: bool) -> str:
    """The text without the comments of its header and without a reference to a source map."""
    if first:
        lines = text.split("\n")
        k = 0
        while k < len(lines) and (not lines[k].strip() or _COMMENT_LINE.match(lines[k])):
            k += 1
        text = "\n".join(lines[k:]) if any(notice("\n".join(lines[:k]))) else _BANG.sub("", text, count=1)
    return _FOOT.sub("", text)


def measures(text: str) -> list[float]:
    """The SUMS of a text."""
    n = len(text)
    raw = text.encode("utf-8", "surrogatepass")
    tokens = _TOKEN.findall(text)
    counts = Counter(tokens)
    t = len(tokens)
    bits = -sum(c * math.log2(c / t) for c in counts.values()) if t else 0.0
    idents = [w for w in tokens if w[0].isalpha() or w[0] in "_$"]
    lines = text.split("\n")
    full = [x for x in (_DIGITS.sub("0", line.strip()) for line in lines) if len(x) > 1]
    numbers = sum(1 for w in tokens if w[0].isdigit())
    comments = _COMMENTS.findall(text) if "/" in text or "#" in text or "<!" in text else []
    return [
        n, len(zlib.compress(raw, 6)) * (n / max(1, len(raw))), t, bits, sum(map(len, idents)), len(idents), sum(1 for w in idents if len(w) <= 2),
        sum(map(len, comments)), sum(map(len, _STRING.findall(text))), sum(c.isdigit() for c in text), sum(c.isspace() for c in text), len(full), len(set(full)),
        sum(len(x) for x in lines if len(x) > 250), numbers, len({_DIGITS.sub("0", w) for w in idents}),
    ]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, index, start, text in zip(pdf["file_path"], pdf["chunk_index"], pdf["start_line"], pdf["chunk_text"]):
            text = text or ""
            first = (not pd.isna(start) and start == 0) or (not pd.isna(index) and index == 0)
            made, copied, who = False, False, None
            if first:
                lines = text.split("\n")
                made, copied, who = notice("\n".join(lines[: header_lines(lines)]))
            made = made or bool(_FOOT.search(text))
            rows.append((path, made, copied, who, *measures(without_notice(text, first))))
        yield pd.DataFrame(rows, columns=["file_path", "made", "copied", "holder", *SUMS])


def file_measures(chunks: DataFrame) -> DataFrame:
    """One row per file: path, what its header tells (made by a tool, copied, copyright holder), and the FEATURES.

    Measured per chunk and summed, partially before the shuffle: no file's text is gathered, so
    a file with a third of all rows is no hot spot. All versions of a file count; repeated rows
    weigh twice in sums of which only quotients are used. Null paths give no row, null texts
    count as empty.
    """
    m = chunks.where(F.col("file_path").isNotNull()).select("file_path", "chunk_index", "start_line", "chunk_text").mapInPandas(_measure, "file_path string, made boolean, copied boolean, holder string, " + ", ".join(f"{s} double" for s in SUMS))
    g = m.groupBy("file_path").agg(*(F.max(c).alias(c) for c in ("made", "copied", "holder")), F.count(F.lit(1)).alias("n"), *(F.sum(s).alias(s) for s in SUMS))
    by = lambda a, b: F.col(a) / F.greatest(F.lit(1.0), F.col(b))
    return g.select(
        "file_path", "made", "copied", "holder",
        F.log1p(F.col("chars") / F.col("n")).alias("log_chars"), by("zipped", "chars").alias("ratio"), by("token_bits", "tokens").alias("entropy"), by("ident_chars", "idents").alias("ident_length"),
        by("short_idents", "idents").alias("short_share"), by("comment_chars", "chars").alias("comment_share"), by("string_chars", "chars").alias("string_share"), by("digits", "chars").alias("digit_share"),
        by("spaces", "chars").alias("space_share"), by("chars", "lines").alias("line_length"), (1 - by("shapes", "lines")).alias("repeated"), by("long_chars", "chars").alias("long_share"),
        by("numbers", "tokens").alias("number_share"), by("words_kinds", "idents").alias("vocabulary"),
    )


def _in_folder(path, folders: list[str]):
    p = F.concat(F.lit("/"), path)
    found = F.lit(False)
    for f in folders:
        found = found | p.contains(f"/{f}/")
    return found


def owner_of(files: DataFrame) -> str | None:
    """The copyright holder that most files name, the project's own; None if two are named equally often."""
    top = files.where(F.col("holder").isNotNull()).groupBy("holder").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "holder").limit(2).collect()
    return top[0]["holder"] if top and (len(top) == 1 or top[0]["n"] > top[1]["n"]) else None


def with_labels(files: DataFrame, owner: str | None = None) -> DataFrame:
    """Adds ``told`` (1: made by a tool, 2: from another project than ``owner``, 0), the PATH_FEATURES and ``label``: 1 where any of them tells that nobody wrote the file."""
    path = F.col("file_path")
    own = F.coalesce(F.col("holder") == F.lit(owner), F.lit(False))
    told = F.when(F.col("made"), 1).when((F.col("copied") | F.col("holder").isNotNull()) & ~own, 2).otherwise(0)
    signs = {"in_copies": _in_folder(path, VENDOR_FOLDERS), "in_outputs": _in_folder(path, OUTPUT_FOLDERS), "tool_name": path.rlike(f"(?i){TOOL_NAMES}")}
    out = files.withColumn("told", told).withColumns({k: v.cast("double") for k, v in signs.items()})
    return out.withColumn("label", ((F.col("told") > 0) | (F.col("in_copies") + F.col("in_outputs") + F.col("tool_name") > 0)).cast("int"))


def training_sample(labelled: DataFrame):
    """At most TRAIN_FILES files chosen by the hash of their paths, so that the share of labelled ones is that of all, as a pandas frame."""
    return hashed_sample(labelled, "file_path", TRAIN_FILES, labelled.count()).select("told", "label", *PATH_FEATURES, *FEATURES).toPandas()


def _forest(features: list[str], trees: int, depth: int, seed: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAF, featureSubsetStrategy="sqrt", seed=seed, maxBins=64),
    ])


def train(labelled: DataFrame, trees: int = 100, depth: int = 8, seed: int = 5):
    """Random forests for labels that are right but not complete: (of contents, of contents and paths). None if only one label occurs.

    The first forest of contents finds, among the files without a label, those that look like
    labelled ones; they are as good as unlabelled and take no part in the second, which is trained on
    labelled files against reliable negatives. Copies from other projects are left out of both: they
    were written by hand somewhere, so their contents teach nothing. The last forest sees the
    conventions of paths too; what the second says of a file, or its name or folder, is its label.
    """
    from pyspark.ml.functions import vector_to_array

    spark = labelled.sparkSession
    sample = training_sample(labelled)  # bounded by TRAIN_FILES
    own = sample[(sample["told"] != 2) & (sample["in_copies"] == 0)]
    if own["label"].nunique() < 2:
        return None
    data = spark.createDataFrame(own.assign(weight=own["label"].map({1: LABEL_WEIGHT, 0: 1.0}))).coalesce(4)
    forest = _forest(FEATURES, trees, depth, seed)
    first = forest.fit(data).transform(data).withColumn("p", vector_to_array("probability")[1])
    contents = forest.fit(first.where((F.col("label") == 1) | (F.col("p") < DOUBTFUL)).select("label", "weight", *FEATURES))
    every = contents.transform(spark.createDataFrame(sample).coalesce(4)).withColumn("p", vector_to_array("probability")[1])
    known = (F.col("p") >= THRESHOLD) | (F.col("in_copies") + F.col("in_outputs") + F.col("tool_name") > 0)
    given = every.select(known.cast("int").alias("label"), F.when(known, 2.0).otherwise(1.0).alias("weight"), *FEATURES, *PATH_FEATURES)
    return contents, _forest([*FEATURES, *PATH_FEATURES], trees, depth + 2, seed).fit(given)


def judged_files(chunks: DataFrame, owner: str | None = None) -> DataFrame:
    """(file_path, told, label, by_contents, probability, ...): every file with what its header tells, its label, the vote of the forest of contents, and the vote that counts: where a name or folder tells something, the higher of both forests.

    ``owner``: the project's own name in copyright lines, by default the one that most files name.
    """
    from pyspark.ml.functions import vector_to_array

    from siltstone.session import cut_lineage

    files = cut_lineage(file_measures(chunks))
    labelled = with_labels(files, owner or owner_of(files))
    models = train(labelled)
    if models is None:
        return labelled.select("file_path", "told", "label", F.col("label").cast("double").alias("by_contents"), F.col("label").cast("double").alias("probability"), *FEATURES)
    contents, last = models
    seen = contents.transform(labelled).withColumn("by_contents", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    sign = F.col("in_copies") + F.col("in_outputs") + F.col("tool_name") > 0
    both = last.transform(seen).withColumn("by_all", vector_to_array("probability")[1])
    return both.select("file_path", "told", "label", "by_contents", F.when(sign, F.greatest("by_contents", "by_all")).otherwise(F.col("by_contents")).alias("probability"), *FEATURES)


def unwritten_files(chunks: DataFrame, threshold: float = THRESHOLD, owner: str | None = None) -> DataFrame:
    """The files that nobody wrote by hand, each once: by the vote of a forest, or because their header says so."""
    return judged_files(chunks, owner).where((F.col("probability") >= threshold) | (F.col("told") > 0)).select("file_path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of chunks that nobody wrote by hand."""
    from siltstone.session import spread

    return unwritten_files(spread(spark.read.parquet(f"{sf_dir}/chunks.parquet").select("id", "file_path", "chunk_index", "start_line", "chunk_text"), "id"))


SQL: dict[str, str] = {}
