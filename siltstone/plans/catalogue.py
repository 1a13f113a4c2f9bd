"""All core queries over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import fixed, globs, scalar, text, tokenizers
from siltstone.operators import chunking, embed, incremental, maintenance, observe, search
from siltstone.operators.index import SearchIndex, index_of
from siltstone.session import table
from siltstone.streaming import events as ev

DIM = 64
QUERY = "const value loadIndex cache"
VECTOR = embed.placeholder_vector(QUERY, DIM)
SINCE = "2026-01-20 00:00:00"
LITERAL = "update new"
REGEX_KINDS = "function", "class", "interface"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + "]"


def _vector_sql(v: list[float]) -> str:
    return "[" + ", ".join(repr(x) for x in v) + "]::DOUBLE[]"


#: One row per id, as the search queries see the table.
ONE = "one AS (SELECT DISTINCT ON (id) id, file_path, chunk_index, chunk_text, start_line, end_line, embedding, identifiers, file_hash FROM chunks WHERE id IS NOT NULL ORDER BY id)"
USABLE = f"embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
KNN = f"knn AS (SELECT id, file_path, start_line, round(list_cosine_similarity(embedding::DOUBLE[], {_vector_sql(VECTOR)}), 6) AS similarity FROM one WHERE {USABLE})"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks")


def indexed(spark: SparkSession, d: str) -> SearchIndex:
    """The kept index of the chunks; the first query over them builds it."""
    return index_of(spark, f"{d}/chunks.parquet", DIM)


# ---- sources and filters

@query(f"SELECT DISTINCT path FROM file_events WHERE lower(event_type) IN ('add', 'change') AND ts > TIMESTAMPTZ '{SINCE}+00' AND path IS NOT NULL")
def modified_since(spark, d):
    """Files changed after a time."""
    return maintenance.modified_since(table(spark, d, "file_events"), SINCE)


@query("SELECT path, count(*) AS n FROM (SELECT path FROM file_events WHERE event_type = 'add' UNION SELECT path FROM file_events WHERE event_type = 'change') GROUP BY path UNION ALL SELECT path, 0 AS n FROM file_events WHERE event_type = 'unlink'")
def union_files(spark, d):
    """Distinct union of two listings, then all of a third."""
    e = table(spark, d, "file_events")
    of = lambda t, n: e.where(F.col("event_type") == t).select("path", F.lit(n).alias("n"))
    return maintenance.union_files(of("add", 1), of("change", 1), of("unlink", 0))


@query("SELECT doc_id FROM documents WHERE strlen(text) / 1024.0 <= 1")
def size_filter(spark, d):
    """Texts within a size."""
    return maintenance.within_size(table(spark, d, "documents"), "text", 1).select("doc_id")


@query(f"""SELECT DISTINCT file_path, NOT regexp_matches(file_path, '{globs.globs_to_regex(fixed.EXCLUDE_GLOBS).replace("'", "''")}')
 AND regexp_matches(file_path, '{globs.globs_to_regex(fixed.INCLUDE_GLOBS).replace("'", "''")}') AS indexed FROM chunks""")
def glob_filter(spark, d):
    """include and exclude globs over all paths."""
    return chunks(spark, d).select("file_path").distinct().withColumn("indexed", globs.should_index(F.col("file_path")))


@query(f"SELECT DISTINCT file_path, len(list_filter({_list(fixed.BLACKLIST)}, lambda b: contains(file_path, b))) > 0 AND NOT contains(file_path, 'vendors') AS blocked, NOT contains(file_path, '..') AS safe FROM chunks")
def blacklist_filter(spark, d):
    """blacklisted and safe paths."""
    p = F.col("file_path")
    return chunks(spark, d).select("file_path").distinct().select("file_path", globs.blacklisted(p, whitelist=["vendors"]).alias("blocked"), (~p.contains("..")).alias("safe"))


@query("SELECT DISTINCT id FROM chunks WHERE starts_with(file_path, 'src/core/')")
def path_prefix(spark, d):
    """a prefix of paths, pushed into the scan."""
    return chunks(spark, d).where(globs.has_prefix(F.col("file_path"), "src/core/")).select("id").distinct()


@query(f"SELECT len(embedding) AS size, count(*) AS vectors, len(embedding) = {DIM} AS matches FROM chunks WHERE embedding IS NOT NULL GROUP BY len(embedding)")
def dim_check(spark, d):
    """lengths of vectors against the configured one."""
    return maintenance.dimension_check(chunks(spark, d), DIM)


@query("SELECT DISTINCT id FROM chunks WHERE vector_pending")
def pending_vectors(spark, d):
    """Chunks whose vector is still to be made."""
    return maintenance.pending_vectors(chunks(spark, d))


@query(rf"""WITH {ONE}, l AS (SELECT id, chunk_text AS t, list_filter(string_split(chunk_text, chr(10)), lambda s: length(trim(s)) > 0)[1] AS f,
 list_filter(string_split(chunk_text, chr(10)), lambda s: regexp_matches(s, '{fixed.DECLARATION}'))[1] AS d FROM one WHERE chunk_text IS NOT NULL)
SELECT id, substr(CASE WHEN f IS NOT NULL AND regexp_matches(f, '{fixed.DECLARATION}') THEN t WHEN d IS NULL THEN t ELSE trim(d) || chr(10) || '...' || chr(10) || t END, 1, 450) AS preview FROM l""")
def preview(spark, d):
    """previews of all chunks, made in the scan; ids are put together afterwards."""
    rows = chunks(spark, d).select("id", "chunk_text").where(F.col("chunk_text").isNotNull() & F.col("id").isNotNull())
    return rows.select("id", search.preview(F.col("chunk_text")).alias("preview")).dropDuplicates(["id"])


#: Commands made from the log: searches in several forms, some of which an index can't answer.
_SEARCHES = ("grep -rn \"{t}\" {p}", "grep -l '{t}' {p}", "cat {p} | grep \"{t}\"", "git grep \"{t}\" -- {p}", "grep -i \"{t}\" src > {p}", "grep {t} {p}", "ls {p}")
_REMOVALS = ("rm -rf {p}", "rm {p} ./other.ts && ls", "rmdir {p}", "git rm {p}", "git mv {p} moved/{p}", "touch {p}")


def _made(form: str) -> str:
    return "concat('" + form.replace("'", "''").replace("{t}", "', event_type, '").replace("{p}", "', path, '") + "')"


def _filled(form: str):
    return F.replace(F.replace(F.lit(form), F.lit("{t}"), F.col("event_type")), F.lit("{p}"), F.col("path"))


def _commands(spark, d, forms):
    """Each form with type and path of each event, distinct; nulls give none."""
    rows = table(spark, d, "file_events").where(F.col("event_type").isNotNull() & F.col("path").isNotNull())
    return rows.select(F.explode(F.array(*map(_filled, forms))).alias("command")).distinct()


def _commands_sql(forms) -> str:
    return f"SELECT DISTINCT unnest([{', '.join(map(_made, forms))}]) AS c FROM file_events WHERE event_type IS NOT NULL AND path IS NOT NULL"


@query(rf"""SELECT c AS command, NOT (contains(c, 'git grep') OR regexp_matches(c, '\|\s*grep') OR contains(c, '>') OR (contains(c, '-l') AND NOT regexp_matches(c, '(?m)\.({fixed.GREP_ENDS})$')))
 AND (regexp_matches(c, '(?m)\.({fixed.GREP_ENDS})$') OR regexp_matches(c, '(?m)^[^>]*grep\s+[^|]*[''"][^''"]+[''"][^|]*$')) AS is_search, nullif(regexp_extract(c, 'grep\s+(?:-[a-zA-Z]+\s+)*["'']([^"'']+)["'']', 1), '') AS pattern
 FROM ({_commands_sql(_SEARCHES)})""")
def grep_parse(spark, d):
    """grep commands and their patterns, made from the event log."""
    return _commands(spark, d, _SEARCHES).select("command", text.is_code_grep(F.col("command")).alias("is_search"), text.grep_pattern(F.col("command")).alias("pattern"))


@query(rf"""WITH c AS ({_commands_sql(_REMOVALS)}), a AS (SELECT c, unnest(list_concat(regexp_extract_all(c, '(?:^|\s)(?:rm|rmdir)\s+(?:-[rf]+\s+)?([^\n]+)', 1), regexp_extract_all(c, 'git\s+mv\s+([^\n]+)', 1))) AS a FROM c),
p AS (SELECT DISTINCT c, unnest(string_split_regex(a, '[&|;\s]+')) AS path FROM a)
SELECT c AS command, path FROM p WHERE path <> '' AND NOT starts_with(path, '-') AND NOT regexp_matches(path, '^[{{}}|$&<>`]')""")
def deleted_paths(spark, d):
    """paths of rm, rmdir, git rm and git mv commands, made from the event log."""
    return _commands(spark, d, _REMOVALS).select("command", F.explode(text.deleted_paths(F.col("command"))).alias("path"))


# ---- joins and set operations

@query(f"WITH {ONE}, {KNN}, top AS (SELECT id, similarity FROM knn ORDER BY similarity DESC, id LIMIT 20) SELECT id, similarity, file_path, start_line, end_line, chunk_text FROM top JOIN one USING (id)")
def hydrate_join(spark, d):
    """Text fetched for the best ids only."""
    c = chunks(spark, d)
    return search.hydrate(search.knn(c, VECTOR, 20).select("id", "similarity"), c)


@query("SELECT DISTINCT file_path FROM chunks WHERE file_path IS NOT NULL EXCEPT SELECT DISTINCT path FROM file_events WHERE event_type IN ('add', 'change')")
def orphan_files(spark, d):
    """Indexed files that the log doesn't know."""
    tracked = table(spark, d, "file_events").where(F.col("event_type").isin("add", "change")).select(F.col("path").alias("file_path"))
    return maintenance.orphans(chunks(spark, d), tracked)


@query(f"WITH {incremental.MANIFEST_SQL} SELECT c.file_path, c.file_hash FROM (SELECT DISTINCT file_path, lower(file_hash) AS file_hash FROM chunks) c WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.file_path = c.file_path AND m.h = c.file_hash)")
def changed_files(spark, d):
    """F8: stored versions whose hash isn't the one last committed."""
    now = chunks(spark, d).select("file_path", F.lower("file_hash").alias("file_hash")).distinct()
    return maintenance.changed_files(now, incremental.committed_manifest(table(spark, d, "sync_state")))


@query(f"WITH {ONE}, w AS (SELECT id, regexp_extract_all(lower(coalesce(identifiers, '')), '[a-z0-9_$]+') AS i FROM one) SELECT id, len(list_intersect(list_distinct(i), ['value', 'index', 'cache', 'load'])) AS matches FROM w")
def identifier_matches(spark, d):
    """Identifiers shared with a query."""
    rows = chunks(spark, d).where(F.col("id").isNotNull()).select("id", text.shared_identifiers(F.col("identifiers"), ["value", "index", "cache", "load"]).alias("matches"))
    return rows.groupBy("id").agg(F.max("matches").alias("matches"))


# ---- aggregates

@query("WITH o AS (SELECT id, max(file_path) AS file_path FROM chunks GROUP BY id) SELECT count(DISTINCT file_path) AS files, count(*) AS chunks, round(count(*) / greatest(1, count(DISTINCT file_path)), 6) AS mean_chunks FROM o")
def index_stats(spark, d):
    """Files, chunks, chunks per file."""
    return observe.index_stats(chunks(spark, d))


@query("SELECT DISTINCT file_path FROM chunks WHERE file_path IS NOT NULL")
def indexed_files(spark, d):
    """A5."""
    return observe.indexed_files(chunks(spark, d))


@query("SELECT file_path, count(DISTINCT id) AS chunks FROM chunks GROUP BY file_path")
def chunks_per_file(spark, d):
    """A11."""
    return observe.chunks_per_file(chunks(spark, d))


@query("SELECT lower(trim(name)) AS name, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY lower(trim(name))")
def metrics_summary(spark, d):
    """A6, A9, A10."""
    return observe.metrics_summary(table(spark, d, "metrics"))


@query("WITH c AS (SELECT count(*) FILTER (lower(trim(name)) = 'cache_hits') AS hits, count(*) FILTER (lower(trim(name)) = 'cache_misses') AS misses FROM metrics) SELECT hits, misses, round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0 END, 6) AS hit_rate FROM c")
def cache_stats(spark, d):
    """A3, A4."""
    return observe.cache_stats(table(spark, d, "metrics"))


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST LIMIT 500")
def keep_latest(spark, d):
    """The newest rows of a log."""
    return observe.keep_latest(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type"), 500, ["ts", "event_id"])


@query("SELECT id, round(len(chunk_text) / greatest((end_line - start_line) / 1000.0, 0.001), 6) AS per_second FROM (SELECT DISTINCT ON (id) * FROM chunks ORDER BY id)")
def throughput(spark, d):
    """Amount over time with a floor."""
    rows = chunks(spark, d).dropDuplicates(["id"]).select("id", F.length("chunk_text").alias("n"), (F.col("end_line") - F.col("start_line")).alias("ms"))
    return observe.throughput(rows, "n", "ms").select("id", "per_second")


@query("SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda w: length(w) > 1)) AS term FROM documents) GROUP BY doc_id, term")
def term_freq(spark, d):
    """Words of each document."""
    return observe.term_frequencies(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda w: length(w) > 1), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def fts_tokenize(spark, d):
    """E1."""
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.array_join(text.fts_tokens(F.col("text")), " ").alias("tokens"))


@query(f"""WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range({DIM})) AS i FROM embeddings WHERE {USABLE}),
m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), s AS (SELECT label, sqrt(sum(x * x)) AS s FROM m GROUP BY label)
SELECT label, i::INT AS i, round(x / s, 6) AS x FROM m JOIN s USING (label)""")
def mean_pool(spark, d):
    """Centroids by label."""
    return observe.mean_pool(table(spark, d, "embeddings"), "label", "embedding", DIM).select("label", F.posexplode("pooled").alias("i", "x"))


# ---- scalar functions

#: UTF-16 units of a text.
_UNITS = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55232 + (unicode(c)::BIGINT >> 10), 56320 + (unicode(c)::BIGINT & 1023)] ELSE [unicode(c)::BIGINT] END))"
_DJB = f"list_reduce(list_prepend(5381::BIGINT, {_UNITS}), lambda h, c: xor((h * 33) & 4294967295, c))"


@query(f"SELECT doc_id, CASE WHEN text = '' THEN 5381 ELSE {_DJB.format('text')} END AS h FROM documents WHERE text IS NOT NULL")
def djb2a_hash(spark, d):
    """X1, over whole texts."""
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", scalar.djb2a(F.col("text")).alias("h"))


@query(f"""WITH c AS (SELECT doc_id, {_UNITS.format('text')} AS c FROM documents WHERE text <> '')
SELECT doc_id, printf('%08x', list_reduce(list_prepend(2216829733::BIGINT, c), lambda h, c: xor((h * 16777619) & 4294967295, c >> 8))) || printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, c), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS h FROM c""")
def file_hash(spark, d):
    """X2, over whole texts."""
    return table(spark, d, "documents").where(F.col("text") != "").select("doc_id", scalar.file_hash(F.col("text")).alias("h"))


#: Length of the reference vectors.
_LONG_DIM = 768
_POWERS = [pow(16807, i + 1, 2147483647) for i in range(_LONG_DIM)]


@query(f"""WITH s AS (SELECT doc_id, ({_DJB.format('text')}) % 2147483647 AS r FROM documents WHERE text <> ''), n AS (SELECT doc_id, CASE WHEN r = 0 THEN 1 ELSE r END AS seed FROM s),
v AS (SELECT doc_id, list_transform({_POWERS}::BIGINT[], lambda p: ((seed * p) % 2147483647 / 2147483647.0::DOUBLE * 2 - 1)::FLOAT) AS v FROM n),
z AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda y: y::DOUBLE * y::DOUBLE))) AS z FROM v)
SELECT doc_id, len(v)::INT AS size, round(v[1] / z, 5) AS first, round(v[768] / z, 5) AS last, md5(array_to_string(list_transform(v, lambda x: round((x / z)::FLOAT::DOUBLE * 10000)::BIGINT), ',')) AS digest FROM z""")
def placeholder_embedding(spark, d):
    """Vectors made from hashes of whole texts: length, ends, and a digest of all numbers to four decimals."""
    rows = table(spark, d, "documents").where(F.col("text") != "").select("doc_id", scalar.placeholder_embedding(F.col("text"), _LONG_DIM).alias("v"))
    digest = F.md5(F.array_join(F.transform("v", lambda x: F.round(x.cast("double") * 10000).cast("bigint").cast("string")), ",").cast("binary"))
    end = lambda i: F.round(F.element_at("v", i).cast("double"), 5)
    return rows.select("doc_id", F.size("v").alias("size"), end(1).alias("first"), end(-1).alias("last"), digest.alias("digest"))


@query("SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 9))) AS x FROM embeddings")
def l2_normalize(spark, d):
    """X6."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(scalar.l2_normalize(F.col("embedding"))).alias("i", "x")).withColumn("x", F.round("x", 9))


@query("SELECT doc_id, ceil(length(text) / 3.0)::BIGINT AS tokens FROM documents")
def estimate_tokens(spark, d):
    """X8."""
    return table(spark, d, "documents").select("doc_id", scalar.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, md5(substr(text, 1, 150)) AS cut, md5(substr(text, 1, 153)) AS context FROM documents")
def truncate_tokens(spark, d):
    """Beginnings of texts by tokens and by context, as digests."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(scalar.truncate_tokens(t, 50).cast("binary")).alias("cut"), F.md5(scalar.truncate_to_context(t, 64).cast("binary")).alias("context"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 100.0::DOUBLE)), 6) AS s FROM events")
def sigmoid(spark, d):
    """X11."""
    return table(spark, d, "events").select("event_id", F.round(scalar.sigmoid(F.col("value") / 100.0), 6).alias("s"))


_CAMEL = "list_filter(string_split_regex(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_-]+'), lambda p: p <> '')"
_NAMES = "SELECT DISTINCT unnest(regexp_extract_all(chunk_text, '[a-zA-Z_$][a-zA-Z0-9_$]*')) AS name FROM chunks"


def _names(spark, d):
    return chunks(spark, d).select(F.explode(F.regexp_extract_all("chunk_text", F.lit("[a-zA-Z_$][a-zA-Z0-9_$]*"), F.lit(0))).alias("name")).distinct()


@query(f"SELECT name, array_to_string({_CAMEL.format('name')}, ' ') AS parts FROM ({_NAMES})")
def split_camel(spark, d):
    """Parts of all names in the code."""
    return _names(spark, d).select("name", F.array_join(text.split_camel(F.col("name")), " ").alias("parts"))


@query(f"""WITH p AS (SELECT name, list_transform({_CAMEL.format('name')}, lambda p: lower(p)) AS l FROM ({_NAMES})),
k AS (SELECT name, l, list_filter(l, lambda p: NOT list_contains({_list(fixed.VARIANT_STOPWORDS)}, p)) AS k FROM p WHERE len(l) >= 2),
u AS (SELECT name, CASE WHEN len(k) >= 2 THEN k ELSE l END AS u FROM k),
c AS (SELECT name, u, list_transform(u, lambda p: upper(substr(p, 1, 1)) || substr(p, 2)) AS t FROM u)
SELECT name, array_to_string(list_sort(list_distinct([array_to_string(u, ' '), u[1] || array_to_string(t[2:], ''), array_to_string(u, '_'), u[1] || t[2], u[-2] || t[-1]])), '|') AS variants FROM c""")
def identifier_variants(spark, d):
    """Ways to write all names of several parts."""
    rows = _names(spark, d).select("name", text.variant_columns(text.split_camel(F.col("name"))).alias("variants"))
    return rows.where(F.size("variants") > 0).select("name", F.array_join(F.array_sort("variants"), "|").alias("variants"))


_SYN = ", ".join(f"'{k}': {_list(v)}" for k, v in fixed.SYNONYMS.items())


@query(f"""WITH w AS ({_NAMES}), s AS (SELECT name, lower(name) AS l, MAP {{{_SYN}}} AS m, list_transform({_CAMEL.format('name')}, lambda p: lower(p)) AS p FROM w),
k AS (SELECT *, list_filter(p, lambda x: NOT list_contains({_list(fixed.VARIANT_STOPWORDS)}, x)) AS k FROM s),
u AS (SELECT *, CASE WHEN len(k) >= 2 THEN k ELSE p END AS u FROM k), t AS (SELECT *, list_transform(u, lambda x: upper(substr(x, 1, 1)) || substr(x, 2)) AS t FROM u)
SELECT name, array_to_string(list_sort(list_distinct(list_concat([l], coalesce(m[l], []), list_filter(p, lambda x: length(x) > 2),
 CASE WHEN len(p) >= 2 THEN [array_to_string(u, ' '), u[1] || array_to_string(t[2:], ''), array_to_string(u, '_'), u[1] || t[2], u[-2] || t[-1]] ELSE [] END))), '|') AS terms FROM t""")
def expand_query(spark, d):
    """All names with their synonyms, parts and variants."""
    return _names(spark, d).select("name", F.array_join(F.array_sort(text.expand_columns(F.col("name"))), "|").alias("terms"))


@query("SELECT item_id, CASE WHEN len(w) = 0 THEN '' WHEN len(w) <= 6 THEN array_to_string(list_transform(w, lambda x: x || '*'), ' AND ') ELSE array_to_string(list_transform(w, lambda x: x || '*'), ' OR ') END AS q FROM (SELECT item_id, list_filter(string_split_regex(regexp_replace(prompt, '[:\"()''*+\\-^~]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2) AS w FROM eval_items)")
def fts_prefix_query(spark, d):
    """Prefix queries of all prompts."""
    return table(spark, d, "eval_items").select("item_id", text.prefix_query_column(F.col("prompt")).alias("q"))


_FOUND = " ".join(["list_concat("] + [f"regexp_extract_all(chunk_text, '{p.replace(chr(39), chr(39) * 2)}', 1), " for p in fixed.IDENTIFIER_PATTERNS]).rstrip(", ") + ")"


@query(f"WITH {ONE} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_FOUND}, lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains({_list(fixed.KEYWORDS)}, x)))), '|') AS identifiers FROM one WHERE chunk_text IS NOT NULL")
def extract_identifiers(spark, d):
    """Identifiers of all chunks."""
    rows = chunks(spark, d).select("id", "chunk_text").where(F.col("chunk_text").isNotNull() & F.col("id").isNotNull())
    return rows.select("id", F.array_join(F.array_sort(text.extract_identifiers(F.col("chunk_text"))), "|").alias("identifiers")).dropDuplicates(["id"])


_MULT = ", ".join(f"'{k}': {v}" for k, v in fixed.FILE_TYPE_MULTIPLIERS.items())


@query(f"SELECT DISTINCT file_path, coalesce((MAP {{{_MULT}}})[lower(string_split(file_path, '.')[-1])], 1.0)::DOUBLE AS weight FROM chunks")
def file_type_multiplier(spark, d):
    """E9."""
    return chunks(spark, d).select("file_path").distinct().withColumn("weight", scalar.file_type_multiplier(F.col("file_path")))


_BM25TF = """WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9]+'), lambda w: length(w) > 1) AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS dl FROM t WHERE len(w) > 0), m AS (SELECT avg(dl) AS mean FROM n),
s AS (SELECT doc_id, list_sum(list_transform(['index', 'cache', 'index'], lambda q: ln(1 + 2.5 * len(list_filter(w, lambda x: x = q)) / (1.5 * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean) + len(list_filter(w, lambda x: x = q)))))) AS score FROM n, m),
r AS (SELECT doc_id, round(score, 6) AS score FROM s WHERE round(score, 6) > 0)"""


@query(f"{_BM25TF} SELECT doc_id, score, round(least(1.0, score / (SELECT max(score) FROM r)), 6) AS norm FROM r")
def bm25_tf(spark, d):
    """The variant without idf, and its normal form."""
    return observe.normalize_scores(observe.bm25_tf(table(spark, d, "documents"), "doc_id", "text", "index cache index"))


@query("SELECT id, round(1 / (60.0 + rv) + 1 / (60.0 + rb), 9) AS s, round(1 + rv % 3 * 0.5::DOUBLE, 6) AS boost FROM (SELECT id, chunk_index AS rv, start_line AS rb FROM (SELECT DISTINCT ON (id) * FROM chunks ORDER BY id))")
def rrf_plain(spark, d):
    """Reciprocal ranks of two numbers, and the boost."""
    rows = chunks(spark, d).dropDuplicates(["id"])
    return rows.select("id", F.round(scalar.rrf([F.col("chunk_index"), F.col("start_line")]), 9).alias("s"), F.round(scalar.identifier_boost(F.col("chunk_index") % 3), 6).alias("boost"))


@query()
def wordpiece(spark, d):
    """Pieces of all documents with a small vocabulary."""
    vocabulary = tokenizers.char_vocabulary("the index cache token value line chunk file vector every".split())
    return table(spark, d, "documents").select("doc_id", tokenizers.wordpiece_column(F.col("text"), vocabulary).alias("ids"))


@query()
def bpe(spark, d):
    """Merges of all documents with a few ranks."""
    ranks = {pair: i for i, pair in enumerate([("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), (" ", "the"), ("in", "g")])}
    return table(spark, d, "documents").select("doc_id", tokenizers.bpe_column(F.col("text"), ranks).alias("pieces"))


# ---- chunking

def _kind_sql(line: str, end: str) -> str:
    q = lambda p: p.replace("'", "''")
    js = [f"WHEN regexp_matches({line}, '{q(p)}') THEN 'function'" for p in fixed.JS_FUNCTIONS]
    js += [f"WHEN regexp_matches({line}, '{q(fixed.JS_CLASS)}') THEN 'class'", f"WHEN regexp_matches({line}, '{q(fixed.JS_INTERFACE)}') THEN 'interface'"]
    js += [f"WHEN regexp_matches({line}, '{q(p)}') THEN CASE WHEN contains({line}, 'interface') THEN 'interface' WHEN contains({line}, 'class') THEN 'class' ELSE 'other' END" for p in fixed.JS_OTHER]
    arms = [f"WHEN list_contains({_list(fixed.JS_ENDS)}, {end}) THEN CASE {' '.join(js)} END"]
    for ends, patterns in fixed.LANGUAGE_PATTERNS.items():
        arms.append(f"WHEN list_contains({_list(ends)}, {end}) THEN CASE " + " ".join(f"WHEN regexp_matches({line}, '{q(p)}') THEN '{k}'" for k, p in patterns) + " END")
    return f"coalesce(CASE {' '.join(arms)} END, CASE WHEN regexp_matches({line}, '{fixed.IMPORT}') THEN 'import' WHEN regexp_matches({line}, '{fixed.COMMENT}') THEN 'comment' END)"


_LINES = f"{ONE}, l AS (SELECT id, lower(string_split(file_path, '.')[-1]) AS e, unnest(string_split(chunk_text, chr(10))) AS line, unnest(range(len(string_split(chunk_text, chr(10))))) AS line_no FROM one WHERE chunk_text IS NOT NULL), k AS (SELECT id, line_no, line, {_kind_sql('line', 'e')} AS kind FROM l)"


@query(f"WITH {_LINES} SELECT id, line_no::INT AS line_no, kind FROM k WHERE kind IS NOT NULL")
def boundaries(spark, d):
    """Where something begins, in all chunks."""
    return chunking.boundaries(chunks(spark, d).where(F.col("id").isNotNull()), "id", "file_path", "chunk_text").distinct()


_SEGMENTS = f"""WITH {_LINES}, g AS (SELECT id, line_no, line, greatest(sum(CASE WHEN kind IN ('function', 'class', 'interface') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) - 1, 0) AS segment FROM k),
s AS (SELECT id, segment::INT AS segment, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g GROUP BY id, segment)"""


@query(f"{_SEGMENTS} SELECT id, segment, start_line, end_line, md5(text) AS text FROM s WHERE regexp_matches(text, '\\S')")
def semantic_chunks(spark, d):
    """Chunks cut before their functions, classes and interfaces."""
    s = chunking.segments(chunks(spark, d).where(F.col("id").isNotNull()), "id", "file_path", "chunk_text")
    return s.select("id", "segment", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("text")).distinct()


@query()
def token_chunks(spark, d):
    """Chunks cut at their units, what is too large by size with overlapping lines, as files of their own; documents by size alone."""
    code = chunking.chunk_files(chunks(spark, d).where(F.col("id").isNotNull()), "id", "file_path", "chunk_text", 128, 32, 512).distinct()
    prose = chunking.chunk_files(table(spark, d, "documents").withColumn("path", F.lit(None).cast("string")), "doc_id", "path", "text", 128, 32, 512, by_size_only=True)
    return code.withColumn("kind", F.lit("chunk")).unionByName(prose.withColumnRenamed("doc_id", "id").withColumn("kind", F.lit("document")))


@query("SELECT DISTINCT id, CASE WHEN start_line < 0 THEN 'negative start' WHEN end_line < start_line THEN 'end before start' WHEN NOT coalesce(regexp_matches(chunk_text, '\\S'), false) THEN 'blank text' END AS problem FROM chunks WHERE start_line < 0 OR end_line < start_line OR NOT coalesce(regexp_matches(chunk_text, '\\S'), false)")
def validate_chunks(spark, d):
    """C6, F9."""
    return chunking.invalid_chunks(chunks(spark, d))


# ---- search

@query(f"WITH {ONE}, {KNN} SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM knn QUALIFY rank <= 20")
def knn_exact(spark, d):
    """Exact nearest chunks."""
    return search.knn(chunks(spark, d), VECTOR, 20)


@query()
def knn_approx(spark, d):
    """Nearest chunks from the kept index, out of the cells next to the query."""
    return indexed(spark, d).knn(VECTOR, 20, exact=False).drop("seg")


@query(f"WITH {ONE}, {KNN} SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM knn WHERE starts_with(file_path, 'src/') QUALIFY rank <= 10")
def knn_filtered(spark, d):
    """V3: nearest chunks under a path."""
    return search.knn(chunks(spark, d), VECTOR, 10, "src/")


@query(f"WITH {ONE}, {KNN}, r AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM knn) SELECT * FROM r WHERE rank <= 10 AND similarity >= 0.3")
def vector_search(spark, d):
    """Nearest chunks above a threshold."""
    return search.vector_search(chunks(spark, d), VECTOR, 10, 0.3)


@query(f"""WITH {ONE}, w AS (SELECT id, list_filter(string_split_regex(lower(concat_ws(' ', file_path, chunk_text, identifiers)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM one)
SELECT term, id, count(*) AS tf, dl FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY term, id, dl""")
def postings(spark, d):
    """The inverted index."""
    return indexed(spark, d).postings().select("term", "id", "tf", "dl")


_PHRASES = list(dict.fromkeys(tuple(w) for p in text.query_phrases(QUERY) if (w := text.phrase_words(p))))
_PATTERNS = [" " + "  ".join(p) + " " for p in _PHRASES]
_WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _bm_sql(words: str, patterns: list[str]) -> str:
    """Ranked keyword search for phrases; ``words`` turns the words of a column into what is compared. No phrase spans two columns."""
    columns = [words.replace("{0}", _WORDS.format(c)) for c in ("file_path", "chunk_text", "identifiers")]
    joined = " || '|' || ".join(f"' ' || array_to_string({c}, '  ') || ' '" for c in columns)
    return f"""jj AS (SELECT id, file_path, start_line, {' + '.join(f'len({c})' for c in columns)} AS dl, {joined} AS j FROM one),
ph AS (SELECT unnest({_list(patterns)}) AS p), tf AS (SELECT id, p, dl, (length(j) - length(replace(j, p, ''))) // length(p) AS tf FROM jj, ph),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM jj WHERE dl > 0), df AS (SELECT p, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY p),
bs AS (SELECT id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS similarity, sum(tf) AS hits FROM tf JOIN df USING (p), st GROUP BY id),
bm AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id)::INT AS rank FROM bs WHERE hits > 0)"""


_BM = _bm_sql("{0}", _PATTERNS)


@query(f"WITH {ONE}, {_BM} SELECT * FROM bm WHERE rank <= 20")
def bm25_search(spark, d):
    """Keyword search by phrases."""
    return indexed(spark, d).bm25(QUERY, 20, stemmed=False).drop("seg")


@query(f"WITH {ONE}, {_BM} SELECT id, similarity, rank, file_path, start_line, 'keyword search' AS note FROM bm JOIN one USING (id) WHERE rank <= 10")
def fts_only(spark, d):
    """Keyword search alone, with a note."""
    found = search.keyword_search(indexed(spark, d), QUERY, 10, stemmed=False)
    return found.select("id", "similarity", "rank", "file_path", "start_line", F.lit("keyword search").alias("note"))


#: Words of one family, written down by hand: what a stemmer has to bring together.
_FAMILIES = {
    "const": "const consts", "value": "value values valued valuing valus", "val": "val vals", "load": "load loads loaded loading", "loadindex": "loadindex", "index": "index indexes indexed indexing", "cache": "cache caches cached caching",
    "result": "result results resulted resulting", "data": "data datas", "memoize": "memoize memoizes memoized memoizing", "store": "store stores stored storing", "memory": "memory memories",
}
_FORMS = {w: f for f, ws in _FAMILIES.items() for w in ws.split()}
_STEMMED = list(dict.fromkeys(" " + "  ".join(_FORMS[w] for w in p) + " " for p in _PHRASES))


@query(f"""WITH {ONE}, {_bm_sql("list_transform({0}, lambda w: coalesce((MAP {" + ", ".join(f"'{w}': '{f}'" for w, f in _FORMS.items()) + "})[w], w))", _STEMMED)} SELECT * FROM bm WHERE rank <= 20""")
def bm25_stemmed(spark, d):
    """Keyword search by phrases of stems, from the kept index."""
    return indexed(spark, d).bm25(QUERY, 20).drop("seg")


@query(f"""WITH {ONE}, h AS (SELECT id, file_path, start_line, end_line, chunk_text FROM one WHERE contains(lower(chunk_text), '{LITERAL}') ORDER BY file_path, start_line, id LIMIT 20),
l AS (SELECT *, string_split(chunk_text, chr(10)) AS l FROM h),
k AS (SELECT *, list_filter(range(len(l)), lambda i: len(list_filter(range(greatest(0, i - 2), least(len(l), i + 3)), lambda j: contains(lower(l[j + 1]), '{LITERAL}'))) > 0) AS k FROM l)
SELECT id, file_path, start_line, end_line, 1.0::DOUBLE AS similarity, CASE WHEN len(k) = 0 THEN chunk_text ELSE array_to_string(list_transform(k, lambda i: CASE WHEN i > k[1] AND NOT list_contains(k, i - 1) THEN '...' || chr(10) ELSE '' END || l[i + 1]), chr(10)) END AS preview FROM k""")
def literal_search(spark, d):
    """Chunks that hold a text, with lines around it."""
    return search.literal_search(chunks(spark, d), LITERAL, 20)


_FUSED = f"""vr AS (SELECT id, file_path, start_line, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM knn QUALIFY rank <= 20),
br AS (SELECT bm.id, file_path, start_line, rank FROM bm JOIN one USING (id) WHERE rank <= 20),
v AS (SELECT file_path, start_line, max(rank) AS vector_rank, max_by(id, rank) AS v_id FROM vr GROUP BY ALL), b AS (SELECT file_path, start_line, max(rank) AS word_rank, min_by(id, rank) AS b_id FROM br GROUP BY ALL),
f AS (SELECT coalesce(v_id, b_id) AS id, vector_rank, word_rank, coalesce(0.4::DOUBLE / (60 + vector_rank), 0) + coalesce(0.3::DOUBLE / (60 + word_rank), 0) AS rrf FROM v FULL OUTER JOIN b USING (file_path, start_line))"""


@query(f"WITH {ONE}, {KNN}, {_BM}, {_FUSED} SELECT id, vector_rank::INT AS vector_rank, word_rank::INT AS word_rank, round(rrf, 9) AS rrf FROM f")
def rrf_fusion(spark, d):
    """Two ranked lists in a full outer join."""
    f = search.fuse(search.both_lists(indexed(spark, d), QUERY, VECTOR, 20, None, stemmed=False))
    return f.select("id", "vector_rank", "word_rank", F.round("rrf", 9).alias("rrf"))


_HYBRID = f"""WITH {ONE}, {KNN}, {_BM}, {_FUSED},
x AS (SELECT f.*, o.file_path, o.start_line, o.end_line, o.chunk_text, list_distinct(list_filter(list_transform({_FOUND}, lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains({_list(fixed.KEYWORDS)}, x))) AS ids FROM f JOIN one o USING (id)),
s AS (SELECT *, rrf * (1 + len(list_intersect(ids, {_list(text.identifiers_of(QUERY))})) * 0.5) * coalesce((MAP {{{_MULT}}})[lower(string_split(file_path, '.')[-1])], 1.0)::DOUBLE * 0.3 AS score FROM x),
n AS (SELECT *, round(CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE 0 END, 6) AS similarity FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vector_rank NULLS LAST, word_rank NULLS LAST, id)::INT AS rank FROM n WHERE similarity >= 0.35)"""


@query(f"{_HYBRID} SELECT id, file_path, start_line, end_line, similarity, rank FROM r WHERE rank <= 10")
def hybrid_search(spark, d):
    """Fused search."""
    return search.hybrid_search(indexed(spark, d), QUERY, VECTOR, 10, stemmed=False).drop("chunk_text")


def _rerank_sql() -> str:
    import re

    words = [w for w in re.sub(r"[^\w\s]", " ", QUERY.lower()).split() if len(w) > 2]
    parts = QUERY.lower().split()
    found = " + ".join(f"contains(t, '{w}')::INT" for w in words)
    some = " + ".join(f"contains(t, '{w}')::INT" for w in parts if len(w) > 3)
    return f"""{_HYBRID}, t AS (SELECT id, rank, similarity, lower(chunk_text) AS t, list_distinct(list_filter(string_split_regex(regexp_replace(lower(chunk_text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)) AS w, count(*) OVER () AS total FROM r WHERE rank <= 10),
q AS (SELECT id, rank, similarity, round(len(list_intersect(w, {_list(dict.fromkeys(words))})) / {float(len(set(words)))} * 0.25::DOUBLE + ({found}) / {float(len(words))}::DOUBLE * 0.25::DOUBLE + CASE WHEN contains(t, '{QUERY.lower()}') THEN 1.0 ELSE ({some}) / {float(len(parts))}::DOUBLE END * 0.2::DOUBLE + similarity * 0.15::DOUBLE + CASE WHEN total <= 1 THEN 1.0 ELSE 1 - (rank - 1) / total * 0.5::DOUBLE END * 0.05::DOUBLE, 6) AS rerank_score FROM t)
SELECT id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, rank)::INT AS new_rank FROM q"""


@query(_rerank_sql())
def heuristic_rerank(spark, d):
    """The fused results in a new order."""
    return search.heuristic_rerank(search.hybrid_search(indexed(spark, d), QUERY, VECTOR, 10, stemmed=False), QUERY).select("id", "rerank_score", "new_rank")


def length_scorer(query: str, texts: list[str]) -> list[float]:
    """A stand-in for a pair model: shared words over the root of the length."""
    words = set(query.lower().split())
    return [sum(w in t.lower() for w in words) / (1 + len(t)) ** 0.5 for t in texts]


@query(f"""{_HYBRID}, t AS (SELECT id, rank, substr(chunk_text, 1, 1536) AS t FROM r WHERE rank <= 10),
q AS (SELECT id, rank, round(1 / (1 + exp(-({" + ".join(f"contains(lower(t), '{w}')::INT" for w in sorted(set(QUERY.lower().split())))}) / sqrt(1 + length(t)))), 6) AS rerank_score FROM t)
SELECT id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, rank)::INT AS new_rank FROM q""")
def cross_rerank(spark, d):
    """R2: the fused results by a pair scorer."""
    return search.cross_rerank(search.hybrid_search(indexed(spark, d), QUERY, VECTOR, 10, stemmed=False), QUERY, length_scorer).select("id", "rerank_score", "new_rank")


@query(f"""{_HYBRID}, m AS (SELECT rank, file_path, start_line || '-' || end_line AS lines, printf('%.3f', similarity) AS similarity, list_filter(string_split(chunk_text, chr(10)), lambda s: length(trim(s)) > 0)[1] AS f,
 list_filter(string_split(chunk_text, chr(10)), lambda s: regexp_matches(s, '{fixed.DECLARATION}'))[1] AS d, chunk_text AS t FROM r WHERE rank <= 10),
p AS (SELECT rank, {{'file': file_path, 'lines': lines, 'similarity': similarity, 'preview': substr(CASE WHEN f IS NOT NULL AND regexp_matches(f, '{fixed.DECLARATION}') THEN t WHEN d IS NULL THEN t ELSE trim(d) || chr(10) || '...' || chr(10) || t END, 1, 450)}} AS m FROM m)
SELECT to_json({{'query': '{QUERY}', 'mode': 'hybrid', 'matches': list(m ORDER BY rank)}})::VARCHAR AS json FROM p""")
def to_json_results(spark, d):
    """Results as JSON."""
    return search.as_json(search.hybrid_search(indexed(spark, d), QUERY, VECTOR, 10, stemmed=False), QUERY, "hybrid")


# ---- maintenance and streams

_KEEP = "id, file_path, chunk_index, file_hash"


@query(f"""WITH cur AS (SELECT DISTINCT ON (file_path) file_path, lower(file_hash) AS newest FROM chunks WHERE file_path IS NOT NULL ORDER BY file_path, coalesce(updated_at, TIMESTAMPTZ '0001-01-01 00:00:00+00') DESC, lower(file_hash) DESC NULLS LAST),
v AS (SELECT {_KEEP}, c.file_path IS NOT NULL AND lower(file_hash) IS NOT DISTINCT FROM newest AS is_new FROM chunks c LEFT JOIN cur USING (file_path)), changed AS (SELECT DISTINCT file_path FROM v WHERE NOT is_new AND file_path IS NOT NULL),
new AS (SELECT {_KEEP} FROM v WHERE is_new AND file_path IN (SELECT file_path FROM changed)), old AS (SELECT {_KEEP} FROM v WHERE NOT is_new OR file_path NOT IN (SELECT file_path FROM changed))
SELECT {_KEEP}, 'old' AS origin FROM old WHERE file_path IS NULL OR file_path NOT IN (SELECT file_path FROM new) UNION ALL SELECT {_KEEP}, 'new' AS origin FROM new""")
def upsert_chunks(spark, d):
    """The older versions of changed files replaced by the newest, over the whole table."""
    rows = chunks(spark, d).select("id", "file_path", "chunk_index", "file_hash", "updated_at")
    newest = incremental.current_versions(rows).withColumnRenamed("file_hash", "newest")
    is_new = F.col("file_path").isNotNull() & F.lower("file_hash").eqNullSafe(F.col("newest"))
    v = rows.join(newest, "file_path", "left").withColumn("is_new", is_new)
    changed = v.where(~F.col("is_new")).select("file_path").distinct().withColumn("changed", F.lit(True))
    v = v.join(changed, "file_path", "left").withColumn("is_new", F.col("is_new") & F.col("changed").isNotNull())
    of = lambda rows, origin: rows.select("id", "file_path", "chunk_index", "file_hash", F.lit(origin).alias("origin"))
    return maintenance.upsert_chunks(of(v.where(~F.col("is_new")), "old"), of(v.where("is_new"), "new"))


@query(f"SELECT {_KEEP} FROM chunks WHERE file_path NOT IN (SELECT path FROM file_events WHERE event_type = 'unlink' AND path IS NOT NULL)")
def delete_files(spark, d):
    """Chunks of removed files dropped."""
    gone = table(spark, d, "file_events").where(F.col("event_type") == "unlink").select(F.col("path").alias("file_path"))
    return maintenance.delete_files(chunks(spark, d).select("id", "file_path", "chunk_index", "file_hash"), gone)


@query(f"""WITH {incremental.MANIFEST_SQL}, l AS (SELECT path AS file_path, event_type FROM file_events WHERE path IS NOT NULL AND event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC NULLS LAST, event_type DESC) = 1),
b AS (SELECT DISTINCT c.file_path, c.id, strlen(coalesce(c.chunk_text, '')) AS bytes FROM chunks c JOIN cur ON c.file_path = cur.file_path AND lower(c.file_hash) IS NOT DISTINCT FROM cur.h),
n AS (SELECT file_path, sum(bytes) AS size FROM b GROUP BY file_path)
SELECT l.file_path, CASE WHEN event_type = 'unlink' OR n.file_path IS NULL THEN 'delete' WHEN n.size / 1024.0 > 16 THEN 'too_big' WHEN cur.h = m.h THEN 'unchanged' ELSE 'upsert' END AS action
FROM l LEFT JOIN n USING (file_path) LEFT JOIN cur USING (file_path) LEFT JOIN manifest m USING (file_path)""")
def incremental_sync(spark, d):
    """K7, K2, F8: what a batch of events asks for, of each file's newest version against the committed hash."""
    now = incremental.current_files(chunks(spark, d))
    return maintenance.plan_sync(table(spark, d, "file_events"), now, incremental.committed_manifest(table(spark, d, "sync_state")), 16)


@query(f"""WITH {incremental.MANIFEST_SQL}
SELECT file_path, 'reindex' AS action FROM cur WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.file_path = cur.file_path AND m.h = cur.h)
UNION ALL SELECT DISTINCT file_path, 'delete' AS action FROM manifest WHERE file_path NOT IN (SELECT file_path FROM cur)""")
def diff_sync(spark, d):
    """K8: differences between what exists and what was committed."""
    now = incremental.current_versions(chunks(spark, d))
    return maintenance.diff_sync(now, incremental.committed_manifest(table(spark, d, "sync_state")))


_CLEAN = "c AS (SELECT lower(trim(event_type)) AS event_type, regexp_replace(regexp_replace(path, '\\\\', '/', 'g'), '^(?:\\./)+', '') AS path, ts FROM file_events WHERE lower(trim(event_type)) IN ('add', 'change', 'unlink') AND path IS NOT NULL AND path <> '' AND ts IS NOT NULL)"


@query(f"""WITH {_CLEAN}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS first FROM c WHERE path <> ''),
s AS (SELECT *, sum(first) OVER (PARTITION BY path ORDER BY ts) AS s FROM g)
SELECT path, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS ended, count(*) AS events, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS event_types FROM s GROUP BY path, s""")
def debounce_sessions(spark, d):
    """K3: bursts of each path's events."""
    b = ev.bursts(ev.clean_events(table(spark, d, "file_events")), "10 minutes")
    return b.select("path", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events", F.array_join("event_types", "|").alias("event_types"))


@query(f"""WITH {_CLEAN}, t AS (SELECT DISTINCT ts FROM c), g AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 60 SECOND THEN 0 ELSE 1 END AS first FROM t),
s AS (SELECT ts, sum(first) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), b AS (SELECT ts, min(ts) OVER (PARTITION BY s) AS batch FROM s)
SELECT DISTINCT epoch_us(batch) AS batch, event_type, path FROM c JOIN b USING (ts)""")
def debounced_batches(spark, d):
    """K3, K5: batches over all paths, each event once per batch."""
    return ev.debounced_batches(ev.clean_events(table(spark, d, "file_events")), 60).withColumn("batch", F.unix_micros("batch"))


Q["p3_found"], SQL["p3_found"] = incremental.p3_found, incremental.P3_SQL


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict:
    return dict(SQL)
