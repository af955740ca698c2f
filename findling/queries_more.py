"""More named queries: texts of pages and mark-up, changes of state, orders of results, rules of settings, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findling.functions import filetypes as T, paths as P, text as X
from findling.operators import embedding as E, folders as FO, fusion as FU, passages as PA, state as ST
from findling.queries import ORACLES, _NAMES, _SUFFIX, _VALID, _names, query
from findling.session import table
from findling.streaming import watch as WA

_K = r"lower(replace(path, '/', '\'))"


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return FO.valid_files(table(spark, sf, "files"))


# texts


@query
def clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages' texts as pages are cleaned."""
    p = table(spark, sf, "passages").where("text is not null")
    return p.select("file_id", "chunk", "indexed_at", F.md5(X.clean_page(F.col("text"))).alias("h")).distinct()


ORACLES["clean_pages"] = r"""
SELECT DISTINCT file_id, chunk, indexed_at, md5(regexp_replace(regexp_replace(text, '\x02\r?\n?', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}]', ' ', 'g')) AS h
FROM passages WHERE text IS NOT NULL"""


def _page(text):
    """Documents as web pages, with a script, a style, entities and blocks."""
    t = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<html><head><title>no</title></head><BODY class='a'><script>x < 1;\n</script><p>"), t, F.lit("</p><style>p {}</style><li>one&nbsp;&ouml;</li></body></html>"))


_PAGE_SQL = r"""'<html><head><title>no</title></head><BODY class=''a''><script>x < 1;' || chr(10) || '</script><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p><style>p {}</style><li>one&nbsp;&ouml;</li></body></html>'"""
_STRIPPED = r"""replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', chr(160)), '&ouml;', 'ö'), '&amp;', '&')"""


@query
def stripped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents put into mark-up and taken out of it."""
    docs = table(spark, sf, "documents").where(~F.contains("text", F.lit("&")))
    return docs.select("doc_id", F.md5(X.strip_html(_page(F.col("text")))).alias("h"))


ORACLES["stripped_pages"] = f"SELECT doc_id, md5({_STRIPPED.format('page')}) AS h FROM (SELECT doc_id, {_PAGE_SQL} AS page FROM documents WHERE NOT contains(text, '&'))"


@query
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same, line by line: the words that come out, in order."""
    docs = table(spark, sf, "documents").where(~F.contains("text", F.lit("&")))
    lines = X.html_lines(_page(F.col("text")))
    return docs.select("doc_id", F.size(F.split(lines, "\n")).alias("lines"), F.md5(F.array_join(F.regexp_extract_all(lines, F.lit(r"([A-Za-z0-9]+)"), 1), " ")).alias("h"))


ORACLES["page_lines"] = r"""
WITH d AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ') AS w, regexp_matches(text, '[^\s\x{a0}]') AS ink FROM documents WHERE NOT contains(text, '&'))
SELECT doc_id, (CASE WHEN ink THEN 3 ELSE 2 END)::INT AS lines, md5(CASE WHEN w = '' THEN 'one' ELSE w || ' one' END) AS h FROM d"""


@query
def highlighted_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with two words marked."""
    docs = table(spark, sf, "documents").where("title is not null")
    return docs.select("doc_id", X.highlight(F.col("title"), ["re", "vertrag"]).alias("marked"))


ORACLES["highlighted_titles"] = r"SELECT doc_id, regexp_replace(title, '(?i)(^|[^\p{L}\p{N}])(vertrag|re)', '\1<mark>\2</mark>', 'g') AS marked FROM documents WHERE title IS NOT NULL"


@query
def format_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Extensions as settings keep them."""
    e = _names(spark, sf).select(P.suffix(F.col("path")).alias("ext")).unionByName(spark.createDataFrame([(x,) for x in (" .PDF", "txt", "..md", ".a b", "", ".toolongforakeyname")], "ext string")).distinct()
    return e.select("ext", T.format_key(F.col("ext")).alias("key"))


ORACLES["format_keys"] = rf"""
WITH {_NAMES}, e AS (SELECT {_SUFFIX} AS ext FROM n UNION SELECT unnest([' .PDF', 'txt', '..md', '.a b', '', '.toolongforakeyname'])),
k AS (SELECT ext, lower(regexp_replace(trim(ext), '^\.+', '')) AS k FROM e)
SELECT ext, CASE WHEN regexp_matches(k, '^[a-z0-9]{{1,15}}$') THEN '.' || k END AS key FROM k"""


@query
def picture_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes that a model sees of pictures, with parts' numbers as height and width."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 4000 + 20).cast("double").alias("h"), (F.col("p_partkey") * 7 % 3000 + 20).cast("double").alias("w"))
    th, tw = E.picture_size(F.col("h"), F.col("w"))
    return p.select("p_partkey", th.cast("long").alias("th"), tw.cast("long").alias("tw"))


ORACLES["picture_sizes"] = """
WITH p AS (SELECT p_partkey, (p_partkey % 4000 + 20)::DOUBLE AS h, (p_partkey * 7 % 3000 + 20)::DOUBLE AS w FROM part), s AS (SELECT *, sqrt(322560.0::DOUBLE / (h * w)) AS s FROM p)
SELECT p_partkey, greatest(floor(h * s / 48) * 48, 48)::BIGINT AS th, greatest(floor(w * s / 48) * 48, 48)::BIGINT AS tw FROM s"""


@query
def backfilled_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages without a page get one where a new reading counts as many passages of the file."""
    p = table(spark, sf, "passages").groupBy("file_id", "chunk").agg(F.max(F.struct("indexed_at", "page")).alias("v")).select("file_id", "chunk", F.col("v.page").alias("page"))
    read = p.where("file_id % 5 <> 0 or chunk <> 0").select("file_id", "chunk", (F.col("chunk") + 1).alias("page"))
    return PA.backfill_pages(p, read)


ORACLES["backfilled_pages"] = """
WITH p AS (SELECT file_id, chunk, max((indexed_at, page))[2] AS page FROM passages GROUP BY ALL),
r AS (SELECT file_id, chunk, chunk + 1 AS page FROM p WHERE file_id % 5 <> 0 OR chunk <> 0),
f AS (SELECT file_id, a.n = b.n AS fits FROM (SELECT file_id, count(*) AS n FROM p GROUP BY 1) a JOIN (SELECT file_id, count(*) AS n FROM r GROUP BY 1) b USING (file_id))
SELECT p.file_id, p.chunk, coalesce(p.page, CASE WHEN fits THEN coalesce(r.page, 0) WHEN fits IS NOT NULL THEN 0 END) AS page
FROM p LEFT JOIN f USING (file_id) LEFT JOIN r ON r.file_id = p.file_id AND r.chunk = p.chunk"""


# state


@query
def pending_added(spark: SparkSession, sf: str) -> DataFrame:
    """Files with all paths sighted as waiting ones, where they weren't known."""
    files = _valid(spark, sf).select("id", "folder_id", "path", "size", "mtime", "kind", "status", "chunks", "error", "indexed_at", "muted", "search_name")
    seen = table(spark, sf, "sightings").groupBy(P.normcase(F.col("path")).alias("k")).agg(F.max(F.struct("mtime", "size", "path")).alias("v"))
    found = seen.select("v.path", "v.size", "v.mtime", F.lit("doc").alias("kind"), P.base_name(F.col("v.path")).alias("search_name"))
    return ST.add_pending(files, found, 7, 2e9).select("id", "folder_id", P.normcase(F.col("path")).alias("k"), "size", "status")


ORACLES["pending_added"] = rf"""
WITH {_VALID}, o AS (SELECT *, {_K} AS k FROM valid),
e AS (SELECT {_K} AS k, max((mtime, size, path)) AS v FROM sightings GROUP BY 1)
SELECT id, folder_id, k, size, status FROM o
UNION ALL SELECT row_number() OVER (ORDER BY encode(k)) + (SELECT max(id) FROM valid), 7, k, v[2], 'pending' FROM e WHERE k NOT IN (SELECT k FROM o)"""


@query
def errors_muted(spark: SparkSession, sf: str) -> DataFrame:
    return ST.mute_errors(_valid(spark, sf), 7).select("id", F.col("muted").cast("int").alias("muted"))


ORACLES["errors_muted"] = f"WITH {_VALID} SELECT id, CASE WHEN folder_id = 7 AND status = 'error' THEN 1 ELSE muted END::INT AS muted FROM valid"


@query
def passages_left(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of files that are left when a folder is removed."""
    left = ST.remove_folder(_valid(spark, sf), [7])
    return ST.keep_known(table(spark, sf, "passages"), left).select("file_id", "chunk").distinct()


ORACLES["passages_left"] = f"WITH {_VALID} SELECT DISTINCT file_id, chunk FROM passages WHERE file_id IN (SELECT id FROM valid WHERE folder_id <> 7)"


@query
def taken_over(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one folder counted to another that lies above."""
    return ST.take_over(_valid(spark, sf), 3, 2).groupBy("folder_id").agg(F.count("*").alias("n"))


ORACLES["taken_over"] = f"WITH {_VALID} SELECT CASE WHEN folder_id = 3 THEN 2 ELSE folder_id END AS folder_id, count(*) AS n FROM valid GROUP BY 1"


@query
def type_menu(spark: SparkSession, sf: str) -> DataFrame:
    """Formats with their numbers, and those switched off, some of which no file has."""
    counts = FO.format_counts(_valid(spark, sf), table(spark, sf, "containers"))
    off = spark.createDataFrame([("documents", ".pdf"), ("documents", ".nosuch"), ("mail", ".eml")], "category string, ext string")
    return FO.type_menu(counts, off)


ORACLES["type_menu"] = f"""
WITH c AS ({ORACLES["format_counts"]}), o AS (SELECT * FROM (VALUES ('documents', '.pdf'), ('documents', '.nosuch'), ('mail', '.eml')) t(category, ext))
SELECT coalesce(c.category, o.category) AS category, coalesce(c.ext, o.ext) AS ext, coalesce(n, 0) AS n, o.ext IS NOT NULL AS off FROM c FULL OUTER JOIN o ON c.category = o.category AND c.ext = o.ext"""


@query
def example_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Examples kept of why files aren't searched: the first five, then one of each new extension, up to forty."""
    bad = table(spark, sf, "files").where("status in ('error', 'skipped')").select(F.coalesce("error", F.lit("")).alias("reason"), "path")
    return FO.merge_examples(bad)


ORACLES["example_paths"] = f"""
WITH x AS (SELECT DISTINCT coalesce(error, '') AS reason, path, {_SUFFIX} AS ext FROM files WHERE status IN ('error', 'skipped')),
r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY encode(path)) AS n, row_number() OVER (PARTITION BY reason, ext ORDER BY encode(path)) AS e FROM x)
SELECT reason, path FROM r WHERE n <= 5 OR e = 1 QUALIFY row_number() OVER (PARTITION BY reason ORDER BY encode(path)) <= 40"""


@query
def routed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Every path sighted, as a change: its folder, and what a watcher does with it."""
    seen = table(spark, sf, "sightings").select("path", F.when(F.length("path") % 4 == 0, "removed").otherwise("modified").alias("event")).distinct()
    return WA.route(seen, table(spark, sf, "folders").select("id", "path"))


_DECIDED = ORACLES["kinds_of_names"].replace(" OR e = '.csv'", "").split("SELECT path, e AS ext")[0]
ORACLES["routed_changes"] = rf"""
WITH c AS (SELECT DISTINCT path, CASE WHEN length(path) % 4 = 0 THEN 'removed' ELSE 'modified' END AS event FROM sightings),
f AS (SELECT id, lower(replace(regexp_replace(path, '[\\/]+$', ''), '/', '\')) AS root FROM folders),
b AS (SELECT c.path, event, id AS folder_id FROM c JOIN f ON starts_with({_K}, root || '\') QUALIFY row_number() OVER (PARTITION BY c.path ORDER BY id) = 1),
k AS ({_DECIDED.replace("WITH " + _NAMES, "WITH n AS (SELECT path FROM b)")} SELECT path, kind, container FROM k),
s AS (SELECT b.path, list_filter(string_split(substr(replace(b.path, '/', '\'), length(root) + 2), '\'), lambda x: x <> '') AS p FROM b JOIN f ON f.id = b.folder_id),
r AS (SELECT path, len(list_filter(range(1, len(p)), lambda i: lower(p[i]) IN ('$recycle.bin', 'system volume information') OR lower(p[i]) IN ({", ".join(f"'{x}'" for x in T.PROGRAM_FOLDERS)})
        OR (i > 1 AND lower(p[i - 1]) = 'android' AND lower(p[i]) IN ('data', 'obb')) OR starts_with(p[i], '.'))) > 0
      OR starts_with(p[-1], '~$') OR starts_with(p[-1], '.') OR ends_with(p[-1], '~') OR regexp_matches(lower(p[-1]), '^.+\.(bak|old|orig)$') AS skip FROM s)
SELECT b.path, event, folder_id, CASE WHEN event = 'removed' THEN 'remove' WHEN skip THEN NULL WHEN container IS NOT NULL THEN 'container' WHEN kind IS NOT NULL THEN 'file' END AS what
FROM b JOIN k USING (path) JOIN r USING (path)"""


# orders of results


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    files = _valid(spark, sf).select(F.col("id").alias("file_id"), "path", "size", "mtime", "kind")
    r = table(spark, sf, "results").groupBy("query_id", "file_id").agg(F.max("exact").alias("likely"), F.max("score").alias("score"), F.max("similarity").alias("similarity"))
    return r.withColumn("rank", F.col("file_id")).join(files, "file_id")


_SHOWN = rf"""{_VALID},
r AS (SELECT query_id, file_id, bool_or(exact) AS likely, max(similarity) AS similarity FROM results GROUP BY ALL),
j AS (SELECT r.*, path, regexp_extract(path, '[^\\/]*$') AS name, size, mtime, kind FROM r JOIN valid ON id = file_id)"""
_NATURAL = r"regexp_replace(regexp_replace(lower(name), '(\d+)', '00000000000000000000\1', 'g'), '0*(\d{20})', '\1', 'g')"


@query
def results_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return FU.sort_results(_shown(spark, sf), "date").select("query_id", "file_id", "shown")


ORACLES["results_by_date"] = f"WITH {_SHOWN} SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY likely DESC, mtime DESC, file_id) AS shown FROM j"


@query
def results_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return FU.sort_results(_shown(spark, sf), "size").select("query_id", "file_id", "shown")


ORACLES["results_by_size"] = f"WITH {_SHOWN} SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY likely DESC, size DESC, file_id) AS shown FROM j"


@query
def results_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return FU.sort_results(_shown(spark, sf), "type").select("query_id", "file_id", "shown")


ORACLES["results_by_type"] = f"""WITH {_SHOWN}
SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY likely DESC, CASE kind WHEN 'doc' THEN 0 WHEN 'text' THEN 1 WHEN 'code' THEN 2 WHEN 'image' THEN 3 ELSE 4 END, {_SUFFIX}, encode({_NATURAL}), file_id) AS shown FROM j"""


@query
def results_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return FU.sort_results(_shown(spark, sf), "name").select("query_id", "file_id", "shown")


ORACLES["results_by_name"] = f"WITH {_SHOWN} SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY likely DESC, encode({_NATURAL}), file_id) AS shown FROM j"


@query
def map_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """What a map marks of every query's results: all words found, or nearly as similar as the best; the first twelve."""
    return FU.highlighted(_shown(spark, sf).withColumnRenamed("likely", "exact")).select("query_id", "file_id", "mark")


ORACLES["map_highlights"] = f"""WITH {_SHOWN}, g AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM j)
SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY file_id) AS mark FROM g WHERE likely OR similarity >= best - 0.03 QUALIFY mark <= 12"""


# samples


@query
def newest_events(spark: SparkSession, sf: str) -> DataFrame:
    return WA.last_samples(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")


ORACLES["newest_events"] = "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 600"


@query
def event_median(spark: SparkSession, sf: str) -> DataFrame:
    return WA.upper_median(table(spark, sf, "events"), "value")


ORACLES["event_median"] = "SELECT list_sort(list(value))[(floor(count(*) / 2) + 1)::INT] AS median FROM events WHERE value IS NOT NULL"


@query
def event_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Change of a user's running number per second against five samples before."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    one = e.groupBy("user_id", "ts").agg(F.max("n").alias("n"))
    return WA.speed(one, "ts", "n", "user_id").select("user_id", "ts", F.round("speed", 6).alias("speed"))


ORACLES["event_speed"] = """
WITH e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), o AS (SELECT user_id, ts, max(n) AS n FROM e GROUP BY ALL),
l AS (SELECT *, lag(ts, 5) OVER w AS t0, lag(n, 5) OVER w AS n0 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, ts, CASE WHEN ts > t0 THEN round((n - n0) / ((epoch_us(ts) - epoch_us(t0)) / 1e6), 6) END AS speed FROM l"""


@query
def notebook_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notebooks of two cells, and what comes out of them."""
    docs = table(spark, sf, "documents").where("title is not null").select("doc_id", "title")
    raw = F.to_json(F.struct(F.array(F.struct(F.col("title").alias("source")), F.struct(F.lit("x = 1").alias("source"))).alias("cells")))
    return docs.select("doc_id", X.notebook_text(raw).alias("text"))


ORACLES["notebook_texts"] = "SELECT doc_id, title || chr(10) || chr(10) || 'x = 1' AS text FROM documents WHERE title IS NOT NULL"
