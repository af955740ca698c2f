"""Named queries over the test tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from findling.functions import filetypes as T, paths as P, text as X, vectors as V
from findling.operators import folders as FO, fusion as FU, keyword as KW, mapview as MV, passages as PA, scans as SC, state as ST, vector as VE
from findling.session import table
from findling.streaming import watch as WA

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """What every finished scan found new or changed."""
    return SC.changed_paths(*[table(spark, sf, t) for t in ("sightings", "scans", "files", "containers")])


ORACLES["p2_found"] = r"""
WITH RECURSIVE fin AS (
  SELECT scan_id, row_number() OVER (PARTITION BY folder_id ORDER BY started_at, scan_id) AS r FROM scans WHERE state = 'finished'),
seen AS (
  SELECT lower(replace(path, '/', '\')) AS k, scan_id, r, size, mtime FROM sightings JOIN fin USING (scan_id)
  QUALIFY row_number() OVER (PARTITION BY scan_id, k ORDER BY found_at DESC, mtime DESC, size DESC) = 1),
steps AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r) AS n FROM seen),
valid AS (
  SELECT lower(replace(path, '/', '\')) AS k, size, mtime, status, indexed_at FROM files
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, mtime DESC, size DESC, status DESC) = 1
  UNION ALL SELECT lower(replace(path, '/', '\')), size, mtime, 'indexed', NULL FROM containers),
saved AS (
  SELECT k, size, mtime, status FROM valid
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY indexed_at DESC NULLS LAST, mtime DESC, size DESC) = 1),
walk AS (
  SELECT p.k, 0::BIGINT AS n, NULL::BIGINT AS scan_id, false AS hit, s.size, s.mtime, s.status
  FROM (SELECT DISTINCT k FROM steps) p LEFT JOIN saved s ON s.k = p.k
  UNION ALL
  SELECT k, n, scan_id, hit, CASE WHEN hit THEN size ELSE old_size END, CASE WHEN hit THEN mtime ELSE old_mtime END, CASE WHEN hit THEN 'indexed' ELSE old_status END
  FROM (SELECT w.k, s.n, s.scan_id, s.size, s.mtime, w.size AS old_size, w.mtime AS old_mtime, w.status AS old_status,
          w.size IS NULL OR w.size <> s.size OR abs(w.mtime - s.mtime) > 0.001 OR w.status IN ('pending', 'error') AS hit
        FROM walk w JOIN steps s ON s.k = w.k AND s.n = w.n + 1))
SELECT scan_id, k AS path_key FROM walk WHERE hit"""


# text


@query
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalize(F.col("text"))).alias("h"))


ORACLES["normalize_text"] = "SELECT doc_id, md5(strip_accents(lower(text))) AS h FROM documents"

_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"
_TERMS = rf"""
terms AS (
  SELECT query_id, query, list_filter(regexp_extract_all(strip_accents(lower(query)), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1 OR regexp_matches(w, '^\p{{N}}$')) AS r FROM queries),
t AS (
  SELECT query_id, query, CASE WHEN len(list_filter(r, lambda w: w NOT IN {_STOP})) > 0 THEN list_filter(r, lambda w: w NOT IN {_STOP}) ELSE r END AS f FROM terms),
q AS (SELECT query_id, query, list_transform(list_filter(list_zip(f, range(1, len(f) + 1)), lambda x: list_position(f, x[1]) = x[2]), lambda x: x[1])[1:12] AS terms FROM t)"""


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "queries").withColumn("terms", X.query_terms(F.col("query")))


@query
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _queries(spark, sf).select("query_id", F.array_join("terms", " ").alias("terms"), X.last_is_prefix(F.col("terms")).alias("prefix"))


ORACLES["query_terms"] = f"WITH {_TERMS} SELECT query_id, array_to_string(terms, ' ') AS terms, length(terms[-1]) >= 3 AS prefix FROM q"


@query
def identifier_queries(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "files").select("id", P.base_name(F.col("path")).alias("name")).distinct()
    return names.select("id", "name", X.looks_like_identifier(F.regexp_replace("name", r"\.[^.]*$", "")).alias("identifier"))


ORACLES["identifier_queries"] = r"""
WITH n AS (SELECT DISTINCT id, regexp_extract(path, '[^\\/]*$') AS name FROM files)
SELECT id, name, regexp_matches(regexp_replace(name, '\.[^.]*$', ''), '\p{Nd}|_|\w[.\-/]\w|"') AS identifier FROM n"""


@query
def all_terms_match(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold all terms of a query; the queries are joined by their rarest possible hit, a posting."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "title", "text").alias("text"))
    q = _queries(spark, sf).where(F.size("terms") > 0)
    # each term's start is looked up as a posting, so that only documents with a first term are tested
    posted = docs.select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("w")).withColumn("head", F.substring("w", 1, 3))
    # by three letters, or the whole word where it is shorter
    first = q.select("query_id", "terms", F.element_at("terms", 1).alias("t1")).withColumn("head", F.substring("t1", 1, 3))
    fits = F.when(F.length("t1") < X.WHOLE_WORD_BELOW, F.col("w") == F.col("t1")).otherwise(F.startswith("w", F.col("t1")))
    pairs = posted.join(first, "head").where(fits).select("doc_id", "query_id", "terms").distinct()
    return pairs.join(docs, "doc_id").where(X.has_all_terms(F.col("terms"), F.col("text"))).select("query_id", "doc_id")


ORACLES["all_terms_match"] = rf"""
WITH {_TERMS},
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(concat_ws(' ', title, text))), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS w FROM documents)
SELECT query_id, doc_id FROM q, d
WHERE len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(w, CASE WHEN length(t) < 4 THEN ' ' || t || ' ' ELSE ' ' || t END))) = 0"""


@query
def tidy_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "passages").where("text is not null").select("file_id", "chunk", "indexed_at", F.md5(X.tidy(F.col("text"))).alias("h")).distinct()


_W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WL = _W.replace(r"\s\x0b", r"\t\x0b\x0c\r ")
_TIDY = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(9), '    '), '{_WL}+\n', chr(10), 'g'), '({_W.replace('[', '[^', 1)}){_WL}{{2,}}', '\1 ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A{_W}+|{_W}+\z', '', 'g')"
ORACLES["tidy_text"] = f"SELECT DISTINCT file_id, chunk, indexed_at, md5({_TIDY}) AS h FROM passages WHERE text IS NOT NULL"


@query
def odd_characters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "passages").where(X.has_odd_characters(F.col("text"))).select("file_id", "chunk").distinct()


ORACLES["odd_characters"] = r"SELECT DISTINCT file_id, chunk FROM passages WHERE regexp_matches(text, '[\x01-\x08\x0B\x0C\x0E-\x1F\x{E000}-\x{F8FF}]')"


@query
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of the documents."""
    return PA.chunk(table(spark, sf, "documents"), ["doc_id"]).select("doc_id", "chunk", "start", "page", F.md5("text").alias("h"))


ORACLES["chunk_text"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_TIDY} AS t FROM documents),
step AS (
  SELECT doc_id, t, 0::BIGINT AS pos, 0::BIGINT AS fin, 0 AS n FROM d
  UNION ALL
  SELECT doc_id, t, CASE WHEN sp > 0 THEN greatest(e - 200 + sp, pos + 1) ELSE greatest(e - 200, pos + 1) END, e, n + 1 FROM (
    SELECT *, strpos(substr(t, e - 200 + 1, 200), ' ') AS sp FROM (
      SELECT *, CASE WHEN pos + 1500 >= length(t) THEN length(t)
        WHEN b1 > 750 THEN pos + b1 + 2 WHEN b2 > 750 THEN pos + b2 + 1 WHEN b3 > 750 THEN pos + b3 + 2 WHEN b4 > 750 THEN pos + b4 + 1 ELSE pos + 1500 END AS e
      FROM (SELECT *, CASE WHEN strpos(rv, chr(10)||chr(10)) > 0 THEN 1500 - strpos(rv, chr(10)||chr(10)) - 1 ELSE -1 END AS b1,
              CASE WHEN strpos(rv, chr(10)) > 0 THEN 1500 - strpos(rv, chr(10)) ELSE -1 END AS b2,
              CASE WHEN strpos(rv, ' .') > 0 THEN 1500 - strpos(rv, ' .') - 1 ELSE -1 END AS b3,
              CASE WHEN strpos(rv, ' ') > 0 THEN 1500 - strpos(rv, ' ') ELSE -1 END AS b4
            FROM (SELECT *, reverse(substr(t, pos + 1, 1500)) AS rv FROM step WHERE fin < length(t)))))),
p AS (SELECT s.doc_id, s.t, a.pos AS start, s.fin FROM step s JOIN step a ON a.doc_id = s.doc_id AND a.n = s.n - 1 WHERE s.n > 0),
x AS (SELECT *, regexp_replace(substr(t, start + 1, fin - start), '\A{_W}+|{_W}+\z', '', 'g') AS body FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk, start,
       greatest(length(substr(t, 1, start)) - length(replace(substr(t, 1, start), chr(12), '')) + 1, 1) AS page, md5(replace(body, chr(12), '')) AS h
FROM x WHERE body <> ''"""


# keywords


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("title").alias("name"), "text")


@query
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return KW.document_frequency(KW.postings(_docs(spark, sf), ["doc_id"]))


_POSTED = r"""
w AS (
  SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(title)), '[\p{L}\p{N}]+')) AS term, 1 AS n FROM documents WHERE title IS NOT NULL
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')), 0 FROM documents),
p AS (SELECT doc_id, term, sum(n) AS tf_name, sum(1 - n) AS tf_text FROM w GROUP BY ALL)"""
ORACLES["document_frequency"] = f"WITH {_POSTED} SELECT term, count(*) AS df FROM p GROUP BY 1"


@query
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return KW.postings(_docs(spark, sf), ["doc_id"])


ORACLES["postings"] = f"WITH {_POSTED} SELECT doc_id, term, tf_name, tf_text FROM p"


@query
def common_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words that more than half of the documents hold, of all and of those of one language."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.col("title").alias("name"), "text")
    posted = KW.postings(docs, ["doc_id", "lang"])
    return KW.common_terms(posted, docs).select(F.lit("*").alias("lang"), "term", "df").unionByName(KW.common_terms(posted, docs, "lang"))


ORACLES["common_terms"] = f"""WITH {_POSTED}, d AS (SELECT doc_id, coalesce(lang, '?') AS lang FROM documents)
SELECT '*' AS lang, term, count(*) AS df FROM p GROUP BY ALL HAVING count(*) * 2 > (SELECT count(*) FROM documents)
UNION ALL SELECT lang, term, df FROM (SELECT lang, term, count(*) AS df FROM p JOIN d USING (doc_id) GROUP BY ALL) JOIN (SELECT lang, count(*) AS n FROM d GROUP BY 1) USING (lang) WHERE df * 2 > n"""


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty documents of every query by words, titles counting fourfold."""
    hits = KW.bm25(_docs(spark, sf), ["doc_id"], _queries(spark, sf), "query_id", "terms", k=20)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


_BM25 = f"""{_TERMS}, {_POSTED},
ask AS (SELECT query_id, unnest(terms) AS term FROM q),
len AS (SELECT doc_id, sum(tf_name + tf_text) AS l FROM p GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(l) FROM len) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (
  SELECT query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (4.0 * tf_name + tf_text) * 2.2
         / ((4.0 * tf_name + tf_text) + 1.2 * (0.25 + 0.75 * l / avgdl))) AS score
  FROM ask JOIN p USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""
ORACLES["bm25_topk"] = f"WITH {_BM25} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM r WHERE rank <= 20"


@query
def keyword_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The same while the last word is still being typed."""
    typed = _queries(spark, sf).withColumn("terms", F.transform("terms", lambda t, i: F.when(i == F.size("terms") - 1, F.substring(t, 1, 4)).otherwise(t)))
    hits = KW.bm25(_docs(spark, sf), ["doc_id"], typed, "query_id", "terms", k=10, prefix=True)
    return hits.select("query_id", "doc_id", "rank")


ORACLES["keyword_prefix"] = f"""
WITH {_TERMS}, {_POSTED},
typed AS (SELECT query_id, list_concat(terms[1:-2], [terms[-1][1:4]]) AS t FROM q WHERE len(terms) > 0),
d AS (SELECT query_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda x: list_position(t, x[1]) = x[2]), lambda x: x[1]) AS t FROM typed),
ask AS (SELECT query_id, t[i] AS phrase, i = len(t) AND length(t[i]) >= 3 AS open FROM d, range(1, 13) r(i) WHERE i <= len(t)),
h AS (SELECT phrase, open, doc_id, sum(tf_name) AS tf_name, sum(tf_text) AS tf_text FROM (SELECT DISTINCT phrase, open FROM ask) JOIN p ON CASE WHEN open THEN starts_with(term, phrase) ELSE term = phrase END GROUP BY ALL),
len AS (SELECT doc_id, sum(tf_name + tf_text) AS l FROM p GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(l) FROM len) / (SELECT count(*) FROM documents) AS avgdl),
df AS (SELECT phrase, open, count(*) AS df FROM h GROUP BY ALL),
s AS (
  SELECT query_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (4.0 * tf_name + tf_text) * 2.2
         / ((4.0 * tf_name + tf_text) + 1.2 * (0.25 + 0.75 * l / avgdl))) AS score
  FROM ask JOIN h USING (phrase, open) JOIN df USING (phrase, open) JOIN len USING (doc_id), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, rank FROM r WHERE rank <= 10"""


# vectors


@query
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth one, against all."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return VE.knn_join(e, asked, 10, ["vec_id"], "query_id", vector="embedding").select("query_id", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
ORACLES["knn_topk"] = f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_DOT.format("e.embedding", "q.embedding")} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(d, 5) AS similarity FROM r WHERE rank <= 10"""


@query
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same for one vector among some labels only."""
    e = table(spark, sf, "embeddings")
    found = VE.knn(e, [1.0] + [0.0] * 63, 20, ["vec_id"], "embedding", F.col("label").isin(1, 3, 5))
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


ORACLES["knn_filtered"] = "SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS similarity FROM embeddings WHERE label IN (1, 3, 5) ORDER BY embedding[1] DESC, vec_id LIMIT 20"


@query
def mean_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's mean vector at unit length, one row per component."""
    m = VE.mean_vectors(table(spark, sf, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


ORACLES["mean_vectors"] = """
WITH m AS (SELECT label, i - 1 AS i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL)
SELECT label, i::INT AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM m"""


@query
def similarity_per_file(spark: SparkSession, sf: str) -> DataFrame:
    hits = VE.scored(table(spark, sf, "embeddings"), [0.125] * 64, "embedding").select(F.col("label").alias("file_id"), "similarity")
    return VE.best_per_file(hits).select("file_id", F.round("similarity", 6).alias("similarity"))


ORACLES["similarity_per_file"] = "SELECT label AS file_id, round(max(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * 0.125), 6) AS similarity FROM embeddings GROUP BY 1"


@query
def stored_hits_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Hits kept from older searches with their similarity now, its share and its radius."""
    lay = table(spark, sf, "layout").where("vector is not null").groupBy("file_id").agg(F.max("vector").alias("vector"))
    hits = table(spark, sf, "vectorhits").select("query_file_id", "file_id").distinct()
    a = lay.select(F.col("file_id").alias("query_file_id"), F.col("vector").alias("v"))
    s = hits.join(a, "query_file_id").join(lay, "file_id").select("query_file_id", "file_id", V.cosine(F.col("v"), F.col("vector")).alias("s"))
    return s.select("query_file_id", "file_id", F.round("s", 5).alias("similarity"), F.round(VE.match_share(F.col("s")), 4).alias("share"), F.round(VE.neighbour_radius(F.col("s")), 4).alias("radius"))


ORACLES["stored_hits_checked"] = f"""
WITH l AS (SELECT file_id, max(vector) AS v FROM layout WHERE vector IS NOT NULL GROUP BY 1),
h AS (SELECT DISTINCT query_file_id, file_id FROM vectorhits),
s AS (SELECT query_file_id, h.file_id, {_DOT.format("a.v", "b.v")} / (greatest(sqrt({_DOT.format("a.v", "a.v")}), 1e-9) * greatest(sqrt({_DOT.format("b.v", "b.v")}), 1e-9)) AS s
      FROM h JOIN l a ON a.file_id = query_file_id JOIN l b ON b.file_id = h.file_id)
SELECT query_file_id, file_id, round(s, 5) AS similarity, round(least(greatest((s - 0.55) / 0.27, 0), 1), 4) AS share, round(least(greatest((0.95 - s) / 0.4, 0.02), 1.2), 4) AS radius FROM s"""


@query
def dimension_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("c"))
    return spark.createDataFrame([(VE.dimension_scale(rows, "c"),)], "scale double").select(F.round("scale", 6).alias("scale"))


ORACLES["dimension_scale"] = "SELECT list_sort(list(round(abs(embedding[1]::DOUBLE), 6)))[(floor(count(*) * 0.95) + 1)::INT] AS scale FROM embeddings"


@query
def related_weights(spark: SparkSession, sf: str) -> DataFrame:
    hits = VE.scored(table(spark, sf, "embeddings"), [0.125] * 64, "embedding")
    rows = hits.groupBy(F.col("label").alias("file_id")).agg(F.round(F.max("similarity"), 3).alias("similarity"))
    return VE.related_weights(rows).withColumn("weight", F.round("weight", 6))


ORACLES["related_weights"] = """
WITH s AS (SELECT label AS file_id, round(max(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * 0.125), 3) AS similarity FROM embeddings GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, file_id) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT file_id, similarity, round(1 - i / (n - 1), 6) AS weight, i < 6 AS close FROM r"""


# fusion of search results


@query
def hybrid_fuse(spark: SparkSession, sf: str) -> DataFrame:
    """The kept results' vector and keyword lists fused anew, with what is likely."""
    return _fused(spark, sf).select("query_id", "file_id", "chunk", "similarity", "keyword", "exact", "rank", F.round("score", 8).alias("score"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").groupBy("query_id", "file_id", "chunk").agg(F.max("similarity").alias("similarity"), F.max("score").alias("score"), F.max("keyword").alias("keyword"), F.max("exact").alias("exact"))
    v = r.where("similarity is not null and not keyword").select("query_id", "file_id", "chunk", "similarity")
    v = v.unionByName(r.where("similarity is not null and keyword").select("query_id", "file_id", "chunk", "similarity"))
    q = _queries(spark, sf).select("query_id", FU.keyword_weight(F.col("query"), F.col("terms")).alias("weight"))
    k = r.where("keyword").join(q, "query_id").select("query_id", "file_id", "chunk", F.col("score").alias("bm25"), "exact", "weight")
    return FU.fuse(v, k)


_FUSE = rf"""{_TERMS},
r AS (SELECT query_id, file_id, chunk, max(similarity) AS similarity, max(score) AS score, bool_or(keyword) AS keyword, bool_or(exact) AS exact FROM results GROUP BY ALL),
v1 AS (SELECT * FROM r WHERE similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, file_id ORDER BY similarity DESC, chunk) = 1),
v AS (SELECT query_id, file_id, chunk AS vc, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, file_id, chunk) - 1 AS rv FROM v1),
k1 AS (SELECT * FROM r WHERE keyword QUALIFY row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, chunk) = 1),
k AS (SELECT k1.query_id, file_id, chunk AS kc, exact, row_number() OVER (PARTITION BY k1.query_id ORDER BY score DESC, file_id, chunk) - 1 AS rk,
        CASE WHEN len(terms) <= 3 OR regexp_matches(query, '\p{{Nd}}|_|\w[.\-/]\w|"') THEN 1.0 ELSE 0.5 END AS weight FROM k1 JOIN q USING (query_id)),
f AS (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.file_id, k.file_id) AS file_id,
    CASE WHEN rk IS NOT NULL AND (coalesce(exact, false) OR vc IS NULL) THEN kc ELSE vc END AS chunk, round(similarity * 10000) / 10000 AS similarity,
    coalesce(1 / (60.0 + rv), 0) + coalesce(weight / (60.0 + rk) + CASE WHEN exact THEN 1 / 60.0 ELSE 0 END, 0) AS score,
    rk IS NOT NULL AS keyword, coalesce(exact, false) AS exact, coalesce(rv::DOUBLE, 1e9 + rk) AS ord
  FROM v FULL OUTER JOIN k ON v.query_id = k.query_id AND v.file_id = k.file_id),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, (similarity IS NOT NULL) DESC, similarity DESC NULLS LAST, round(score, 9) DESC, ord, file_id) AS rank FROM f)"""
ORACLES["hybrid_fuse"] = f"WITH {_FUSE} SELECT query_id, file_id, chunk, similarity, keyword, exact, rank, round(score, 8) AS score FROM z"


@query
def likely_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Fused results with the likely ones first; pictures have a bar of their own."""
    kinds = FO.valid_files(table(spark, sf, "files")).select(F.col("id").alias("file_id"), (F.col("kind") == "image").alias("picture"))
    shown = FU.partition_likely(FU.likely(_fused(spark, sf).join(kinds, "file_id")))
    return shown.select("query_id", "file_id", "likely", "shown", "n_likely")


_VALID = "valid AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, path DESC, size DESC, status DESC) = 1)"
ORACLES["likely_partition"] = f"""
WITH {_FUSE}, {_VALID},
j AS (SELECT z.*, kind = 'image' AS picture FROM z JOIN valid ON id = file_id),
g AS (SELECT *, exact OR coalesce(similarity >= CASE WHEN picture THEN 0.71 ELSE 0.73 END AND similarity >= max(similarity) OVER (PARTITION BY query_id, picture) - 0.04, false) AS good FROM j),
l AS (SELECT *, good OR (NOT bool_or(good) OVER (PARTITION BY query_id) AND count(similarity) OVER (PARTITION BY query_id) = 0 AND rank <= 3) AS likely FROM g)
SELECT query_id, file_id, likely, row_number() OVER (PARTITION BY query_id ORDER BY likely DESC, rank) AS shown, sum(likely::INT) OVER (PARTITION BY query_id) AS n_likely FROM l"""


@query
def result_order(spark: SparkSession, sf: str) -> DataFrame:
    """Results in order of name inside each part, numbers by value."""
    files = FO.valid_files(table(spark, sf, "files")).select(F.col("id").alias("file_id"), P.base_name(F.col("path")).alias("name"))
    natural = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})", "$1")
    r = table(spark, sf, "results").select("query_id", "file_id", "exact").distinct().groupBy("query_id", "file_id").agg(F.max("exact").alias("exact")).join(files, "file_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("exact"), natural(F.col("name")), "file_id")
    return r.select("query_id", "file_id", F.row_number().over(w).alias("pos"))


ORACLES["result_order"] = rf"""
WITH {_VALID},
r AS (SELECT query_id, file_id, bool_or(exact) AS exact FROM results GROUP BY ALL)
SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC,
  regexp_replace(regexp_replace(lower(regexp_extract(path, '[^\\/]*$')), '(\d+)', '00000000000000000000\1', 'g'), '0*(\d{{20}})', '\1', 'g'), file_id) AS pos
FROM r JOIN valid ON id = file_id"""


# rules of names and paths


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sightings").select("path").unionByName(table(spark, sf, "files").select("path")).distinct()


_NAMES = "n AS (SELECT path FROM sightings UNION SELECT path FROM files)"
_SUFFIX = r"CASE WHEN regexp_matches(regexp_extract(path, '[^\\/]*$'), '^.+\.[^.]+$') THEN lower(regexp_extract(path, '\.[^.\\/]+$')) ELSE '' END"
_list = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


@query
def kinds_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every path's extension, kind, category, decision and size limit."""
    p = F.col("path")
    return _names(spark, sf).select("path", P.suffix(p).alias("ext"), T.kind_of(p).alias("kind"), T.decide(p, off=("mail",), formats_off=(".csv",)).alias("decision"), T.container_type(p).alias("container"), T.max_bytes(F.coalesce(T.kind_of(p), F.lit("text")), p).alias("most"))


_KIND = f"CASE WHEN e IN {_list(T.PICTURES + T.RAW)} THEN 'image' WHEN e IN {_list(T.DOCUMENTS)} THEN 'doc' WHEN e IN {_list(T.CODE)} THEN 'code' WHEN e IN {_list(T.PROSE)} THEN 'text' END"
ORACLES["kinds_of_names"] = f"""
WITH {_NAMES}, x AS (SELECT path, {_SUFFIX} AS e FROM n),
k AS (SELECT *, {_KIND} AS kind,
  CASE WHEN regexp_matches(lower(path), '\\.tar\\.(gz|bz2|xz)$') THEN 'tar' WHEN e = '.zip' THEN 'zip' WHEN e IN {_list(T.TARS)} THEN 'tar' WHEN e IN {_list(T.SINGLES)} THEN 'single' WHEN e IN {_list(T.LIBRARIES)} THEN 'library' WHEN e IN ('.eml', '.msg') THEN 'mail' END AS container FROM x)
SELECT path, e AS ext, kind, container,
  CASE WHEN kind IS NOT NULL THEN CASE WHEN e IN {_list(T.MAILS)} OR e = '.csv' THEN 'off' ELSE kind END
       WHEN container IS NOT NULL THEN 'archive' WHEN e IN {_list(T.MEDIA)} THEN 'media' WHEN e IN {_list(T.PROGRAMS)} THEN 'program' WHEN e IN {_list(T.MAILBOXES)} THEN 'mailbox' ELSE 'type' END AS decision,
  CASE WHEN kind = 'image' AND e IN {_list(T.RAW)} THEN {T.LIMITS["raw"]} WHEN kind = 'image' THEN {T.LIMITS["image"]} WHEN kind = 'doc' THEN {T.LIMITS["doc"]} ELSE {T.LIMITS["text"]} END AS most
FROM k"""


#: Paths as rules for folders and files meet them.
ODD_PATHS = (
    r"C:\phone\Android\data\a.txt", r"C:\Android\obb\x\a.txt", r"C:\data\a.txt", r"D:\$Recycle.Bin\x.doc", r"D:\System Volume Information\t.txt", r"C:\p\node_modules\m\i.js",
    r"C:\.git\config", r"C:\d\.env", r"C:\d\~$brief.docx", r"C:\d\Drache.kra~", r"C:\d\a.bak", r"C:\d\a.old", r"C:\d\.bak", r"C:\d\plain.txt", "C:/mixed/.hidden/x.md", r"C:\d\~", r"C:\d\a.orig.txt",
)


@query
def skipped_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that a scan would pass by, with the reason: those of the tables and of every kind of rule."""
    names = _names(spark, sf).unionByName(spark.createDataFrame([(p,) for p in ODD_PATHS], "path string"))
    return names.select("path", T.skip_path(F.filter(F.split("path", r"[\\/]"), lambda x: x != "")).alias("reason")).where("reason is not null")


ORACLES["skipped_paths"] = rf"""
WITH {_NAMES}, o AS (SELECT * FROM n UNION ALL SELECT unnest([{", ".join(f"'{p}'" for p in ODD_PATHS)}])),
d AS (SELECT path, list_filter(string_split(replace(path, '/', '\'), '\'), lambda x: x <> '') AS p FROM o),
r AS (SELECT path, p, list_filter(list_transform(range(1, len(p)), lambda i:
    CASE WHEN lower(p[i]) IN ('$recycle.bin', 'system volume information') THEN 'hidden'
         WHEN lower(p[i]) IN {_list(T.PROGRAM_FOLDERS)} OR (i > 1 AND lower(p[i - 1]) = 'android' AND lower(p[i]) IN ('data', 'obb')) THEN 'program_folder'
         WHEN starts_with(p[i], '.') THEN 'hidden' END), lambda x: x IS NOT NULL) AS rs FROM d),
f AS (SELECT path, coalesce(rs[1], CASE WHEN starts_with(p[-1], '~$') THEN 'office_temp' WHEN starts_with(p[-1], '.') THEN 'hidden'
    WHEN ends_with(p[-1], '~') OR regexp_matches(lower(p[-1]), '^.+\.(bak|old|orig)$') THEN 'backup' END) AS reason FROM r)
SELECT path, reason FROM f WHERE reason IS NOT NULL"""


@query
def search_names(spark: SparkSession, sf: str) -> DataFrame:
    """What files are found by and what their passages are titled."""
    files = FO.valid_files(table(spark, sf, "files")).join(table(spark, sf, "folders").select(F.col("id").alias("folder_id"), F.col("path").alias("root")), "folder_id")
    return files.select("id", P.search_name(F.col("path"), F.col("root")).alias("search_name"), P.embed_title(F.col("path"), F.col("root")).alias("title"))


ORACLES["search_names"] = rf"""
WITH {_VALID},
j AS (SELECT v.id, v.path, f.path AS root FROM valid v JOIN folders f ON f.id = v.folder_id),
r AS (SELECT id, CASE WHEN starts_with(replace(lower(path), '/', '\'), lower(root) || '\') THEN substr(path, length(root) + 2) ELSE path END AS rel FROM j),
p AS (SELECT id, list_filter(string_split(replace(rel, '/', '\'), '\'), lambda x: x <> '') AS p FROM r)
SELECT id, array_to_string(list_concat([p[-1]], p[1:-2]), ' ') AS search_name, array_to_string(p[-2:], '/') AS title FROM p"""


# folders


@query
def folder_summary(spark: SparkSession, sf: str) -> DataFrame:
    return FO.summary(table(spark, sf, "folders"), FO.valid_files(table(spark, sf, "files")))


_MAIL = "regexp_matches(lower(v.path), '\\.(eml|msg|mht|mhtml)$')"
ORACLES["folder_summary"] = f"""
WITH {_VALID}
SELECT f.id, f.path, count(v.id) AS files, count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status = 'pending') AS pending,
  count(*) FILTER (WHERE status = 'error' AND muted = 0) AS errors, count(*) FILTER (WHERE status = 'error') AS unreadable, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  coalesce(sum(CASE WHEN status = 'indexed' THEN size ELSE 0 END), 0)::BIGINT AS bytes, coalesce(sum(chunks), 0)::BIGINT AS chunks,
  count(*) FILTER (WHERE kind = 'image' AND status = 'indexed') AS images, count(*) FILTER (WHERE status = 'indexed' AND kind = 'doc' AND NOT {_MAIL}) AS docs,
  count(*) FILTER (WHERE status = 'indexed' AND kind IN ('text', 'code') AND NOT {_MAIL}) AS texts, count(*) FILTER (WHERE status = 'indexed' AND kind <> 'image' AND {_MAIL}) AS mails,
  count(*) FILTER (WHERE status = 'skipped') + coalesce(list_sum(list_transform(list_filter(map_entries(any_value(report)), lambda e: e.key NOT IN ('no_access_dir', 'unreadable_dir', 'damaged_archive')), lambda e: e.value)), 0)::BIGINT AS unsearched
FROM folders f LEFT JOIN valid v ON v.folder_id = f.id GROUP BY f.id, f.path"""


@query
def format_counts(spark: SparkSession, sf: str) -> DataFrame:
    files, containers = table(spark, sf, "files"), table(spark, sf, "containers")
    return FO.format_counts(FO.valid_files(files), containers.select("path").distinct())


ORACLES["format_counts"] = f"""
WITH {_VALID},
a AS (SELECT CASE WHEN e IN {_list(T.MAILS)} THEN 'mail' WHEN kind = 'image' THEN 'pictures' WHEN kind IN ('text', 'code') THEN 'text' ELSE 'documents' END AS category, e AS ext
      FROM (SELECT kind, {_SUFFIX} AS e FROM valid WHERE status IN ('indexed', 'pending'))
      UNION ALL SELECT 'archives', e FROM (SELECT {_SUFFIX} AS e FROM (SELECT DISTINCT path FROM containers)) WHERE e IN {_list(T.ZIPS + T.TARS + T.SINGLES + T.LIBRARIES)})
SELECT category, ext, count(*) AS n FROM a WHERE ext <> '' GROUP BY ALL"""


@query
def details_by_ext(spark: SparkSession, sf: str) -> DataFrame:
    d = FO.details(FO.valid_files(table(spark, sf, "files")))
    return d.select("folder_id", "ext", "n", F.array_join("reasons", ", ").alias("reasons"), F.array_join("examples", ", ").alias("examples"))


ORACLES["details_by_ext"] = f"""
WITH {_VALID}, s AS (SELECT folder_id, {_SUFFIX} AS ext, coalesce(error, '') AS why, path, indexed_at FROM valid WHERE status = 'skipped'),
w AS (SELECT folder_id, ext, why, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT folder_id, ext, sum(n)::BIGINT AS n, string_agg(why || ':' || n, ', ' ORDER BY n DESC, why) AS reasons FROM w GROUP BY ALL),
e AS (SELECT folder_id, ext, string_agg(path, ', ' ORDER BY rn) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY folder_id, ext ORDER BY indexed_at DESC, path) AS rn FROM s) WHERE rn <= 5 GROUP BY ALL)
SELECT folder_id, ext, n, reasons, examples FROM r JOIN e USING (folder_id, ext)"""


@query
def merged_reports(spark: SparkSession, sf: str) -> DataFrame:
    folders = table(spark, sf, "folders").select(F.col("id").alias("folder_id"), "report")
    return FO.merge_reports(folders.unionByName(table(spark, sf, "containers").dropDuplicates(["path"]).select("folder_id", "report")))


ORACLES["merged_reports"] = """
WITH r AS (SELECT id AS folder_id, report FROM folders UNION ALL SELECT folder_id, report FROM containers QUALIFY row_number() OVER (PARTITION BY path) = 1),
e AS (SELECT folder_id, unnest(map_entries(report)) AS e FROM r)
SELECT folder_id, e.key AS reason, sum(e.value)::BIGINT AS n FROM e GROUP BY ALL"""


@query
def subdirs(spark: SparkSession, sf: str) -> DataFrame:
    return FO.subdirs(FO.valid_files(table(spark, sf, "files")), "C:\\Daten")


ORACLES["subdirs"] = rf"""
WITH {_VALID}, i AS (SELECT string_split(substr(path, 10), '\') AS p FROM valid WHERE status = 'indexed' AND starts_with(replace(lower(path), '/', '\'), 'c:\daten\'))
SELECT 'C:\Daten\' || p[1] AS path, p[1] AS name, count(*) AS count FROM i WHERE len(p) > 1 GROUP BY p[1]"""


@query
def count_under(spark: SparkSession, sf: str) -> DataFrame:
    return FO.count_under(FO.valid_files(table(spark, sf, "files")), "E:\\Fotos")


ORACLES["count_under"] = rf"WITH {_VALID} SELECT count(*) AS n FROM valid WHERE status = 'indexed' AND starts_with(replace(lower(path), '/', '\'), 'e:\fotos\')"


@query
def find_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return FO.find_dirs(FO.valid_files(table(spark, sf, "files")), table(spark, sf, "folders"), "re", 20)


ORACLES["find_dirs"] = rf"""
WITH {_VALID},
j AS (SELECT f.path AS root, string_split(substr(v.path, length(f.path) + 2), '\') AS p FROM valid v JOIN folders f ON f.id = v.folder_id
      WHERE status = 'indexed' AND starts_with(replace(lower(v.path), '/', '\'), lower(f.path) || '\')),
e AS (SELECT root || '\' || array_to_string(p[1:i], '\') AS path, p[i] AS name FROM j, range(1, 40) t(i) WHERE i < len(p))
SELECT path, name, count(*) AS count FROM e WHERE contains(lower(name), 're') GROUP BY path, name ORDER BY NOT starts_with(lower(name), 're'), count DESC, lower(path), path LIMIT 20"""


@query
def errors_list(spark: SparkSession, sf: str) -> DataFrame:
    return FO.errors(FO.valid_files(table(spark, sf, "files")))


ORACLES["errors_list"] = f"""
WITH {_VALID}, e AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY muted, indexed_at DESC, id) AS n FROM valid WHERE status = 'error')
SELECT folder_id, id, path, error, muted <> 0 AS seen, n FROM e WHERE n <= 500"""


@query
def index_facts(spark: SparkSession, sf: str) -> DataFrame:
    return FO.facts(FO.valid_files(table(spark, sf, "files")))


ORACLES["index_facts"] = f"WITH {_VALID} SELECT count(*) AS files, count_if(status = 'indexed') AS indexed, sum(chunks)::BIGINT AS passages, sum(size)::BIGINT AS bytes FROM valid"


# state


@query
def scan_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What the scans found, by each path's newest signature, against the files saved, gone ones included."""
    seen = table(spark, sf, "sightings").select("path", "size", "mtime")
    return ST.scan_diff(FO.valid_files(table(spark, sf, "files")), seen)


ORACLES["scan_diff"] = rf"""
WITH {_VALID},
s AS (SELECT replace(lower(path), '/', '\') AS k, max((mtime, size, status)) AS v FROM valid GROUP BY 1),
f AS (SELECT replace(lower(path), '/', '\') AS k, max((mtime, size)) AS v FROM sightings GROUP BY 1)
SELECT coalesce(s.k, f.k) AS path_key, CASE WHEN s.k IS NULL THEN 'new' WHEN f.k IS NULL THEN 'gone'
  WHEN s.v[2] <> f.v[2] OR abs(s.v[1] - f.v[1]) > 0.001 OR s.v[3] IN ('pending', 'error') THEN 'changed' ELSE 'same' END AS state
FROM s FULL OUTER JOIN f ON s.k = f.k"""


@query
def containers_to_open(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "containers").select("path", "size", "mtime").distinct()
    return ST.containers_to_open(table(spark, sf, "containers"), found, "f3-all")


ORACLES["containers_to_open"] = r"""
WITH f AS (SELECT DISTINCT path, size, mtime FROM containers),
s AS (SELECT lower(replace(path, '/', '\')) AS k, max((mtime, size, types)) AS v FROM containers GROUP BY 1)
SELECT path, size, mtime FROM f LEFT JOIN s ON s.k = lower(replace(path, '/', '\')) WHERE NOT coalesce(s.v[2] = size AND abs(s.v[1] - mtime) <= 0.001 AND s.v[3] = 'f3-all', false)"""


@query
def upserted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files after all sightings were taken in as indexed."""
    files = FO.valid_files(table(spark, sf, "files")).select("id", "folder_id", "path", "size", "mtime", "kind", "status", "chunks", "error", "indexed_at", "muted", "search_name")
    seen = table(spark, sf, "sightings").withColumn("k", P.normcase(F.col("path"))).groupBy("k").agg(F.max(F.struct("mtime", "size", "folder_id", "path")).alias("v"))
    entries = seen.select("v.folder_id", "v.path", "v.size", "v.mtime", F.lit("doc").alias("kind"), F.lit("indexed").alias("status"), F.lit(1).cast("long").alias("chunks"), F.lit(None).cast("string").alias("error"), F.col("v.path").alias("search_name"))
    return ST.upsert_files(files, entries, 2e9).select("id", "folder_id", P.normcase(F.col("path")).alias("k"), "size", "mtime", "status", "muted")


ORACLES["upserted_files"] = rf"""
WITH {_VALID},
o AS (SELECT *, lower(replace(path, '/', '\')) AS k FROM valid),
e AS (SELECT lower(replace(path, '/', '\')) AS k, max((mtime, size, folder_id, path)) AS v FROM sightings GROUP BY 1),
fresh AS (SELECT k, row_number() OVER (ORDER BY encode(k)) + (SELECT max(id) FROM valid) AS id FROM e WHERE k NOT IN (SELECT k FROM o))
SELECT id, folder_id, k, size, mtime, status, muted::INT AS muted FROM o WHERE k NOT IN (SELECT k FROM e)
UNION ALL SELECT coalesce(o.id, fresh.id), v[3], e.k, v[2], v[1], 'indexed', 0 FROM e LEFT JOIN o ON o.k = e.k LEFT JOIN fresh ON fresh.k = e.k"""


@query
def removed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Files left after every archive path and all inside it are removed."""
    return ST.remove_paths(FO.valid_files(table(spark, sf, "files")), table(spark, sf, "containers").select("path")).select("id")


ORACLES["removed_paths"] = rf"""
WITH {_VALID}, c AS (SELECT DISTINCT lower(replace(path, '/', '\')) AS k FROM containers)
SELECT id FROM valid v WHERE NOT EXISTS (SELECT 1 FROM c WHERE lower(replace(v.path, '/', '\')) = k OR starts_with(lower(replace(v.path, '/', '\')), k || '\'))"""


@query
def relocated(spark: SparkSession, sf: str) -> DataFrame:
    files = ST.take_over(ST.relocate(FO.valid_files(table(spark, sf, "files")), "C:\\Daten", "G:\\Neu"), 7, 1)
    return files.select("id", "folder_id", "path")


ORACLES["relocated"] = rf"""
WITH {_VALID} SELECT id, CASE WHEN folder_id = 7 THEN 1 ELSE folder_id END AS folder_id,
  CASE WHEN starts_with(lower(replace(path, '/', '\')), 'c:\daten\') THEN 'G:\Neu' || substr(path, 9) ELSE path END AS path FROM valid"""


@query
def left_out(spark: SparkSession, sf: str) -> DataFrame:
    """Files outside the first subfolders of folder 7."""
    files = FO.valid_files(table(spark, sf, "files"))
    roots = table(spark, sf, "folders").where("id = 7").select(F.col("id").alias("folder_id"), F.col("path").alias("root"))
    below = files.join(roots, "folder_id").withColumn("parts", P.below(F.col("path"), F.col("root"))).where(F.size("parts") > 1)
    subs = below.select("folder_id", F.concat("root", F.lit("\\"), F.element_at("parts", 1)).alias("path")).distinct()
    return ST.leave_out(files, subs).select("id", "folder_id")


ORACLES["left_out"] = rf"""
WITH {_VALID}, r AS (SELECT path AS root FROM folders WHERE id = 7)
SELECT v.id, v.folder_id FROM valid v, r WHERE NOT (v.folder_id = 7 AND starts_with(lower(replace(v.path, '/', '\')), lower(root) || '\') AND contains(substr(replace(v.path, '/', '\'), length(root) + 2), '\'))"""


@query
def reread_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ST.reread(FO.valid_files(table(spark, sf, "files")), table(spark, sf, "passages")).where("mtime = 0").select("id")


ORACLES["reread_documents"] = rf"""
WITH {_VALID} SELECT id FROM valid WHERE (kind = 'doc' AND id IN (SELECT file_id FROM passages WHERE regexp_matches(text, '[\x01-\x08\x0B\x0C\x0E-\x1F\x{{E000}}-\x{{F8FF}}]'))) OR mtime = 0"""


@query
def pdfs_without_pages(spark: SparkSession, sf: str) -> DataFrame:
    return ST.without_pages(FO.valid_files(table(spark, sf, "files")), table(spark, sf, "passages"))


ORACLES["pdfs_without_pages"] = f"WITH {_VALID} SELECT id, path FROM valid WHERE status = 'indexed' AND ends_with(lower(path), '.pdf') AND id IN (SELECT file_id FROM passages WHERE page IS NULL)"


# streams and samples, on tables


@query
def debounced_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last event before a minute of quiet."""
    return WA.debounced(table(spark, sf, "events"), "user_id", "ts", "event_id", "event_type", "60 seconds")


ORACLES["debounced_events"] = """
WITH e AS (SELECT *, ts - lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum((gap IS NULL OR gap >= INTERVAL 60 SECOND)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, count(*) AS n FROM s GROUP BY user_id, session"""


@query
def event_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's running number of events per minute over the last 120."""
    e = table(spark, sf, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    one = e.groupBy("user_id", "ts").agg(F.max("n").alias("n"))
    return WA.rates(one, "ts", "n", "user_id").select("user_id", "ts", "n", F.round("per_minute", 5).alias("per_minute"))


ORACLES["event_rates"] = """
WITH e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
o AS (SELECT user_id, ts, max(n) AS n FROM e GROUP BY ALL),
f AS (SELECT *, first(ts) OVER w AS t0, first(n) OVER w AS n0 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))
SELECT user_id, ts, n, CASE WHEN ts > t0 THEN round((n - n0) / ((epoch_us(ts) - epoch_us(t0)) / 1e6 / 60), 5) END AS per_minute FROM f"""


# the map


@query
def map_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The files that a map of 100 points would show."""
    return MV.sample(table(spark, sf, "layout").select("file_id").distinct(), most=100)


ORACLES["map_sample"] = "SELECT DISTINCT file_id, (file_id::HUGEINT * 11400714819323198485) % 18446744073709551616 AS k FROM layout ORDER BY k LIMIT 100"
ORACLES["map_sample"] = f"SELECT file_id FROM ({ORACLES['map_sample']})"


@query
def map_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates centred, scaled and clamped."""
    rows = table(spark, sf, "layout").groupBy("file_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in "xyz"])
    return MV.fit(rows, ["x", "y", "z"]).select("file_id", *[F.round(c, 6).alias(c) for c in "xyz"])


ORACLES["map_fit"] = """
WITH l AS (SELECT file_id, max(x)::DOUBLE AS x, max(y)::DOUBLE AS y, max(z)::DOUBLE AS z FROM layout GROUP BY 1),
m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM l),
c AS (SELECT file_id, x - mx AS x, y - my AS y, z - mz AS z FROM l, m),
q AS (SELECT quantile_cont(sqrt(x * x + y * y + z * z), 0.98) AS q FROM c)
SELECT file_id, round(greatest(least(x / q, 1.15), -1.15), 6) AS x, round(greatest(least(y / q, 1.15), -1.15), 6) AS y, round(greatest(least(z / q, 1.15), -1.15), 6) AS z FROM c, q"""


@query
def map_stale(spark: SparkSession, sf: str) -> DataFrame:
    return MV.stale(table(spark, sf, "layout"), FO.valid_files(table(spark, sf, "files")))


ORACLES["map_stale"] = f"""
WITH {_VALID}, o AS (SELECT file_id, max((mtime, size)) AS o FROM layout GROUP BY 1), n AS (SELECT id, (mtime, size) AS n FROM valid WHERE status = 'indexed')
SELECT coalesce(file_id, id) AS file_id, CASE WHEN o IS NULL THEN 'new' WHEN n IS NULL THEN 'gone' WHEN o[1] = n[1] AND o[2] = n[2] THEN 'kept' ELSE 'moved' END AS state
FROM o FULL OUTER JOIN n ON file_id = id"""


@query
def map_components(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings in three principal components (no SQL: signs and rotations are tested by reconstruction)."""
    e = table(spark, sf, "embeddings")
    mean, comps = MV.principal(e, "embedding", 64, 3)
    return MV.project(e.select("vec_id", "embedding"), "embedding", mean, comps, ["x", "y", "z"]).drop("embedding")
