"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findling.llm import duplicates as D, leakage as L, mails as M, mojibake as J, neighbours as N, packing as K, quality as Q, ranking as R, splitting as S
from findling.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# 1: splitting oversized texts


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Passages whose valid text is over the limit: those that the splitter cuts."""
    cut = S.split_texts(S.valid_long_passages(table(spark, sf, "passages")), ["file_id", "chunk"], keep_small=False)
    return cut.where("piece = 0").select("file_id", "chunk").distinct()


ORACLES["p1_found"] = """
WITH t AS (SELECT file_id, chunk, indexed_at, trim(text, chr(32)||chr(9)||chr(13)||chr(10)||chr(12)||chr(160)) AS t FROM passages),
v AS (SELECT *, row_number() OVER (PARTITION BY file_id, chunk ORDER BY indexed_at DESC, coalesce(length(t), 0) DESC) AS rn FROM t)
SELECT file_id, chunk FROM v WHERE rn = 1 AND length(t) > 1500"""


@query
def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of the oversized passages, with page and snippet."""
    return S.split_texts(S.valid_long_passages(table(spark, sf, "passages")), ["file_id", "chunk"], keep_small=False)


# 3: newly written lines of mails


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of mails that their sender didn't newly write."""
    return M.mail_lines(table(spark, sf, "mails"), others_only=True).select("mail_id", "line_no").distinct()


@query
def p3_written(spark: SparkSession, sf: str) -> DataFrame:
    return M.newly_written(table(spark, sf, "mails"))


# 7: texts read in a wrong encoding


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Fields with characters from a wrong encoding."""
    r = J.restore_fields(table(spark, sf, "mails"), "mail_id", ["body", "subject", "sender"])
    return r.where("damaged").select("mail_id", "field").distinct()


@query
def p7_restored(spark: SparkSession, sf: str) -> DataFrame:
    return J.restore_fields(table(spark, sf, "mails"), "mail_id", ["body", "subject", "sender"]).where("damaged")


# 8: filling containers


@query
def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in containers of 2,048 tokens."""
    return K.pack(table(spark, sf, "documents"))


# 10: statistics and structural forms of texts


def _statistics(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return Q.text_statistics(documents, Q.fit_profiles(documents, table(spark, sf, "labels")))


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents less than half of which is natural prose, with what the rest mainly is."""
    return _statistics(spark, sf).where("form <> 'prose'").select("doc_id", "form").distinct()


@query
def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _statistics(spark, sf)


# 9: evaluation items in documents


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return L.find_leaks(table(spark, sf, "documents"), table(spark, sf, "evalset"))


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold the text of an item, wholly or partly."""
    return _leaks(spark, sf).where("kind = 'copy'").select("doc_id", "item_id").distinct()


@query
def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


# 4: most similar vectors


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of files of which one is among the five most similar of the other."""
    return N.neighbour_pairs(N.similar_files(table(spark, sf, "layout")))


@query
def p4_similar(spark: SparkSession, sf: str) -> DataFrame:
    return N.similar_files(table(spark, sf, "layout"))


# 6: near-duplicates


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of files whose vectors, or whose names, are copies or lightly changed versions."""
    out = []
    for basis, (members, links) in (("vector", D.vector_classes(table(spark, sf, "layout"))), ("path", D.name_classes(table(spark, sf, "files")))):
        pairs = D.expand(members, links)
        out.append(pairs.select(F.lit(basis).alias("basis"), F.col("a").alias("file_a"), F.col("b").alias("file_b")))
    return out[0].unionByName(out[1]).distinct()


@query
def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every file's group by vector and by name, with its number of partners."""
    by_vector = D.grouped(*D.vector_classes(table(spark, sf, "layout"))).withColumn("basis", F.lit("vector"))
    by_name = D.grouped(*D.name_classes(table(spark, sf, "files"))).withColumn("basis", F.lit("path"))
    return by_vector.unionByName(by_name).withColumnRenamed("id", "file_id")


# 5: one ranking of search results


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first five files of every query's combined ranking."""
    ranked = R.combined(table(spark, sf, "results"), "query_id", "file_id")
    return R.first_of_groups(ranked, "query_id", "file_id", 5).select("query_id", "file_id")


_P5 = """
WITH f AS (
  SELECT query_id, file_id, max(similarity) AS sim, max(score) AS score, max(keyword::INT) AS kw, max(exact::INT) AS ex
  FROM results WHERE file_id IS NOT NULL GROUP BY ALL),
v AS (SELECT *, sim AS x, CASE WHEN score > 0 THEN ln(score) END AS y FROM f),
m AS (SELECT query_id, quantile_cont(round(x, 4), 0.5) AS mx, quantile_cont(round(y, 4), 0.5) AS my FROM v GROUP BY 1),
o AS (SELECT v.*, mx, my, round(abs(round(x, 4) - mx), 6) AS ox, round(abs(round(y, 4) - my), 6) AS oy FROM v JOIN m USING (query_id)),
d AS (SELECT query_id, quantile_cont(ox, 0.5) AS dx, avg(ox) AS ax, quantile_cont(oy, 0.5) AS dy, avg(oy) AS ay FROM o GROUP BY 1),
z AS (
  SELECT o.*, (x - mx) / CASE WHEN dx > 0 THEN dx * 1.4826 WHEN ax > 0 THEN ax * 1.2533 ELSE 1 END AS zx,
         (y - my) / CASE WHEN dy > 0 THEN dy * 1.4826 WHEN ay > 0 THEN ay * 1.2533 ELSE 1 END AS zy
  FROM o JOIN d USING (query_id)),
c AS (
  SELECT query_id, file_id, sim AS similarity, score, kw AS keyword, ex AS exact, round(exp((
    ln(coalesce(greatest(1 / (1 + exp(-zx)), 1e-6), 0.1)) + ln(coalesce(greatest(1 / (1 + exp(-zy)), 1e-6), 0.1))
    + ln(CASE WHEN kw = 1 THEN 0.9 ELSE 0.1 END) + 0.3 * ln(CASE WHEN ex = 1 THEN 0.9 ELSE 0.4 END)) / 3.3), 9) AS combined
  FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, file_id) AS rank FROM c)"""
ORACLES["p5_found"] = _P5 + "\nSELECT query_id, file_id FROM r WHERE rank <= 5"


@query
def p5_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All files of all queries in order."""
    ranked = R.full_order(R.combined(table(spark, sf, "results"), "query_id", "file_id"), "query_id", "file_id")
    return ranked.select("query_id", "file_id", "rank")


ORACLES["p5_ranking"] = _P5 + "\nSELECT query_id, file_id, rank FROM r"
