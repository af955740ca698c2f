"""One list of files from vector hits and keyword hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from findling.functions import paths as P, text as X

K, BONUS = 60.0, 1.0 / 60.0
LIKELY_TEXT, LIKELY_PICTURE, MARGIN = 0.73, 0.71, 0.04


def keyword_weight(query: Column, terms: Column) -> Column:
    """Words count in full in short queries and in such that look like an identifier, else half."""
    return F.when((F.size(terms) <= 3) | X.looks_like_identifier(query), 1.0).otherwise(0.5)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, lookup: DataFrame | None = None, query_key: str = "query_id", limit: int | None = None) -> DataFrame:
    """``query, file_id, chunk, similarity, score, keyword, exact, rank`` by reciprocal ranks.

    ``vector_hits`` (query, file_id, chunk, similarity) and ``keyword_hits`` (query, file_id, chunk, bm25,
    exact, weight) may hold several chunks of a file; the first of each list counts, ranks run over distinct
    files. A file found both ways shows the keyword chunk if all words stand there. ``lookup`` (query,
    file_id, similarity) gives the similarity of files found by words only.
    """
    q = query_key

    def first(hits: DataFrame, by: str, extra: list[str]) -> DataFrame:
        within = Window.partitionBy(q, "file_id").orderBy(F.desc(by), "chunk")
        over = Window.partitionBy(q).orderBy(F.desc(by), "file_id", "chunk")
        one = hits.withColumn("n", F.row_number().over(within)).where(F.col("n") == 1)
        return one.withColumn("r", F.row_number().over(over) - 1).select(q, "file_id", "chunk", "r", *extra)

    v = first(vector_hits, "similarity", ["similarity"]).select(q, "file_id", F.col("chunk").alias("vc"), F.col("r").alias("rv"), "similarity")
    w = first(keyword_hits, "bm25", ["exact", "weight"]).select(q, "file_id", F.col("chunk").alias("kc"), F.col("r").alias("rk"), "exact", "weight")
    both = v.join(w, [q, "file_id"], "full_outer")
    if lookup is not None:
        both = both.join(lookup.select(q, "file_id", F.col("similarity").alias("looked")), [q, "file_id"], "left")
    else:
        both = both.withColumn("looked", F.lit(None).cast("double"))
    exact, keyword = F.coalesce("exact", F.lit(False)), F.col("rk").isNotNull()
    score = F.coalesce(1 / (K + F.col("rv")), F.lit(0.0)) + F.coalesce(F.col("weight") / (K + F.col("rk")) + F.when(exact, BONUS).otherwise(0.0), F.lit(0.0))
    fused = both.select(
        q, "file_id", F.when(keyword & (exact | F.col("vc").isNull()), F.col("kc")).otherwise(F.col("vc")).alias("chunk"),
        X.round4(F.coalesce("similarity", "looked")).alias("similarity"), score.alias("score"), keyword.alias("keyword"), exact.alias("exact"),
        F.coalesce(F.col("rv").cast("double"), F.lit(1e9) + F.col("rk")).alias("ord"),
    )
    order = Window.partitionBy(q).orderBy(F.desc("exact"), F.desc(F.col("similarity").isNotNull()), F.desc("similarity"), F.desc(F.round("score", 9)), "ord", "file_id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).drop("ord")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def likely(results: DataFrame, picture: str = "picture", query_key: str = "query_id") -> DataFrame:
    """Results with ``likely``: all words found, or similar enough by itself and near the best of its kind.

    If that is none and no result has a similarity, the first three are.
    """
    best = F.max("similarity").over(Window.partitionBy(query_key, picture))
    bar = F.when(F.col(picture), LIKELY_PICTURE).otherwise(LIKELY_TEXT)
    good = F.col("exact") | F.coalesce((F.col("similarity") >= bar) & (F.col("similarity") >= best - MARGIN), F.lit(False))
    whole = Window.partitionBy(query_key)
    some = results.withColumn("good", good)
    none = ~F.max("good").over(whole) & (F.count("similarity").over(whole) == 0)
    return some.withColumn("likely", F.col("good") | (none & (F.col("rank") <= 3))).drop("good")


def partition_likely(results: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Likely results first, else in order; ``n_likely`` is their number."""
    order = Window.partitionBy(query_key).orderBy(F.desc("likely"), "rank")
    return results.withColumn("shown", F.row_number().over(order)).withColumn("n_likely", F.sum(F.col("likely").cast("int")).over(Window.partitionBy(query_key)))


def highlighted(results: DataFrame, shown: int = 12, margin: float = 0.03, query_key: str = "query_id") -> DataFrame:
    """Results to mark: all words found, or within ``margin`` of the query's best similarity; the first ``shown`` by rank."""
    best = F.max("similarity").over(Window.partitionBy(query_key))
    good = results.where("rank is not null").withColumn("__best", best).where(F.col("exact") | (F.col("similarity") >= F.col("__best") - margin))
    return good.withColumn("mark", F.row_number().over(Window.partitionBy(query_key).orderBy("rank"))).where(F.col("mark") <= shown).drop("__best")


#: The order of kinds when results are sorted by type.
KIND_ORDER = ("doc", "text", "code", "image")


def natural(name: Column) -> Column:
    """A name as it sorts when numbers count as numbers: in lower case, each run of digits padded to twenty."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1), lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)), "")


def sort_results(results: DataFrame, by: str | None, query_key: str = "query_id", part: str = "likely") -> DataFrame:
    """Results with ``shown`` by name, date, size or type inside each part; ties keep the order before.

    Newest and largest come first; types go by kind, extension and name. Null changes nothing.
    """
    if by is None:
        return results
    name = P.base_name(F.col("path"))
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KIND_ORDER)], F.lit(len(KIND_ORDER)))
    orders = {"name": [natural(name)], "date": [F.desc("mtime")], "size": [F.desc("size")], "type": [kind, P.suffix(name), natural(name)]}
    if by not in orders:
        raise ValueError(f"sort by {', '.join(orders)}")
    order = Window.partitionBy(query_key).orderBy(F.desc(part), *orders[by], "rank")
    return results.withColumn("shown", F.row_number().over(order))
