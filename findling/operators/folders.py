"""Counts of folders, formats and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from findling.functions import filetypes as T, paths as P

#: Reasons of a scan's report that count as problems.
PROBLEMS = ("no_access_dir", "unreadable_dir", "damaged_archive")


def valid_files(files: DataFrame) -> DataFrame:
    """Each id's newest row (greatest ``indexed_at``; ties: greatest path, size, status). Repeated rows count once."""
    rest = [c for c in files.columns if c not in ("id", "indexed_at")]
    first = [c for c in ("path", "size", "status") if c in rest]
    order = first + [c for c in rest if c not in first]
    newest = files.groupBy("id").agg(F.max(F.struct("indexed_at", *order)).alias("v"))
    return newest.select("id", *[F.col(f"v.{c}").alias(c) for c in files.columns if c != "id"])


def unsearched(report: Column) -> Column:
    """Files that a scan's report (reason -> n) left out, problems aside."""
    plain = F.map_filter(report, lambda k, v: ~k.isin(*PROBLEMS))
    return F.aggregate(F.map_values(plain), F.lit(0).cast("long"), lambda s, x: s + x)


def summary(folders: DataFrame, files: DataFrame) -> DataFrame:
    """One row per folder, empty ones too: files by status and kind, bytes, passages."""
    mail = P.suffix(F.col("path")).isin(*T.MAILS)
    searched, kind = F.col("status") == "indexed", F.col("kind")
    n = lambda c: F.count_if(c)
    counts = files.groupBy("folder_id").agg(
        F.count("*").alias("files"), n(searched).alias("indexed"), n(F.col("status") == "pending").alias("pending"),
        n((F.col("status") == "error") & (F.col("muted") == 0)).alias("errors"), n(F.col("status") == "error").alias("unreadable"),
        n(F.col("status") == "skipped").alias("skipped"), F.sum(F.when(searched, F.col("size")).otherwise(0)).alias("bytes"),
        F.sum("chunks").alias("chunks"), n(searched & (kind == "image")).alias("images"), n(searched & (kind == "doc") & ~mail).alias("docs"),
        n(searched & kind.isin("text", "code") & ~mail).alias("texts"), n(searched & (kind != "image") & mail).alias("mails"),
    )
    names = [c for c in counts.columns if c != "folder_id"]
    joined = folders.join(counts, folders["id"] == counts["folder_id"], "left")
    out = joined.select("id", folders["path"], *[F.coalesce(counts[c], F.lit(0)).alias(c) for c in names], "report")
    return out.withColumn("unsearched", F.col("skipped") + F.coalesce(unsearched(F.col("report")), F.lit(0))).drop("report")


def format_counts(files: DataFrame, containers: DataFrame) -> DataFrame:
    """``category, ext, n`` of the files searched or waiting, and of the archives looked into."""
    name = F.col("path")
    of_files = files.where(F.col("status").isin("indexed", "pending")).select(T.category(F.col("kind"), name).alias("category"), P.suffix(name).alias("ext"))
    kind = T.container_type(name)
    of_archives = containers.where(kind.isNotNull() & (kind != "mail")).select(F.lit("archives").alias("category"), P.suffix(name).alias("ext"))
    return of_files.unionByName(of_archives).where(F.col("ext") != "").groupBy("category", "ext").agg(F.count("*").alias("n"))


def type_menu(counts: DataFrame, off: DataFrame) -> DataFrame:
    """The counts with the formats switched off (category, ext), those without files as 0."""
    return counts.join(off.withColumn("is_off", F.lit(True)), ["category", "ext"], "full_outer").select(
        "category", "ext", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("is_off", F.lit(False)).alias("off")
    )


def details(files: DataFrame, examples: int = 5) -> DataFrame:
    """``folder_id, ext, n, reasons, examples``: why a folder's files aren't searched, by extension.

    Reasons by number and name; examples the newest by path.
    """
    skipped = files.where(F.col("status") == "skipped").select("folder_id", P.suffix(F.col("path")).alias("ext"), F.coalesce("error", F.lit("")).alias("why"), "path", "indexed_at")
    by_reason = skipped.groupBy("folder_id", "ext", "why").agg(F.count("*").alias("n"))
    order = Window.partitionBy("folder_id", "ext").orderBy(F.desc("indexed_at"), "path")
    some = skipped.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= examples)
    shown = some.groupBy("folder_id", "ext").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "path"))), lambda x: x["path"]).alias("examples"))
    reasons = by_reason.groupBy("folder_id", "ext").agg(
        F.sum("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "why"))), lambda x: F.concat_ws(":", x["why"], (-x["m"]).cast("string"))).alias("reasons")
    )
    return reasons.join(shown, ["folder_id", "ext"])


def merge_reports(reports: DataFrame) -> DataFrame:
    """Reports (folder_id, report: reason -> n) of several passes added up."""
    return reports.select("folder_id", F.explode("report").alias("reason", "n")).groupBy("folder_id", "reason").agg(F.sum("n").alias("n"))


def merge_examples(found: DataFrame, first: int = 5, most: int = 40) -> DataFrame:
    """Examples (reason, path) kept of each reason: the first five by path, then one of each new extension, up to forty."""
    x = found.select("reason", "path", P.suffix(F.col("path")).alias("ext")).distinct()
    by_path = Window.partitionBy("reason").orderBy("path")
    of_ext = Window.partitionBy("reason", "ext").orderBy("path")
    ranked = x.withColumn("n", F.row_number().over(by_path)).withColumn("e", F.row_number().over(of_ext))
    kept = ranked.where((F.col("n") <= first) | (F.col("e") == 1))
    return kept.withColumn("k", F.row_number().over(by_path)).where(F.col("k") <= most).select("reason", "path")


def count_under(files: DataFrame, folder: str) -> DataFrame:
    """How many searchable files a folder holds at any depth."""
    low = P.normcase(F.col("path"))
    return files.where((F.col("status") == "indexed") & P.inside_range(low, folder.lower())).agg(F.count("*").alias("n"))


def subdirs(files: DataFrame, folder: str) -> DataFrame:
    """``path, name, count`` of the folders right inside one that hold searchable files."""
    prefix = folder.rstrip("\\/") + "\\"
    inside = files.where((F.col("status") == "indexed") & P.inside_range(P.normcase(F.col("path")), folder.lower()))
    parts = F.split(F.substring(F.col("path"), len(prefix) + 1, 1_000_000), r"\\")
    named = inside.where(F.size(parts) > 1).select(F.element_at(parts, 1).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("count")).select(F.concat(F.lit(prefix), "name").alias("path"), "name", "count")


def find_dirs(files: DataFrame, folders: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Folders below the roots whose name holds the text: such that begin with it first, then by searchable files."""
    needle = text.strip().lower()
    roots = folders.select(F.col("id").alias("folder_id"), F.regexp_replace("path", r"[\\/]+$", "").alias("root"))
    inside = files.where(F.col("status") == "indexed").join(roots, "folder_id").where(P.is_inside(F.col("path"), F.col("root")))
    parts = F.split(F.substr("path", F.length("root") + 2), r"\\")
    deep = inside.select("root", parts.alias("parts")).where(F.size("parts") > 1)
    each = deep.select("root", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("i"))
    named = each.select(F.concat("root", F.lit("\\"), F.array_join(F.slice("parts", F.lit(1), F.col("i")), "\\")).alias("path"), F.element_at("parts", F.col("i")).alias("name"))
    hits = named.where(F.contains(F.lower("name"), F.lit(needle)) & F.lit(bool(needle))).groupBy("path", "name").agg(F.count("*").alias("count"))
    return hits.orderBy(~F.startswith(F.lower("name"), F.lit(needle)), F.desc("count"), F.lower("path"), "path").limit(limit)


def errors(files: DataFrame, limit: int = 500) -> DataFrame:
    """Each folder's unreadable files: such not looked at first, the newest first, up to a limit."""
    order = Window.partitionBy("folder_id").orderBy("muted", F.desc("indexed_at"), "id")
    bad = files.where(F.col("status") == "error").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return bad.select("folder_id", "id", "path", "error", (F.col("muted") != 0).alias("seen"), "n")


def facts(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.sum("chunks").alias("passages"), F.sum("size").alias("bytes"))
