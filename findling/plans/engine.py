"""The engine as one object: tables in a folder of versions, indexing runs, and searches over them."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findling.functions import filetypes as T, paths as P, text as X
from findling.operators import embedding as E, folders as FO, fusion as FU, keyword as KW, mapview as MV, passages as PA, vector as VE
from findling.operators.incremental import VersionedTarget, new_or_changed
from findling.operators.scans import unchanged
from findling.session import bounded, stored, temporary
from findling.sources.containers import read_containers
from findling.sources.documents import read_documents
from findling.sources.walk import files_of, read_files, ruled, stat_files
from findling.streaming import watch as WA

FILES = "path_key string, id bigint, folder_id bigint, path string, size bigint, mtime double, kind string, status string, chunks bigint, error string, indexed_at double, muted int"
PASSAGES = "file_id bigint, chunk int, folder_id bigint, kind string, name string, text string, page int, vector array<float>, read_at double"
LAYOUT = "file_id bigint, x double, y double, z double, mtime double, size bigint, rough boolean, gone boolean"
KINDS = "decision in ('doc', 'text', 'code', 'image')"


def hash_id(path_key: Column, salt: int) -> Column:
    """63 bits of a path's hash; the salt gives another where two paths share one."""
    hashed = F.xxhash64(path_key) if not salt else F.xxhash64(path_key, F.lit(salt))
    return hashed.bitwiseAND((1 << 63) - 1)


class NotFound(KeyError):
    """No such file or folder."""


class Invalid(ValueError):
    """A parameter out of its range."""


class Engine:
    """Files, passages and vectors of folders, searched by words and by vectors.

    ``root`` is a folder of any Hadoop file system. Each indexing run publishes one version of the passages
    and one of the files; readers see whole versions only. A run that fails in between is repeated by the
    next one, as the files' signatures are published last; of two runs at a time the later one fails.
    Texts are taken in whole; ``most`` bounds the passages of a file (``PA.MOST`` is a usual bound).
    """

    def __init__(self, spark: SparkSession, root: str, model=E.stand_in, dim: int = E.DIM, most: int | None = None):
        self.spark, self.root, self.model, self.dim, self.most = spark, root.rstrip("/"), model, dim, most
        self._merged: tuple[int, DataFrame | None] = (-1, None)
        self._files = VersionedTarget(spark, f"{self.root}/files", spark.createDataFrame([], FILES).schema, ["path_key"])
        self._passages = VersionedTarget(spark, f"{self.root}/passages", spark.createDataFrame([], PASSAGES).schema, ["file_id", "read_at", "chunk"], keep=self._wanted)
        self._layout = VersionedTarget(spark, f"{self.root}/map", spark.createDataFrame([], LAYOUT).schema, ["file_id"])

    def _known(self, version: int | None = None) -> DataFrame:
        return self._files.current(version).where("status <> 'gone'")

    def files(self) -> DataFrame:
        """Files in the index, without the containers that were opened; merged once for a version and kept."""
        version = self._files.version()
        if self._merged[0] != version:
            if self._merged[1] is not None:
                self._merged[1].unpersist()
            self._merged = (version, self._known(version).where("status <> 'container'").persist())
        return self._merged[1]

    def _of_newest(self, rows: DataFrame) -> DataFrame:
        newest = self.files().select(F.col("id").alias("file_id"), F.col("indexed_at").alias("read_at"))
        return rows.join(newest, ["file_id", "read_at"], "left_semi")

    def _wanted(self, rows: DataFrame) -> DataFrame:
        """What folding keeps: newest readings, and those of the last day, whose run may still be under way."""
        young = F.col("read_at") > time.time() - 86_400
        return self._of_newest(rows.where(~young)).unionByName(rows.where(young))

    def passages(self) -> DataFrame:
        """Passages of each file's newest reading."""
        return self._of_newest(self._passages.unmerged())

    def index(self, folder: str, folder_id: int = 1) -> int:
        """Read what is new or changed in a folder; returns how many files that was, with those taken out.

        The folder is listed, and of its files only those are opened that are new or changed. Files inside
        archives and mails count as files of a changed container; what can't be opened is a row with its
        reason. Files of ``folder_id`` that the walk no longer finds, and all inside them, are taken out, so
        every folder needs an id of its own.
        """
        with temporary(self.spark):
            base = self._files.version()
            found = self._readable(ruled(files_of(self.spark, folder)))
            own = stored(self._known(base).where(F.col("folder_id") == folder_id), "known")
            return self._take_in(folder, folder_id, base, stored(found, "seen"), own)

    def note(self, changes: DataFrame, folder: str, folder_id: int = 1) -> int:
        """Take in changes (path below the folder, event) as a watcher sees them; returns how many files that was.

        A path that is there is read if it is new or changed, a folder with all in it; one that isn't is
        taken out with all inside. Whatever the event says counts only as a reason to look.
        """
        with temporary(self.spark):
            base = self._files.version()
            named = stored(changes.select("path").where(F.col("path").isNotNull()).distinct(), "changes")
            now = stat_files(named, folder).select("*", T.skip_path(F.filter(F.split("path", r"[\\/]"), lambda x: x != "")).alias("reason"), T.decide(F.col("path"), (), ()).alias("decision"))
            touched = named.select(P.normcase(F.col("path")).alias("k"))
            own = self._known(base).where(F.col("folder_id") == folder_id)
            at_or_above = F.array_union(P.ancestors(F.col("path_key")), F.array("path_key"))
            hit = own.select("path_key", F.explode(at_or_above).alias("k")).join(touched, "k", "left_semi").select("path_key").distinct()
            own = stored(own.join(hit, "path_key", "left_semi"), "known")
            return self._take_in(folder, folder_id, base, stored(self._readable(now), "seen"), own)

    def remove(self, folder_id: int) -> int:
        """Take a folder out of the index; returns how many files that was.

        One version marks all of its files as gone, so no search finds them from then on; their passages go
        when the tables are folded. Repeated after a failure it does what is left, or nothing.
        """
        with temporary(self.spark):
            base = self._files.version()
            gone = stored(self._known(base).where(F.col("folder_id") == folder_id), "gone")
            n, at = gone.count(), time.time()
            if n:
                out = gone.withColumn("status", F.lit("gone")).withColumn("chunks", F.lit(0).cast("long")).withColumn("indexed_at", F.lit(at))
                self._files.publish(out, f"remove-{folder_id}-{at}", base=base)
            return n

    def watch(self, events: DataFrame, folder: str, checkpoint: str, folder_id: int = 1, gap: str = "2 seconds"):
        """A streaming query that takes in events (path, event, at, n) once a path has been quiet for ``gap``.

        A batch repeated after a failure finds its files unchanged and does nothing.
        """
        quiet = WA.debounced(events.withWatermark("at", gap), "path", "at", "n", "event", gap)
        return WA.ingest(quiet, lambda batch, _: self.note(batch, folder, folder_id) if batch.limit(1).count() else None, checkpoint)

    @staticmethod
    def _readable(files: DataFrame) -> DataFrame:
        kept = files.where(f"reason is null and ({KINDS} or decision = 'archive')")
        return kept.select(P.normcase(F.col("path")).alias("path_key"), "path", "size", "mtime", F.col("decision").alias("kind"))

    def _identified(self, entries: DataFrame, known: DataFrame) -> DataFrame:
        """Entries with ``id``: a known path keeps its own, a new one gets a hash of it that no other has."""
        taken = known.select(F.col("id").alias("id"), F.col("path_key").alias("owner"))
        salt = 0
        out = entries.join(known.select("path_key", F.col("id").alias("old")), "path_key", "left")
        out = out.withColumn("id", F.coalesce("old", hash_id(F.col("path_key"), salt))).drop("old")
        while True:  # as good as never more than once: ids have 63 bits
            all_ids = out.select("id", F.col("path_key").alias("owner")).unionByName(taken).distinct()
            twice = all_ids.groupBy("id").agg(F.min("owner").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
            if not twice.limit(1).count():
                return out
            salt += 1
            old = known.select("path_key").withColumn("keeps", F.lit(True))
            out = out.join(twice, "id", "left").join(old, "path_key", "left")
            moved = F.col("first").isNotNull() & (F.col("first") != F.col("path_key")) & F.col("keeps").isNull()
            moved = moved | (F.col("first").isNotNull() & F.col("keeps").isNull() & F.lit(salt > 1))
            out = stored(out.withColumn("id", F.when(moved, hash_id(F.col("path_key"), salt)).otherwise(F.col("id"))).drop("first", "keeps"), "ids")

    def _take_in(self, folder: str, folder_id: int, base: int, keyed: DataFrame, own: DataFrame) -> int:
        """Publish what of ``keyed`` is new or changed, and what of ``own`` is no longer there."""
        at = time.time()
        known = self._known(base)
        todo = stored(new_or_changed(keyed, known, ["path_key"], unchanged), "todo")
        opening = todo.where((F.col("kind") == "archive") | (T.container_type(F.col("path")) == "mail"))
        most = F.when(F.col("kind") == "archive", F.lit(None).cast("long")).otherwise(T.max_bytes(F.col("kind"), F.col("path")))
        bodies = read_files(todo.select("path", most.alias("most")), folder)
        # each file is opened once: what containers hold is kept aside with what was read
        bodies = stored(bodies.join(todo.select("path", "kind"), "path"), "bodies")
        inside = stored(read_containers(bodies.where("problem is null").join(opening.select("path"), "path", "left_semi")), "inside")
        rules = ruled(inside.select("path", "size", "mtime")).select("path", "reason", "decision")
        inner = inside.join(rules.dropDuplicates(["path"]), "path").where(f"problem is not null or (reason is null and {KINDS})")
        inner = inner.withColumn("path_key", P.normcase(F.col("path")))
        top = todo.select("path_key").withColumn("top", F.lit(True))
        # a problem of a whole container is the container's own row
        whole = inner.join(top, "path_key", "left_semi").groupBy("path_key").agg(F.max("problem").alias("trouble"))
        unread = bodies.where("problem is not null").select(P.normcase(F.col("path")).alias("path_key"), F.col("problem").alias("trouble"))
        whole = whole.unionByName(unread).groupBy("path_key").agg(F.max("trouble").alias("trouble"))
        inner = stored(inner.join(top, "path_key", "left_anti").dropDuplicates(["path_key"]), "inner")
        # what a changed container no longer holds goes, as do files no longer found; the rest inside stays
        kept = keyed.select("path_key").unionByName(inner.select("path_key"))
        still = keyed.join(opening.select("path_key"), "path_key", "left_anti").select(F.col("path_key").alias("k"))
        above = own.select("path_key", F.explode(P.ancestors(F.col("path_key"))).alias("k")).join(still, "k", "left_semi").select("path_key")
        gone = stored(own.join(kept.unionByName(above).distinct(), "path_key", "left_anti"), "gone")
        n, removed = todo.count() + inner.count(), gone.count()
        if not n and not removed:
            return 0
        contents = bodies.where("problem is null and kind <> 'archive'").select("path", "content").unionByName(inner.where("problem is null").select("path", "content"))
        read = read_documents(contents).select("path", "text", "error")
        cols = ["path_key", "path", "size", "mtime", "kind", "trouble"]
        inner = inner.select("path_key", "path", "size", "mtime", F.coalesce("decision", F.lit("archive")).alias("kind"), F.col("problem").alias("trouble"))
        entries = todo.join(whole, "path_key", "left").select(*cols).unionByName(inner.select(*cols))
        entries = entries.join(read, "path", "left")
        entries = entries.withColumn("error", F.coalesce("error", F.when((F.col("kind") == "archive") | F.col("text").isNull(), F.concat(F.lit("!"), F.col("trouble")))))
        entries = stored(self._identified(stored(entries, "read"), known), "entries")
        cut = PA.chunk(entries.where("text is not null"), ["id", "path", "kind"], most=self.most)
        titled = cut.withColumn("embedded", PA.embedded_text(P.embed_title(F.concat(F.lit("\\"), F.translate("path", "/", "\\")), F.lit("")), F.col("text")))
        vectors = E.embed(titled, "embedded", self.model, self.dim)
        rows = vectors.select(F.col("id").alias("file_id"), F.col("chunk").cast("int").alias("chunk"), F.lit(folder_id).cast("long").alias("folder_id"), "kind", F.when(F.col("chunk") == 0, P.base_name(F.col("path"))).otherwise("").alias("name"), "text", F.col("page").cast("int").alias("page"), "vector", F.lit(at).alias("read_at"))
        version = self._passages.publish(rows, f"run-{at}")
        counts = self._passages.added(version).groupBy("file_id").agg(F.count("*").alias("chunks"))
        status = F.when(F.col("error").isNull() & (F.col("kind") == "archive"), "container").when(F.col("error").isNull(), "indexed").when(F.col("error").rlike("^!(damaged|no_memory|gone|no_access|in_use)"), "error").otherwise("skipped")
        saved = entries.join(counts.withColumnRenamed("file_id", "id"), "id", "left").select(
            "path_key", "id", F.lit(folder_id).cast("long").alias("folder_id"), "path", "size", "mtime", "kind", status.alias("status"),
            F.coalesce("chunks", F.lit(0)).alias("chunks"), "error", F.lit(at).alias("indexed_at"), F.lit(0).alias("muted"),
        )
        out = gone.withColumn("status", F.lit("gone")).withColumn("chunks", F.lit(0).cast("long")).withColumn("indexed_at", F.lit(at))
        self._files.publish(saved.unionByName(out.select(*saved.columns)), f"run-{at}", base=base)
        return n + removed

    def _chosen(self, limit: int, kind: str | None, folder_id: int | None, under: str | None, file_ids) -> DataFrame:
        """Passages of the files that the filters leave; those that aren't given don't count."""
        if not 0 <= limit <= 100:
            raise Invalid("limit must lie between 0 and 100")
        kinds = {"docs": ["doc"], "text": ["text", "code"], "code": ["text", "code"], "images": ["image"]}.get(kind or "")
        p = self.passages()
        p = p.where(F.col("kind").isin(*kinds)) if kinds else p
        p = p.where(F.col("folder_id") == folder_id) if folder_id else p
        if under:
            inside = self.files().where(P.inside_range(F.col("path_key"), under.replace("/", "\\").lower()))
            p = p.join(inside.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        if file_ids is not None:  # a table of any size, or a list of few; an empty one leaves nothing
            ids = file_ids if isinstance(file_ids, DataFrame) else self.spark.createDataFrame([(i,) for i in file_ids], "file_id bigint")
            p = p.join(ids.select("file_id").distinct(), "file_id", "left_semi")
        return p

    def search(self, query: str, limit: int = 30, kind: str | None = None, folder_id: int | None = None, under: str | None = None, file_ids=None, order: str | None = None) -> DataFrame:
        """Files for a query, fused from words and vectors, the likely ones first.

        Words that more than half of the passages hold can't rank anything and are left out. ``order`` sorts
        each part by name, date, size or type instead.
        """
        p = self._chosen(limit, kind, folder_id, under, file_ids)
        if not query.strip():
            limit = 0
        q = self.spark.createDataFrame([(0, query)], "query_id int, query string").withColumn("terms", X.query_terms(F.col("query")))
        terms, weight = q.select("terms", FU.keyword_weight(F.col("query"), F.col("terms"))).first()
        v = list(map(float, self.model([E.QUERY_PROMPT + query])[0]))
        # ranked first on what ranking needs: a few hundred rows, whose texts and files are looked up after
        hits = KW.bm25_single(p, ["file_id", "chunk"], terms, limit * 4, prefix=True, drop_common=True, counted=self.passages()).collect()
        near = VE.knn(p.select("file_id", "chunk", "vector"), v, limit * 6, ["file_id", "chunk"]).select("file_id", "chunk", "similarity").collect()
        words, lookup = [], []
        if hits:
            scores = {(r["file_id"], r["chunk"]): r["score"] for r in hits}
            these = p.where(F.col("file_id").isin(sorted({f for f, _ in scores})))
            exact = X.has_all_terms(F.array(*map(F.lit, terms)), F.concat_ws(" ", "name", "text"))
            # a file found by words only has a similarity, too: that of its best passage
            best: dict[int, float] = {}
            for f, c, said, similarity in VE.scored(these, v).select("file_id", "chunk", exact, "similarity").collect():
                best[f] = max(best.get(f, -1.0), similarity if similarity is not None else -1.0)
                if (f, c) in scores:
                    words.append((0, f, c, scores[f, c], said, weight))
            lookup = [(0, f, s) for f, s in best.items() if s > -1.0]
        make = self.spark.createDataFrame
        found = FU.fuse(
            make([(0, *r) for r in near], "query_id int, file_id bigint, chunk int, similarity double"),
            make(words, "query_id int, file_id bigint, chunk int, bm25 double, exact boolean, weight double"),
            lookup=make(lookup, "query_id int, file_id bigint, similarity double"), limit=limit,
        )
        ids = sorted({r["file_id"] for r in near} | {f for _, f, *_ in words})
        facts = self.files().where(F.col("id").isin(ids)).select(F.col("id").alias("file_id"), "path", "size", "mtime", "kind", (F.col("kind") == "image").alias("picture"))
        out = FU.partition_likely(FU.likely(found.join(facts, "file_id")))
        return FU.sort_results(out, order).orderBy("shown")

    def _like(self, mean: np.ndarray, own: int | None, limit: int, query: str | None, near: bool, **filters) -> DataFrame:
        p = self._chosen(limit, filters.get("kind"), filters.get("folder_id"), filters.get("under"), filters.get("file_ids"))
        v = np.asarray(mean, np.float64)
        words = bool(query and query.strip())
        if words:
            v = v + np.asarray(self.model([E.QUERY_PROMPT + query])[0], np.float64)
            v = v / max(float(np.linalg.norm(v)), 1e-9)
        p = p.where(F.col("file_id") != own) if own is not None else p
        hits = VE.knn(p.select("file_id", "chunk", "vector"), list(map(float, v)), limit * 6, ["file_id", "chunk"]).select("file_id", "chunk", "similarity").collect()
        make = self.spark.createDataFrame
        none = make([], "query_id int, file_id bigint, chunk int, bm25 double, exact boolean, weight double")
        fused = FU.fuse(make([(0, *r) for r in hits], "query_id int, file_id bigint, chunk int, similarity double"), none, limit=limit).select("file_id", "chunk", "similarity", "rank")
        # the means of the files found: at most six times the limit
        means = VE.mean_vectors(self.passages().where(F.col("file_id").isin(sorted({r["file_id"] for r in hits}))))
        alike = VE.scored(means, list(map(float, mean))).select("file_id", (F.col("similarity") >= VE.NEAR).alias("near"))
        marked = fused.join(alike, "file_id", "left").withColumn("near", F.coalesce("near", F.lit(False)) & F.lit(near and not (words and own is not None)))
        return marked.orderBy(F.desc("near"), "rank").select("file_id", "chunk", "similarity", "near")

    def similar(self, file_id: int, limit: int = 30, query: str | None = None, **filters) -> DataFrame:
        """Files whose passages are like a file as a whole, and like words where such are given.

        Copies and versions, whose means are nearly the same, come first and are marked, unless words make
        it a search of its own. Filters as in ``search``.
        """
        own = VE.mean_vectors(self.passages().where(F.col("file_id") == file_id)).collect()
        if not own:
            raise NotFound(file_id)
        return self._like(np.asarray(own[0]["vector"]), file_id, limit, query, True, **filters)

    def similar_to(self, texts: list[str], limit: int = 30, query: str | None = None, **filters) -> DataFrame:
        """The same for texts that aren't in the index: at most 24 passages' mean vector."""
        parts = [p for t in texts for _, p in PA.windows(t)][:24]
        if not parts:
            raise Invalid("nothing to compare with")
        v = np.mean(self.model([f"title: none | text: {p}" for p in parts]), axis=0)
        return self._like(v / (np.linalg.norm(v) or 1.0), None, limit, query, True, **filters)

    def similar_to_file(self, name: str, content: bytes, limit: int = 30, query: str | None = None, **filters) -> DataFrame:
        """The same for a file that isn't in the index, read as indexing reads it."""
        row = read_documents(self.spark.createDataFrame([(name, bytearray(content))], "path string, content binary")).first()
        if row["text"] is None:
            raise Invalid(row["error"])
        return self.similar_to([row["text"]], limit, query, **filters)

    def vector(self, file_id: int) -> tuple[list[float], str]:
        """A file's mean vector to four decimals and the start of its first passage."""
        rows = VE.mean_vectors(self.passages().where(F.col("file_id") == file_id)).collect()
        if not rows:
            raise NotFound(file_id)
        first = self.text(file_id).first()
        return [round(x, 4) for x in rows[0]["vector"]], first["text"][:600]

    def related(self, file_id: int) -> DataFrame:
        """Every file's similarity to one, to three decimals, with what a map draws by it."""
        own, _ = self.vector(file_id)
        hits = VE.scored(VE.mean_vectors(self.passages()), own).select("file_id", F.round("similarity", 3).alias("similarity"))
        return VE.related_weights(hits)

    def dimension(self, number: int) -> DataFrame:
        """One component of every file's mean vector, to four decimals."""
        if not 0 <= number < self.dim:
            raise Invalid(f"a dimension lies between 0 and {self.dim - 1}")
        return VE.mean_vectors(self.passages()).select("file_id", F.round(F.element_at("vector", number + 1), 4).alias("value"))

    def map(self, most: int = MV.MOST, epochs: int = 400) -> DataFrame:
        """``file_id, x, y, z, rough`` of a sample of bounded size, kept from run to run.

        Files that didn't change keep their place, new ones go near their like; made anew, and turned onto
        the map before, when too few are kept or too many were only placed. Each map is a version.
        """
        means = VE.mean_vectors(self.passages())
        facts = self.files().select(F.col("id").alias("file_id"), "mtime", "size")
        points = bounded(MV.sample(means.join(facts, "file_id"), most=most), most, "points of the map")
        before = {r["file_id"]: r for r in bounded(self._layout.current().where("not gone"), 2 * most, "points of the map before")}
        ids = [r["file_id"] for r in points]
        x = np.array([r["vector"] for r in points], np.float64).reshape(len(ids), self.dim)
        same = np.array([i in before and (before[i]["mtime"], before[i]["size"]) == (r["mtime"], r["size"]) for i, r in zip(ids, points)], bool)
        old = np.array([[before[i]["x"], before[i]["y"], before[i]["z"]] if i in before else [0.0] * 3 for i in ids]).reshape(-1, 3)
        rough = np.array([bool(before[i]["rough"]) if s else True for i, s in zip(ids, same)], bool)
        kept = int(same.sum())
        if kept == len(ids) == len(before):
            return self._drawn()
        if MV.redo(kept, len(ids) - kept, int((rough & same).sum())):
            y, rough = self._laid_out(means, x, epochs), np.zeros(len(ids), bool)
            rows = self.spark.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, y)], "file_id bigint, x double, y double, z double")
            fitted = {r["file_id"]: (r["x"], r["y"], r["z"]) for r in (MV.fit(rows, ["x", "y", "z"]).collect() if ids else [])}
            y = np.array([fitted[i] for i in ids]).reshape(-1, 3)
            if kept >= 4:
                y = MV.align_by(y, same, old[same])
        else:
            y = old
            if kept < len(ids):
                y[~same] = MV.place(x[~same], x[same], old[same], np.array(ids)[~same])
        rows = [(i, *map(float, p), float(r["mtime"]), r["size"], bool(g), False) for i, p, r, g in zip(ids, y, points, rough)]
        rows += [(i, 0.0, 0.0, 0.0, 0.0, 0, False, True) for i in set(before) - set(ids)]
        self._layout.publish(self.spark.createDataFrame(rows, LAYOUT), f"map-{time.time()}")
        return self._drawn()

    def _drawn(self) -> DataFrame:
        return self._layout.current().where("not gone").select("file_id", "x", "y", "z", "rough")

    def _laid_out(self, means: DataFrame, x: np.ndarray, epochs: int) -> np.ndarray:
        if len(x) >= MV.LEAST_TSNE:
            mean, comps = MV.principal(means, "vector", self.dim, 50)
            return MV.tsne((x - mean) @ comps.T, epochs=epochs)
        y = np.zeros((len(x), 3))
        if len(x) > 1:
            u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
            y[:, : min(3, len(s))] = (u * s)[:, :3]
        return y

    def highlight(self, query: str, most: int = 40, shown: int = 12) -> DataFrame:
        """What a map marks for a query: all words found, or nearly as similar as the best; the first few."""
        return FU.highlighted(self.search(query, most), shown)

    def folders(self, folders: DataFrame) -> DataFrame:
        """Counts of every folder given (id, path, report)."""
        return FO.summary(folders, self.files())

    def filetypes(self, off: DataFrame | None = None) -> DataFrame:
        """Formats of the files in the index with their numbers, and those switched off."""
        none = self.spark.createDataFrame([], "path string")
        counts = FO.format_counts(self.files(), none)
        return FO.type_menu(counts, off if off is not None else self.spark.createDataFrame([], "category string, ext string"))

    def subdirs(self, folder: str) -> DataFrame:
        return FO.subdirs(self.files(), folder)

    def errors(self, limit: int = 500) -> DataFrame:
        return FO.errors(self.files(), limit)

    def details(self) -> DataFrame:
        return FO.details(self.files())

    def text(self, file_id: int) -> DataFrame:
        return self.passages().where(F.col("file_id") == file_id).select("chunk", "page", "text").orderBy("chunk")

    def status(self) -> dict:
        row = FO.facts(self.files()).collect()[0]
        return {**row.asDict(), "version": self._files.version()}
