import io
import zipfile
from email.message import EmailMessage

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.functions import filetypes as T, paths as P, text as X
from findling.operators import embedding as E, fusion as FU, keyword as KW, mapview as MV, passages as PA, state as ST
from findling.operators.incremental import ConcurrentPublish, VersionedTarget, new_or_changed, run_once
from findling.operators.scans import changed_paths, replay_scans
from findling.session import scratch
from findling.sources import containers as C, documents as D
from findling.streaming import watch as WA


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*[F.col(n) for n in names])).collect()[0][0]


@pytest.mark.parametrize("query, terms", [
    ("letter from my landlord about the rent", ["letter", "landlord", "rent"]), ("IMG_0042", ["img", "0042"]),
    ("Grüße aus Köln", ["gruße", "koln"]), ("the", ["the"]), ("", []), (" a 7 ", ["7"]),
])
def test_query_terms(spark, query, terms):
    assert one(spark, X.query_terms, query) == terms


@pytest.mark.parametrize("terms, text, ok", [
    ("invoice 2026", "Invoices_2026.pdf", True), ("cat", "catalog", False), ("cat", "cat_food.md", True), ("img 0043", "IMG_0042.jpg", False), ("", "x", True),
])
def test_all_terms(spark, terms, text, ok):
    got = spark.createDataFrame([(terms.split(), text)], "t array<string>, x string").select(X.has_all_terms(F.col("t"), F.col("x"))).collect()[0][0]
    assert got is ok


@pytest.mark.parametrize("name, kind, why", [
    ("a.PDF", "doc", "doc"), ("x.rs", "code", "code"), ("Makefile", "code", "code"), ("README", "text", "text"), ("song.mp3", None, "media"),
    ("Setup.exe", None, "program"), ("Postfach.pst", None, "mailbox"), ("Plakat.eps", None, "type"), ("a.tar.gz", None, "archive"), (".env", None, "type"), ("x.", None, "type"),
])
def test_names(spark, name, kind, why):
    assert one(spark, T.kind_of, name) == kind
    assert one(spark, T.decide, name) == why


@pytest.mark.parametrize("name, what", [("a.tar.gz", "tar"), ("notes.txt.gz", "single"), ("a.7Z", "library"), ("m.msg", "mail"), ("x.txt", None)])
def test_containers_by_name(spark, name, what):
    assert one(spark, T.container_type, name) == what


@pytest.mark.parametrize("path, reason", [
    ("Android\\data\\x.txt", "program_folder"), ("a\\Drache.kra~", "backup"), ("~$brief.docx", "office_temp"), ("a\\.env", "hidden"), ("node_modules\\a.js", "program_folder"),
    ("$Recycle.Bin\\a.txt", "hidden"), ("a\\b.txt", None), ("a.bak", "backup"),
])
def test_skipped(spark, path, reason):
    assert one(spark, lambda p: T.skip_path(F.split(p, r"\\")), path) == reason


def test_neighbours_arent_inside(spark):
    rows = ["C:\\Docs\\a", "C:\\docs\\Sub\\a", "C:\\Docs2\\a", "C:\\Docs]\\a", "C:\\Docs\\f.zip\\in\\a"]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    assert [r[0] for r in df.where(P.inside_range(P.normcase(F.col("path")), "c:\\docs")).collect()] == [rows[0], rows[1], rows[4]]
    assert df.where(P.is_inside(F.col("path"), F.lit("C:\\Docs"))).count() == 3


def test_tidy(spark):
    assert one(spark, X.tidy, "  Hello   world  \r\n\r\n\r\n\r\nBye\t ") == "Hello world\n\nBye"
    assert one(spark, X.tidy, "a\n    indented  twice\t\nb") == "a\n    indented twice\nb"


def test_html(spark):
    assert one(spark, X.strip_html, "<p>a&amp;b</p><script>x()</script>").strip() == "a&b"
    assert D.web_page("<html><body><p>One</p><p>Two <b>three</b></p></body>") == "One\nTwo three"
    assert D.notebook('{"cells": [{"source": ["a\\n", "b"]}, {"source": "c"}]}') == "a\nb\n\nc"
    assert one(spark, X.notebook_text, "no json") == "no json"
    assert one(spark, X.notebook_text, '{"cells": [{"source": ["a\\n", "b"]}, {"source": "c"}]}') == "a\nb\n\nc"


def test_windows_cover_the_text():
    text = " ".join(f"word{i}" for i in range(3000))
    got = PA.windows(text)
    assert all(len(t) <= 1500 for _, t in got) and {w for _, t in got for w in t.split()} == set(text.split())
    assert PA.windows("") == [] and PA.windows("x" * 4000)[0][1] == "x" * 1500


def test_pages(spark):
    text = "\f".join("\f" * (k == 0) + " ".join([w] * 300) for k, w in enumerate(("eins", "zwei", "drei")))
    rows = PA.chunk(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).collect()
    first = {r["text"].split()[0]: r["page"] for r in reversed(rows)}
    assert first["eins"] == 1 and rows[-1]["page"] == 3


def test_bm25_counts_names_fourfold(spark):
    p = spark.createDataFrame([(1, 0, "rent", "x"), (2, 0, None, "rent rent"), (3, 0, "other", "y y")], "file_id int, chunk int, name string, text string")
    q = spark.createDataFrame([(1, ["rent"])], "query_id int, terms array<string>")
    assert [r["file_id"] for r in KW.bm25(p, ["file_id", "chunk"], q, "query_id", "terms", 5).orderBy("rank").collect()] == [1, 2]
    assert KW.bm25(p, ["file_id", "chunk"], spark.createDataFrame([(1, ["oth"])], q.schema), "query_id", "terms", 5, prefix=True).collect()[0]["file_id"] == 3


def test_fusion_and_likely(spark):
    v = spark.createDataFrame([(0, 1, 0, 0.8), (0, 2, 0, 0.7), (0, 3, 0, 0.75)], "query_id int, file_id int, chunk int, similarity double")
    k = spark.createDataFrame([(0, 2, 1, 5.0, True, 1.0)], "query_id int, file_id int, chunk int, bm25 double, exact boolean, weight double")
    rows = FU.fuse(v, k).orderBy("rank").collect()
    assert [r["file_id"] for r in rows] == [2, 1, 3] and rows[0]["chunk"] == 1
    for sims, want in (([0.80, 0.70, 0.69], [1, 0, 0]), ([0.78, 0.76, 0.75, 0.60], [1, 1, 1, 0]), ([None, None], [1, 1]), ([0.5, 0.4], [0, 0])):
        r = spark.createDataFrame([(0, i + 1, s, False, False) for i, s in enumerate(sims)], "query_id int, rank int, similarity double, exact boolean, picture boolean")
        assert [int(x["likely"]) for x in FU.likely(r).orderBy("rank").collect()] == want


SCHEMA = "path_key string, v bigint"


def test_target_publishes_whole_versions_once(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], SCHEMA)
    t = VersionedTarget(spark, scratch(spark, "t"), df.schema, ["path_key"])
    assert t.version() == 0 and t.current().count() == 0
    same = lambda s, x: s("v") == x("v")
    assert run_once(t, df, "one", lambda x: x, same) == 1
    assert run_once(t, df, "one", lambda x: x, same) == 1  # repeated: nothing new
    assert new_or_changed(df, t.current(), ["path_key"], same).count() == 0
    run_once(t, spark.createDataFrame([("a", 2), ("b", 1)], SCHEMA), "two", lambda x: x, same)
    assert sorted((r.path_key or "", r.v) for r in t.current().collect()) == [("", 1), ("a", 2), ("b", 1)]
    assert t.deltas(since=1).count() == 1
    with pytest.raises(ConcurrentPublish):
        t._create({"version": 2, "data": [], "sources": []})
    # a run that died after its data was written leaves nothing that a reader sees
    df.write.parquet(f"{t.path}/delta-dead")
    assert t.current().count() == 3
    t.compact()
    assert t.current().count() == 3 and len(t.manifest()["data"]) == 1


def test_a_late_writer_fails_and_nothing_repeats(spark):
    same = lambda s, x: s("v") == x("v")
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    t = VersionedTarget(spark, scratch(spark, "race"), rows().schema, ["path_key"])
    handed = []

    def slowly(new):
        run_once(t, rows(("a", 2), ("b", 1)), "s2", lambda x: x, same)  # another run publishes meanwhile
        handed.append(new)
        return new

    with pytest.raises(ConcurrentPublish):
        run_once(t, rows(("a", 1), ("b", 1)), "s1", slowly, same)
    assert sorted((r.path_key, r.v) for r in t.current().collect()) == [("a", 2), ("b", 1)] and t.deltas().count() == 2
    run_once(t, rows(("b", 1), ("c", 1)), "s3", lambda x: x, same)
    assert sorted((r.path_key, r.v) for r in t.deltas(since=1).collect()) == [("c", 1)]


def test_target_folds_its_folders_and_keeps_history(spark):
    rows = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    t = VersionedTarget(spark, scratch(spark, "fold"), rows().schema, ["path_key"], folders=3)
    for k in range(7):
        t.publish(rows(("a", k), (f"k{k}", k)), f"run-{k}")
        assert len(t.manifest()["data"]) <= 3
    assert sorted((r.path_key, r.v) for r in t.current().collect()) == [("a", 6), *((f"k{k}", k) for k in range(7))]
    assert t.deltas().count() == 14 and t.deltas(since=5).count() == 4
    version = t.version()
    assert t.publish(rows(("z", 1)), "run-3") == version  # taken in already, folded or not
    rows(("a", 9)).write.parquet(f"{t.path}/delta-dead")
    assert t.clean(older=3600) == [] and t.clean(older=-3600) == ["delta-dead"]
    assert t.deltas().count() == 14
    base = t.publish(rows(("y", 1)), "one more")
    assert len(t.manifest(base)["data"]) > 1
    folded = t.compact()  # doesn't count as another run's work
    assert t.publish(rows(("z", 1)), "on an older base", base=base) == folded + 1


SIGHT, SCAN = "scan_id long, folder_id long, path string, size long, mtime double, found_at timestamp, loaded_at timestamp, extra string", "scan_id long, folder_id long, started_at timestamp, finished_at timestamp, state string"
FILE = "id long, path string, size long, mtime double, status string, indexed_at double"
CONT = "path string, size long, mtime double, types string"


def test_scans(spark):
    from datetime import datetime as D_

    t = lambda d: D_(2025, 1, d)
    scans = spark.createDataFrame([(1, 1, t(1), t(1), "finished"), (2, 1, t(2), None, "failed"), (3, 1, t(3), t(3), "finished")], SCAN)
    s = lambda scan, path, size, mtime, at=1: (scan, 1, path, size, mtime, t(at), t(at), "x")
    seen = spark.createDataFrame([
        s(1, "C:\\A.txt", 5, 10.0), s(1, "c:/a.TXT", 6, 10.0, 2), s(1, "C:\\same", 1, 1.0005), s(1, "C:\\err", 1, 1.0), s(1, "C:\\null", None, None), s(1, None, 1, 1.0),
        s(2, "C:\\lost", 1, 1.0), s(3, "C:\\a.txt", 6, 10.0), s(3, "C:\\same", 1, 1.0014), s(3, "C:\\err", 1, 1.0), s(3, "C:\\null", None, None), s(9, "C:\\who", 1, 1.0),
    ], SIGHT)
    files = spark.createDataFrame([(1, "C:\\a.txt", 5, 10.0, "indexed", 5.0), (1, "C:\\a.txt", 6, 10.0, "indexed", 1.0), (2, "C:\\SAME", 1, 1.0, "indexed", 1.0), (3, "C:\\err", 1, 1.0, "error", 1.0)], FILE)
    conts = spark.createDataFrame([], CONT)
    got = sorted(tuple(r) for r in changed_paths(seen, scans, files, conts).collect())
    assert got == [(1, "c:\\a.txt"), (1, "c:\\err"), (1, "c:\\null"), (3, "c:\\same")]
    path = scratch(spark, "again")
    replay_scans(seen, scans, files, conts, path)
    target = replay_scans(seen, scans, files, conts, path)  # a repeated run finds all rounds taken in
    assert target.version() == 3
    assert changed_paths(seen.limit(0), scans.limit(0), files.limit(0), conts).count() == 0


def test_state(spark):
    f = "id long, folder_id long, path string, size long, mtime double, kind string, status string, chunks long, error string, indexed_at double, muted int, search_name string"
    files = spark.createDataFrame([(1, 1, "C:\\a\\x.txt", 1, 1.0, "text", "error", 0, "!e", 1.0, 1, ""), (2, 1, "C:\\a.zip\\in\\y.txt", 1, 1.0, "text", "indexed", 1, None, 1.0, 0, "")], f)
    entries = spark.createDataFrame([(1, "c:/a/X.txt", 2, 2.0, "text", "error", 0, "!e", ""), (1, "C:\\b", 1, 1.0, "text", "indexed", 1, None, "")], "folder_id long, path string, size long, mtime double, kind string, status string, chunks long, error string, search_name string")
    got = {r.id: (r.size, r.muted) for r in ST.upsert_files(files, entries, 9.0).collect()}
    assert got == {1: (2, 1), 2: (1, 0), 3: (1, 0)}
    assert [r.id for r in ST.remove_paths(files, spark.createDataFrame([("C:\\A.ZIP",)], "path string")).collect()] == [1]
    found = spark.createDataFrame([("C:\\a\\X.TXT", 1, 1.0, "text", "n"), ("C:\\new", 1, 1.0, "text", "n")], "path string, size long, mtime double, kind string, search_name string")
    assert {r.id: r.status for r in ST.add_pending(files, found, 1, 2.0).collect()} == {1: "error", 2: "indexed", 3: "pending"}
    assert {r.path for r in ST.relocate(files, "C:\\a", "D:\\z").collect()} == {"D:\\z\\x.txt", "C:\\a.zip\\in\\y.txt"}
    with pytest.raises(KeyError):
        ST.settings({}, {"nonsense": 1})


def test_ranks_without_one_sorting_task(spark):
    from findling.operators.vector import nth_value

    rows = spark.range(30_000).select((F.col("id") * 7919 % 30_011).cast("double").alias("x"))
    want = sorted(i * 7919 % 30_011 for i in range(30_000))
    assert [nth_value(rows, "x", n, buckets=64, few=50) for n in (0, 17, 28_499, 29_999)] == [want[n] for n in (0, 17, 28_499, 29_999)]
    assert nth_value(rows, "x", 30_000) is None and nth_value(spark.range(500).select(F.lit(2.0).alias("x")), "x", 7, few=5) == 2.0
    numbered = ST.number_rows(spark.createDataFrame([(f"c:\\users\\{i:05d}",) for i in range(0, 3000, 3)], "k string"), "k").collect()
    assert sorted((r.k, r.n) for r in numbered) == [(f"c:\\users\\{i:05d}", i // 3 + 1) for i in range(0, 3000, 3)]
    assert ST.number_rows(spark.createDataFrame([], "k string"), "k").count() == 0


def test_map(spark):
    rng = np.random.default_rng(0)
    ids = spark.createDataFrame([(i,) for i in range(100)], "file_id long")
    ten = [r[0] for r in MV.sample(ids, most=10).collect()]
    assert ten == [r[0] for r in MV.sample(ids.where("file_id not in (0)") if 0 not in ten else ids, most=10).collect()]
    old = rng.normal(size=(12, 3))
    assert np.abs(MV.align(old * [-1, 1, 1] * 0.5 + 3, old) - old).max() < 1e-4
    x = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    mean, comps = MV.principal(df, "v", 8, 8)
    assert np.abs((x - mean) @ comps.T @ comps + mean - x).max() < 1e-9 and (comps[np.arange(8), np.abs(comps).argmax(1)] > 0).all()
    y = MV.tsne(np.concatenate([rng.normal(0, 0.1, (30, 8)), rng.normal(4, 0.1, (30, 8))]), epochs=150)
    assert np.linalg.norm(y[:30].mean(0) - y[30:].mean(0)) > np.linalg.norm(y[:30] - y[:30].mean(0), axis=1).mean()
    assert MV.redo(10, 5, 0) and not MV.redo(200, 10, 5)
    p = MV.place(x[:2] / np.linalg.norm(x[:2], axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True), rng.normal(size=(40, 3)), np.array([1, 2]), jitter=0)
    assert p.shape == (2, 3)


def docx(text):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{text}</w:body></w:document>')
    return b.getvalue()


def test_documents(spark):
    body = "<w:p><w:r><w:t>Quarterly budget</w:t></w:r><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    assert D.word(docx(body)) == "Quarterly budget\na | b"
    assert D.rich_text(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}Gr\'fc\'dfe aus K\u246?ln\par Preis: 5\'80{\*\generator x}}") == "Grüße aus Köln\nPreis: 5€"
    flat = b'<office:document xmlns:office="o" xmlns:text="t" xmlns:table="b"><office:body><office:text><text:tracked-changes>no</text:tracked-changes><text:p>Flache<text:s/>Datei</text:p></office:text></office:body></office:document>'
    assert D.open_document(flat) == "Flache Datei"
    assert D.decode("Grüße".encode("cp1252")) == "Grüße" and D.decode(b"\xff\xfea\0") == "a"
    m = EmailMessage()
    m["Subject"], m["From"] = "Hi", "a@b.test"
    m.set_content("Body\n")
    for _ in range(2):
        m.add_attachment(b"1", maintype="text", subtype="plain", filename="x.txt")
    text, attached = D.mail_parts(m.as_bytes())
    assert "Subject: Hi" in text and "Body" in text and [n for n, _ in attached] == ["x.txt", "x (2).txt"]
    rows = spark.createDataFrame([("a.docx", bytearray(docx(body))), ("b.pdf", bytearray(b"%PDF-1")), ("c.txt", bytearray(b"a\0b")), ("d.docx", bytearray(b"PK\x03\x04xx")), ("e.txt", None), ("f.txt", bytearray(b"ok"))], "path string, content binary")
    got = {r.path: (r.text, r.error) for r in D.read_documents(rows).collect()}
    assert got["f.txt"] == ("ok", None) and got["b.pdf"][1] == "!no_text" and got["c.txt"][1] == "!binary" and got["d.docx"][1] == "!damaged_archive" and got["e.txt"][1] == "!too_large"


def test_walk_of_containers(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "d")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("docs/a.txt", "a")
        z.writestr("DOCS/A.TXT", "second")
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("x.bin", "x")
        z.writestr("../evil", "x")
    rows = spark.createDataFrame([("o.zip", bytearray(outer.getvalue())), ("bad.zip", bytearray(b"nope")), ("a.7z", bytearray(b"7z"))], "path string, content binary")
    got = {r.path: r.problem for r in C.read_containers(rows).collect()}
    assert got == {"o.zip\\docs\\a.txt": None, "o.zip\\inner.zip\\deep.txt": None, "o.zip\\x.bin": None, "o.zip\\../evil": "odd_name", "bad.zip": "damaged_archive", "a.7z": "needs_windows"}


def test_embedding(spark):
    assert E.runs([1000, 900, 600, 300, 300], 2048) == [(0, 2), (2, 5)]

    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return E.stand_in(texts, 8)

    rows = spark.createDataFrame([(1, "good one"), (2, "bad"), (3, None)], "id int, t string")
    got = {r.id: r for r in E.embed(rows, "t", model, 8).collect()}
    assert got[2].embed_error == "!embed_failed" and abs(sum(x * x for x in got[1].vector) - 1) < 1e-5


def test_debounce_as_a_stream(spark, tmp_path):
    rows = [("a", 1, "created", 0), ("a", 2, "modified", 1), ("a", 3, "removed", 9), ("b", 4, "created", 0), ("z", 5, "created", 60)]
    df = spark.createDataFrame(rows, "path string, n int, event string, s int").select("path", "n", "event", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    batch = sorted((r.path, r.event) for r in WA.debounced(df, "path", "ts", "n", "event").collect())
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    got = []
    WA.ingest(WA.debounced(stream, "path", "ts", "n", "event"), lambda b, i: got.extend((r.path, r.event) for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert batch == [("a", "modified"), ("a", "removed"), ("b", "created"), ("z", "created")]
    assert sorted(got) == batch[:3]  # the last one isn't quiet yet


def test_engine(spark, tmp_path):
    from findling.plans.engine import Engine, Invalid, NotFound

    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("rent contract for the flat")
    (root / "sub" / "b.md").write_text("holiday in Italy")
    (root / "~$c.docx").write_text("lock")
    e = Engine(spark, f"file://{tmp_path}/index")
    assert e.index(f"file://{root}") == 2 and e.index(f"file://{root}") == 0
    assert e.search("rent").first()["path"] == "a.txt" and e.search("  ").count() == 0
    (root / "a.txt").write_text("nothing of the kind any more")
    assert e.index(f"file://{root}") == 1
    assert e.passages().count() == 2 and e.status()["indexed"] == 2
    fid = e.files().where("path = 'a.txt'").first()["id"]
    assert e.similar(fid).count() == 1
    assert e.similar_to(["holiday in Italy"]).first()["similarity"] > 0.5
    v, text = e.vector(fid)
    assert len(v) == 256 and text.startswith("nothing") and e.dimension(3).count() == 2 and e.related(fid).count() == 2
    assert e.map().count() == 2 and e.filetypes().count() == 2
    with pytest.raises(NotFound):
        e.similar(-1)
    with pytest.raises(Invalid):
        e.dimension(256)
    with pytest.raises(Invalid):
        e.search("x", limit=101)


def test_engine_indexes_containers_and_takes_out_what_is_gone(spark, tmp_path):
    from email.message import EmailMessage

    from findling.plans.engine import Engine

    root = tmp_path / "docs"
    root.mkdir()
    mail = EmailMessage()
    mail["Subject"] = "plans"
    mail.set_content("see the mailbody")
    mail.add_attachment("attached walrus", filename="w.txt")
    (root / "m.eml").write_bytes(mail.as_bytes())
    (root / "plain.txt").write_text("a plain zebra")
    (root / "bad.zip").write_bytes(b"nope")

    def zipped(**files):
        with zipfile.ZipFile(root / "o.zip", "w") as z:
            for n, t in files.items():
                z.writestr(f"in/{n}.txt", t)
            z.writestr("n.eml", mail.as_bytes())

    zipped(a="packed giraffe", b="packed ostrich")
    e = Engine(spark, f"file://{tmp_path}/index")
    paths = lambda: {r.path for r in e.files().collect()}
    inside = {"o.zip\\n.eml", "o.zip\\n.eml\\w.txt", "m.eml\\w.txt"}
    e.index(f"file://{root}")
    assert paths() == {"m.eml", "plain.txt", "bad.zip", "o.zip\\in\\a.txt", "o.zip\\in\\b.txt", *inside}
    assert e.files().where("path = 'bad.zip'").first()["error"] == "!damaged_archive"
    texts = lambda: " ".join(r.text for r in e.passages().collect())
    assert all(w in texts() for w in ("giraffe", "ostrich", "walrus", "mailbody", "zebra"))
    (root / "bad.zip").unlink()
    (root / "plain.txt").unlink()
    assert e.index(f"file://{root}") == 2 and e.index(f"file://{root}") == 0
    assert paths() == {"m.eml", "o.zip\\in\\a.txt", "o.zip\\in\\b.txt", *inside} and "zebra" not in texts()
    zipped(a="packed giraffe and more")
    e.index(f"file://{root}")
    assert paths() == {"m.eml", "o.zip\\in\\a.txt", *inside} and "ostrich" not in texts()
    (root / "o.zip").unlink()
    e.index(f"file://{root}")
    assert paths() == {"m.eml", "m.eml\\w.txt"}


def test_engine_opens_only_what_changed(spark, tmp_path, monkeypatch):
    from findling.plans import engine as EN

    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    for n in range(6):
        (root / "sub" / f"f{n}.txt").write_text(f"walrus number {n}")
    opened = []
    real = EN.read_files

    def counting(paths, folder):
        opened.append(sorted(r["path"] for r in paths.collect()))
        return real(paths, folder)

    monkeypatch.setattr(EN, "read_files", counting)
    e = EN.Engine(spark, f"file://{tmp_path}/index")
    e.index(f"file://{root}")
    (root / "sub" / "f3.txt").write_text("an ostrich instead")
    (root / "new.md").write_text("brand new")
    (root / "sub" / "f5.txt").unlink()
    assert e.index(f"file://{root}") == 3
    assert opened[1] == ["new.md", "sub/f3.txt"]
    ids = {r.path: r.id for r in e.files().collect()}
    assert len(set(ids.values())) == 6 and all(i >= 0 for i in ids.values())
    # what a watcher sees: a change, a removal, something passed by, a new folder
    (root / "sub" / "f0.txt").write_text("changed once more")
    (root / "sub" / "f1.txt").unlink()
    (root / "deep").mkdir()
    (root / "deep" / "g.txt").write_text("a giraffe")
    (root / "sub" / "~$l.docx").write_text("x")
    events = spark.createDataFrame([("sub/f0.txt", "modified"), ("sub\\f1.txt", "removed"), ("sub/~$l.docx", "created"), ("deep", "created"), (None, "created")], "path string, event string")
    assert e.note(events, f"file://{root}") == 3 and e.note(events, f"file://{root}") == 0
    assert {r.path for r in e.files().collect()} == {"new.md", "deep/g.txt", *(f"sub/f{n}.txt" for n in (0, 2, 3, 4))}
    assert e.files().where("path = 'sub/f0.txt'").first()["id"] == ids["sub/f0.txt"]
    assert e.index(f"file://{root}") == 0


def test_engine_ids_never_meet(spark, tmp_path, monkeypatch):
    from findling.plans import engine as EN

    real = EN.hash_id
    monkeypatch.setattr(EN, "hash_id", lambda k, salt: F.lit(7).cast("long") if salt == 0 else real(k, salt))
    root = tmp_path / "docs"
    root.mkdir()
    for n in range(3):
        (root / f"{n}.txt").write_text(f"text {n}")
    e = EN.Engine(spark, f"file://{tmp_path}/index")
    e.index(f"file://{root}")
    (root / "3.txt").write_text("text 3")
    e.index(f"file://{root}")
    rows = e.files().collect()
    assert len({r.id for r in rows}) == 4
    own = {r.file_id: r.text for r in e.passages().collect()}
    assert all(own[r.id] == f"text {r.path[0]}" for r in rows)


def test_engine_search_filters_and_orders(spark, tmp_path):
    from findling.plans.engine import Engine

    for folder, files in (("one", {"b10.txt": "the common rent contract", "b9.md": "common rent only", "sub/c.py": "common code"}), ("two", {"d.txt": "common rent elsewhere"})):
        for n, t in files.items():
            at = tmp_path / folder / n
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(t)
    e = Engine(spark, f"file://{tmp_path}/index")
    e.index(f"file://{tmp_path}/one", 1)
    e.index(f"file://{tmp_path}/two", 2)
    found = lambda *a, **k: [r["path"] for r in e.search(*a, **k).collect()]
    assert set(found("rent contract")) == {"b10.txt", "b9.md", "sub/c.py", "d.txt"} and found("rent contract")[0] == "b10.txt"
    assert found("rent", folder_id=2) == ["d.txt"] and found("rent", under="sub") == ["sub/c.py"]
    ids = {r.path: r.id for r in e.files().collect()}
    assert found("rent", file_ids=[ids["b9.md"]]) == ["b9.md"] and found("rent", file_ids=[]) == []
    rows = e.search("common contract").collect()
    assert not any(r["keyword"] for r in rows if r["path"] != "b10.txt")  # all passages hold "common"
    assert all(r["similarity"] is not None for r in rows)
    assert [p for p in found("zzz", order="name")] == ["b9.md", "b10.txt", "sub/c.py", "d.txt"]
    assert found("zzz", order="type")[0] == "b9.md" and found("zzz", order="type")[-1] == "sub/c.py"
    assert found("zzz", order="size")[0] == "b10.txt"
    with pytest.raises(ValueError):
        e.search("x", order="colour")
    near = e.similar(ids["b9.md"]).collect()
    assert {r.file_id for r in near} == set(ids.values()) - {ids["b9.md"]}
    assert e.similar(ids["b9.md"], query="contract", folder_id=1).count() == 2
    assert e.similar_to_file("x.txt", b"common rent only").first()["file_id"] == ids["b9.md"]
    assert e.highlight("rent contract").first()["path"] == "b10.txt"
    assert e.remove(1) == 3 and e.remove(1) == 0 and found("rent") == ["d.txt"]


def test_map_is_kept_and_grows(spark, tmp_path):
    from findling.plans.engine import Engine

    root = tmp_path / "docs"
    root.mkdir()
    words = ["walrus", "rent", "recipe"]
    for n in range(160):
        (root / f"{n}.txt").write_text(f"{words[n % 3]} " * 5 + f"w{n}")
    e = Engine(spark, f"file://{tmp_path}/index")
    e.index(f"file://{root}")
    first = {r.file_id: (r.x, r.y, r.z, r.rough) for r in e.map(epochs=60).collect()}
    assert len(first) == 160 and not any(v[3] for v in first.values())
    (root / "new.txt").write_text("walrus " * 6)
    (root / "5.txt").unlink()
    e.index(f"file://{root}")
    second = {r.file_id: (r.x, r.y, r.z, r.rough) for r in e.map(epochs=60).collect()}
    assert len(second) == 160 and sum(v[3] for v in second.values()) == 1
    assert all(second[i] == first[i] for i in second if i in first)
    assert {r.file_id for r in Engine(spark, f"file://{tmp_path}/index").map(epochs=60).collect()} == set(second)


def test_single_search_equals_the_search_of_many(spark):
    from findling.operators import keyword as KW

    rng = np.random.default_rng(4)
    words = ["rent", "rental", "walrus", "contract", "the", "plan", "planet", "x1"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 3))), " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(120)] + [(900, None, None)]
    p = spark.createDataFrame(rows, "file_id long, name string, text string")
    for terms in (["rent", "plan"], ["walrus"], ["x1", "zzz"], []):
        q = spark.createDataFrame([(1, terms)], "query_id int, terms array<string>")
        many = [(r.file_id, round(r.score, 6)) for r in KW.bm25(p, ["file_id"], q, "query_id", "terms", k=10, prefix=True).orderBy("rank").collect()]
        assert many == [(r.file_id, round(r.score, 6)) for r in KW.bm25_single(p, ["file_id"], terms, 10, prefix=True).collect()]
    common = spark.createDataFrame([(i, "", "all " + ("one" if i == 3 else "")) for i in range(6)], "file_id long, name string, text string")
    assert [r.file_id for r in KW.bm25_single(common, ["file_id"], ["all", "one"], 10, prefix=True, drop_common=True).collect()] == [3]
    assert KW.bm25_single(common, ["file_id"], ["all"], 10, prefix=True, drop_common=True).count() == 0
    assert KW.bm25_single(common.limit(0), ["file_id"], ["all"], 10).count() == 0


def test_checks_as_json(spark, tmp_path, capsys):
    from findling import __main__ as M

    (tmp_path / "a.txt").write_text("plain text")
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("in.txt", "x")
    assert M.rows(spark, "extract", [str(tmp_path / "a.txt")]).first()["text"] == "plain text"
    assert [r.path for r in M.rows(spark, "walk", [str(tmp_path)]).collect()] == ["a.txt", "o.zip"]
    assert M.rows(spark, "open", [str(tmp_path / "o.zip")]).first()["path"] == "o.zip\\in.txt"
    assert M.rows(spark, "terms", ["letter from my landlord"]).first()["terms"] == ["letter", "landlord"]
    assert len(M.rows(spark, "embed", ["one"]).first()["vector"]) == 8
    with pytest.raises(SystemExit):
        M.rows(spark, "nothing", ["x"])


def test_watcher_end_to_end(spark, tmp_path):
    from findling.plans.engine import Engine

    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.txt").write_text("walrus")
    (root / "b.txt").write_text("ostrich")
    e = Engine(spark, f"file://{tmp_path}/index")
    rows = [("a.txt", "created", 1, 0), ("a.txt", "modified", 2, 1), ("b.txt", "created", 3, 0), ("gone.txt", "removed", 4, 0), ("later.txt", "created", 5, 600)]
    df = spark.createDataFrame(rows, "path string, event string, n int, s int").select("path", "event", "n", F.timestamp_seconds("s").alias("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    e.watch(stream, f"file://{root}", f"file://{tmp_path}/cp").awaitTermination()
    assert {r.path for r in e.files().collect()} == {"a.txt", "b.txt"}


def test_mean_vectors_with_holes_and_lengths(spark):
    from findling.operators import vector as VE

    rng = np.random.default_rng(5)
    rows = [(int(i % 7), rng.normal(size=4).tolist()) for i in range(80)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [0.0] * 4), (103, [1.0, 2.0]), (103, [3.0, 0.0, 4.0]), (103, [3.0, 0.0, 4.0]), (104, [])]
    df = spark.createDataFrame(rows + odd, "file_id long, vector array<double>").repartition(5)
    got = {r.file_id: r.vector for r in VE.mean_vectors(df, hold=3).collect()}
    for f in range(7):
        m = np.mean([v for k, v in rows if k == f], axis=0)
        assert np.allclose(got[f], m / np.linalg.norm(m))
    assert 100 not in got and 101 not in got and got[102] == [0.0] * 4 and np.allclose(got[103], [0.6, 0.0, 0.8]) and got[104] == []
    assert VE.mean_vectors(df.limit(0)).count() == 0


def shuffled(spark, run):
    """Records that the stages of ``run`` wrote to shuffles."""
    store, nothing = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, nothing, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for s, n in stages().items() if s not in before)


def many_searches(spark, texts, searches):
    """As many different searches of a common word and another one, and texts that hold it."""
    p = spark.createDataFrame([(i, f"n{i % 7}", f"common w{i % 50} w{i % 11}") for i in range(texts)], "file_id long, name string, text string").repartition(3)
    return p, spark.createDataFrame([(i, [f"w{i % 50}", f"w{i // 50}", "common"]) for i in range(searches)], "query_id int, terms array<string>")


def test_bm25_shuffles_no_pairs_of_queries_and_passages(spark):
    p, q = many_searches(spark, 2000, 300)  # 600,000 pairs
    assert shuffled(spark, lambda: KW.bm25(p, ["file_id"], q, "query_id", "terms", k=5).collect()) < 60_000


def test_bm25_by_blocks_is_the_first_of_all(spark, monkeypatch):
    monkeypatch.setattr(KW, "MOST_HITS", 150)
    monkeypatch.setattr(KW, "MOST_SETS", 40)
    p, q = many_searches(spark, 400, 120)
    q = q.unionByName(q.where("query_id < 3").withColumn("query_id", F.col("query_id") + 1000)).unionByName(q.where("query_id = 7"))  # the same terms, and an id twice
    for key in (["file_id"], ["name", "file_id"]):
        for prefix in (False, True):
            every = KW.bm25(p, key, q, "query_id", "terms", prefix=prefix).collect()
            want = {}
            for r in sorted(every, key=lambda r: (-round(r.score, 9), *(r[c] for c in key))):
                want.setdefault(r.query_id, []).append((*(r[c] for c in key), round(r.score, 6)))
            got = {}
            for r in KW.bm25(p, key, q, "query_id", "terms", k=6, prefix=prefix).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((*(r[c] for c in key), round(r.score, 6)))
            assert got == {i: rows[:6] for i, rows in want.items()} and len(got) == 123


def test_bm25_counts_passages_of_one_key_as_one(spark):
    p = spark.createDataFrame([(1, "", "rent rent x"), (1, "", "rent y"), (2, "", "rent z z"), (3, None, None), (None, "", "rent")], "file_id long, name string, text string")
    q = spark.createDataFrame([(1, ["z"]), (2, ["rent"]), (3, ["none"])], "query_id int, terms array<string>")
    rows = KW.bm25(p, ["file_id"], q, "query_id", "terms", k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.file_id) for r in rows] == [(1, 2), (2, 1), (2, 2)]
    n, average, tf, length = 5, 9 / 5, 2, 3  # rows; words by row; twice in three words
    assert rows[0].score == pytest.approx(np.log((n - 1 + 0.5) / 1.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average)))
    assert rows[1].score == pytest.approx(1e-6 * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 5 / average)))


def test_bm25_by_starts_of_words_shuffles_no_pairs(spark):
    p, q = many_searches(spark, 2000, 300)
    started = q.withColumn("terms", F.concat(F.slice("terms", 1, 2), F.array(F.lit("com"))))
    assert shuffled(spark, lambda: KW.bm25(p, ["file_id"], started, "query_id", "terms", k=5, prefix=True).collect()) < 60_000


def test_bm25_a_word_whole_and_as_a_start(spark):
    p = spark.createDataFrame([(1, "rent", "x"), (2, "rental", "rents x"), (3, "re", "ren"), (4, "", "x re")], "file_id long, name string, text string")
    q = spark.createDataFrame([(1, ["rent", "x"]), (2, ["x", "rent"]), (3, ["re"]), (4, ["ren", "re"]), (5, [])], "query_id int, terms array<string>")
    got = {}
    for r in KW.bm25(p, ["file_id"], q, "query_id", "terms", k=9, prefix=True).collect():
        got.setdefault(r.query_id, set()).add(r.file_id)
    assert got == {1: {1, 2, 4}, 2: {1, 2, 4}, 3: {3, 4}, 4: {3, 4}}
