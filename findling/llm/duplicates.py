"""Near-duplicate records by an exact join of similar sets, with skipping by relations between sets.

Records become sets of tokens, identical sets one class. Tokens are ordered by frequency, rare ones first; a
token that only one set has makes no list. A set is entered in the lists of its first tokens, as many as it
could lack and still be similar enough. A list is sorted into blocks of equal size and position:

* blocks are skipped as a whole where their sizes, or what may follow at their position, rule out the overlap;
* the overlaps of a set are derived from those of the set before it where the two differ in a few tokens:
  only the differing tokens are looked up, and answers that the difference can't lift to the threshold are
  skipped unseen.

A list is streamed by one task; a longer one than a block holds is split into pairs of blocks, all of which
are worked off, so no partner is lost whatever the length. The pairs of classes are checked exactly: file
names by their title words and numbers, vectors by their cosine.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from findling.llm.neighbours import unit_vectors
from findling.session import bounded, stored

LIST_BLOCK = 2048


def needed(a: int, b: int, jaccard: float | None, overlap: int | None) -> int:
    """Common tokens that two sets of sizes a and b need."""
    if overlap is not None:
        return overlap
    return -int(-(jaccard / (1 + jaccard) * (a + b) - 1e-9) // 1)  # no rounding may ask for one more


class ListJoin:
    """One token's list after the other: entries (key, size, position, tokens in order).

    Sets are bit masks over the tokens of the list at hand, so an overlap is one operation on whole words.
    """

    def __init__(self, jaccard: float | None, overlap: int | None, close: int = 6):
        self.jaccard, self.overlap, self.close = jaccard, overlap, close

    def pairs(self, left: list[tuple], right: list[tuple] | None = None) -> Iterator[tuple]:
        """Similar pairs whose first common token is the list's; ``right`` None joins the list with itself.

        Tokens of an entry are those that other sets share, in the common order; ``position`` counts all.
        """
        rows = sorted(left, key=lambda e: (e[1], e[2], e[3]))
        others = rows if right is None else sorted(right, key=lambda e: (e[1], e[2], e[3]))
        bits: dict[int, int] = {}

        def masks(entries: list[tuple]) -> tuple[list[int], list[int]]:
            """All tokens of each entry, and those before the list's, of which none may be common."""
            whole, before = [], []
            for _, size, at, tokens in entries:
                m = e = 0
                for n, t in enumerate(tokens):
                    if n == at - (size - len(tokens)):
                        e = m
                    m |= 1 << bits.setdefault(t, len(bits))
                whole.append(m)
                before.append(e)
            return whole, before

        sets, _ = masks(others)
        own_sets, own_before = masks(rows)
        blocks: list[tuple[int, int, int, int]] = []  # size, position, from, to
        for n, e in enumerate(others):
            if blocks and blocks[-1][:2] == (e[1], e[2]):
                blocks[-1] = (*blocks[-1][:3], n + 1)
            else:
                blocks.append((e[1], e[2], n, n + 1))
        leader: int | None = None
        known: dict[int, int] = {}  # overlaps of the leader
        most: dict[int, int] = {}  # bounds on those that were passed by
        for m, (key, size, at, _) in enumerate(rows):
            own, before = own_sets[m], own_before[m]
            gone = new = grown = 0
            derive = False
            if leader is not None:
                gone, new = leader & ~own, own & ~leader
                grown = new.bit_count()
                derive = gone.bit_count() + grown <= self.close
            answers: dict[int, int] = {}
            bounds: dict[int, int] = {}
            for b_size, b_at, a, z in blocks:
                if right is None:
                    a = max(a, m + 1)
                    if a >= z:
                        continue
                need = needed(size, b_size, self.jaccard, self.overlap)
                if need > min(size, b_size) or 1 + min(size - at, b_size - b_at) - 1 < need:
                    continue  # too different in size, or too little can follow: none of the block
                for n in range(a, z):
                    other = sets[n]
                    exact = known.get(n) if derive else None
                    if exact is None:
                        bound = most.get(n) if derive else None
                        if bound is not None and bound + grown < need:
                            bounds[n] = bound + grown
                            continue
                        common = (own & other).bit_count()
                    elif exact + grown < need:
                        bounds[n] = exact + grown  # passed by; a later set knows it as a bound only
                        continue
                    else:
                        common = exact - (gone & other).bit_count() + (new & other).bit_count()
                    answers[n] = common
                    if common >= need and not before & other and key != others[n][0]:
                        yield (key, others[n][0]) if key < others[n][0] else (others[n][0], key)
            leader, known, most = own, answers, bounds


def similar_sets(sets: DataFrame, key: str = "key", tokens: str = "tokens", jaccard: float | None = 0.8, overlap: int | None = None, list_block: int = LIST_BLOCK) -> DataFrame:
    """``a, b``: all pairs of keys whose sets have a Jaccard similarity, or an overlap, of at least so much.

    ``key`` must be unique and a LONG; ``tokens`` is an array of LONG, in which repetitions and nulls don't
    count. Empty and null sets are similar to none. a < b; every pair comes out once.
    """
    if (jaccard is None) == (overlap is None):
        raise ValueError("either a Jaccard similarity or an overlap")
    base = sets.select(F.col(key).cast("long").alias("key"), F.array_distinct(F.array_compact(tokens)).alias("tokens"))
    base = base.withColumn("size", F.size("tokens")).where(F.col("size") > 0)
    single = base.select("key", "size", F.explode("tokens").alias("token"))
    shared = single.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    ordered = (
        single.join(shared, "token").groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    )  # a set's own tokens: bounded by its size
    least = F.lit(overlap) if overlap is not None else F.ceil(F.lit(jaccard) * F.col("size") - 1e-9)
    # tokens of one set only come first in the order, so the shared ones begin behind them
    skip = F.col("size") - F.size("t")
    entered = F.greatest(F.col("size") - least + 1 - skip, F.lit(0)).cast("int")
    brief = F.transform("t", lambda x: x["token"])
    entries = ordered.select("key", "size", skip.alias("skip"), brief.alias("brief"), F.posexplode(F.slice("t", F.lit(1), entered)).alias("i", "x"))
    entries = entries.select(F.col("x.token").alias("token"), F.col("x.n").alias("n"), "key", "size", (F.col("i") + F.col("skip")).alias("at"), "brief")
    blocks = F.ceil(F.col("n") / list_block)
    own = F.pmod(F.xxhash64("key"), blocks)
    # a long list becomes pairs of blocks; a short one has only block 0
    entries = entries.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    entries = entries.select("token", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "key", "size", "at", "brief")
    lists = entries.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    join = ListJoin(jaccard, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, a, b = None, [], [], []

        def work() -> None:
            i, j = current[1], current[2]
            if len(rows) > 1:
                if i == j:
                    found = join.pairs([r[1:] for r in rows])
                else:
                    found = join.pairs([r[1:] for r in rows if r[0] == i], [r[1:] for r in rows if r[0] == j])
                for x, y in found:
                    a.append(x)
                    b.append(y)

        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(8)]
            for r in zip(*c):
                if r[:3] != current:
                    if rows:
                        work()
                    current, rows = r[:3], []
                rows.append((r[3], r[4], r[5], r[6], r[7]))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if rows:
            work()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return lists.mapInArrow(run, "a bigint, b bigint").distinct()


# file names

#: Marks of copies and versions that stand anywhere in a name.
MARKS = frozenset("copy copie copia kopie duplicate duplikat scan korr korrigiert entwurf brouillon borrador signed unterschrieben firmado firmada definitiv version".split())
#: Words that may mark a version or belong to a title.
MAYBE = frozenset("final old alt neu new draft firmado firmada definitiv".split())
#: Small words of "copy of" in four languages.
OF = {"copy": "of", "copie": "de", "copia": "de", "kopie": "von"}
EXTENSION = re.compile(r"\.[A-Za-z][A-Za-z0-9]{0,4}$")
#: What is put behind a name to tell copies and versions apart.
BEHIND = re.compile(r"(?:[\s_-]*\(\d{1,3}\)|[\s_.-]+[vV]\d{1,3}(?:\.\d{1,3}){0,3}|\s-\s(?:[Cc]op(?:y|ie|ia)|[Kk]opie)|_(?:old|alt|neu|new|final|definitiv|korr|scan|signed|draft|copy|kopie|copie|copia)| (?:FINAL|OLD|NEW|NEU|ALT))+$")
DATES = re.compile(r"(?<!\d)(?:(\d{4})([-_. ]?)(\d{2})\2(\d{2})|(\d{2})([-_. ])(\d{2})\6(\d{4}))(?!\d)")
GROUPED = re.compile(r"(?<!\d)(\d{3})-(\d{4})(?!\d)")
NUMBERED = re.compile(r"(?<![^\W\d_])(?:nr|no|re|n)[\s_.-]*(?=\d)")
PIECE = re.compile(r"[^\W\d_]+|\d+")


def fold_name(name: str) -> str:
    s = name.lower().replace("ß", "ss")
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return s.replace("ae", "a").replace("oe", "o").replace("ue", "u")


@lru_cache(maxsize=100_000)
def _nearly_a_mark(w: str) -> bool:
    """A long mark with a slip of the pen; another ending makes another word."""
    return len(w) >= 6 and any(edits_between(w, m, 1) == 1 and w[:-1] != m and w[:-1] != m[:-1] for m in MARKS if len(m) >= 7)


def plain_name(path: str) -> str:
    """A path's last part without its extension, however written: what exact copies share."""
    name = re.split(r"[\\/]", path)[-1]
    stem = EXTENSION.sub("", name) if not name.startswith(".") else name
    return " ".join(PIECE.findall(fold_name(stem)))


def title(path: str) -> tuple[str, str]:
    """(numbers, words) of a path's last part, each joined by spaces; what marks a copy or version is left out.

    Dates and numbers are brought to one notation each, words sorted. ``firmado`` and the like stay out of
    the words where they stand in lower case as a mark would; a title's word of that kind is compared later.
    """
    name = re.split(r"[\\/]", path)[-1]
    stem = EXTENSION.sub("", name) if not name.startswith(".") else name
    s = fold_name(BEHIND.sub("", stem.strip()))
    numbers: list[str] = []

    def date(m: re.Match[str]) -> str:
        y, mo, d = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
        if not (1 <= int(mo) <= 12 and 1 <= int(d) <= 31 and 1900 <= int(y) <= 2100):
            return m[0]
        numbers.append(f"{y}-{mo}-{d}")
        return " "

    s = DATES.sub(date, s)
    s = GROUPED.sub(lambda m: m[1] + m[2], s)
    s = NUMBERED.sub(" ", s)
    words = []
    pieces_ = PIECE.findall(s)
    skip = False
    for k, w in enumerate(pieces_):
        if skip:
            skip = False
        elif w.isdigit():
            numbers.append(w.lstrip("0") or "0")
        elif w in MARKS or _nearly_a_mark(w):
            skip = k + 1 < len(pieces_) and pieces_[k + 1] == OF.get(w)
        else:
            words.append(w)
    return " ".join(sorted(numbers)), " ".join(sorted(words))


def edits_between(a: str, b: str, most: int) -> int:
    """Letters added, dropped, changed or swapped with their neighbour that turn a into b; most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(length: int, numbered: bool) -> int:
    """Edits that two versions of a word of so many letters may differ by: up to two in each where a number
    tells files apart, fewer where only the words do."""
    return 0 if length < 3 else 1 if length < 5 else 2 + (length >= 14) if not numbered else 3 + (length >= 10)


def same_title(a: tuple[str, str], b: tuple[str, str], edits: int = 5) -> bool:
    """The same numbers and the same words but for small edits and one-sided marks of versions."""
    if a[0] != b[0]:
        return False
    x, y = a[1].split(), b[1].split()
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
    used = 0
    for w in sorted(x, key=len, reverse=True):
        most = allowed(len(w), bool(a[0]))
        d, near = min(((edits_between(w, v, most), v) for v in y), default=(most + 1, ""))
        if d <= most:
            used += d
            x.remove(w)
            y.remove(near)
    # letters that a separator took apart or a join put together
    if x and y and "".join(sorted("".join(x))) == "".join(sorted("".join(y))) and ("".join(x) == "".join(y) or len(x) != len(y)):
        x, y = [], []
    if used > edits:
        return False
    if not (a[0] or len(set(a[1].split()) & set(b[1].split())) > 0):
        return False
    mark = lambda w: w in MAYBE or w in MARKS or (len(w) > 4 and any(edits_between(w, m, 2) <= 2 for m in MARKS if len(m) > 4))
    return (not x or not y) and all(map(mark, x or y))


def name_tokens(t: tuple[str, str]) -> list[str]:
    """Tokens of a title: letter triples of its words, all together with its numbers, so that only titles of
    the same numbers can share one."""
    head = t[0] + "|"
    out = {head + f"#{k}" for k in range(8)} if t[0] else set()
    for w in t[1].split():
        if w not in MAYBE:
            p = f"^{w}$"
            out |= {head + p[i : i + 3] for i in range(len(p) - 2)}
    return sorted(out)


def titles(files: DataFrame, key: str = "id", path: str = "path", order: str = "indexed_at") -> DataFrame:
    """``id, name, numbers, words`` of every id's valid row (greatest ``order``; ties: greatest path)."""
    valid = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, path)).alias("r")).select(F.col(key).alias("id"), F.col(f"r.{path}").alias("path"))
    kind = dict(valid.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(1).to_pylist()
            got = [(plain_name(p), *title(p)) if p else ("", "", "") for p in paths]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[k] for g in got], pa.string()) for k in range(3)]], ["id", "name", "numbers", "words"])

    return valid.mapInArrow(run, f"id {kind}, name string, numbers string, words string")


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b``: pairs of members of the same class and of linked classes; members (id, class), links (a, b)."""
    m1 = members.select(F.col("id").alias("x"), F.col("class").alias("a"))
    m2 = members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    within = m1.join(m2, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    across = links.join(m1, "a").join(m2, "b").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def name_classes(files: DataFrame, numbered: float = 0.36, bare: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """Members (id, class) of equal names, and links (a, b) between classes of nearly equal titles.

    Titles with numbers share tokens with those of the same numbers only, so a low similarity costs little,
    and a title whose numbers no other has can't have a partner; without any the words alone tell titles
    apart, and small edits leave more of their triples in common.
    """
    rows = titles(files).where((F.col("words") != "") | (F.col("numbers") != ""))
    members = stored(rows.withColumn("class", F.xxhash64("name")), "titles")
    reps = members.groupBy("class").agg(F.min(F.struct("numbers", "words")).alias("t")).select("class", "t.*")
    reps = stored(reps, "representatives")
    several = reps.where("numbers <> ''").groupBy("numbers").agg(F.count("*").alias("n")).where("n > 1").select("numbers")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, w = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name_tokens(t) for t in zip(n, w)], pa.list_(pa.string()))], ["class", "tokens"])

    def alike(part: DataFrame, least: float) -> DataFrame:
        # hashed with the JVM's function, so that no task's hash seed matters
        sets = part.mapInArrow(tokenise, "class bigint, tokens array<string>").select("class", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"))
        return similar_sets(sets, "class", "tokens", jaccard=least)

    pairs = alike(reps.where("numbers <> ''").join(several, "numbers", "left_semi").select("class", "numbers", "words"), numbered).unionByName(alike(reps.where("numbers = ''"), bare))
    named = pairs.join(reps.select(F.col("class").alias("a"), F.struct("numbers", "words").alias("ta")), "a").join(reps.select(F.col("class").alias("b"), F.struct("numbers", "words").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            keep = [k for k in range(batch.num_rows) if same_title(tuple(c[2][k].values()), tuple(c[3][k].values()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    links = named.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")
    return members.select("id", "class"), links


# vectors

BITS, BANDS, COMMON = 20, 64, 3


def vector_classes(rows: DataFrame, key: str = "file_id", vector: str = "vector", dim: int = 256, cosine: float = 0.96, bits: int = BITS, bands: int = BANDS, overlap: int = COMMON, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Members (id, class) of identical vectors, and links (a, b) between classes of at least so much cosine.

    A vector's set holds one token for each band of signs of random projections. At a cosine of 0.96 a band
    agrees with probability 0.15, so 9.7 of 64 are common on average and fewer than 3 once in 450 times; at
    0.97 it is once in 8,700 times. The cosine of all pairs found is computed exactly.
    """
    units = stored(unit_vectors(rows, key, vector, dim).withColumn("id", F.col("key")).withColumn("class", F.xxhash64("class")), "directions")
    reps = stored(units.groupBy("class").agg(F.min("unit").alias("unit")), "representatives")
    planes = np.random.default_rng(seed).standard_normal((dim, bits * bands)).astype(np.float32)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = (np.int64(1) << np.arange(bits, dtype=np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                u = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float32).reshape(-1, dim)
                signs = (u @ planes > 0).reshape(len(u), bands, bits)
                tokens = (signs * weigh).sum(2) + (np.arange(bands, dtype=np.int64) << np.int64(bits))
                ends = np.arange(0, tokens.size + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.ravel()))], ["class", "tokens"])

    sets = reps.mapInArrow(tokenise, "class bigint, tokens array<bigint>")
    pairs = similar_sets(sets, "class", "tokens", jaccard=None, overlap=overlap)
    both = pairs.join(reps.select(F.col("class").alias("a"), F.col("unit").alias("ua")), "a").join(reps.select(F.col("class").alias("b"), F.col("unit").alias("ub")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64) for k in (2, 3))
            s = (x * y).sum(1)
            keep = pa.array(np.flatnonzero(s >= cosine))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return units.select("id", "class"), both.select("a", "b", "ua", "ub").mapInArrow(check, "a bigint, b bigint")


def grouped(members: DataFrame, links: DataFrame, rounds: int = 50) -> DataFrame:
    """``id, group, links``: connected classes as groups (named by their smallest class) and each id's partners' number.

    Labels spread along links, with each round jumping to the label of the label; every round's labels are
    written to the shared folder. Nothing is gathered but the number of changes.
    """
    links = stored(links.distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(members.select("class").distinct().withColumn("label", F.col("class")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("class").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "class"), "class", "left").select("class", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("class").alias("label"), F.col("label").alias("further"))
        after = stored(step.join(jump, "label", "left").select("class", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = after.where(F.col("old") != F.col("label")).limit(1).count()
        labels = after.select("class", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    partners = both.join(sizes.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.sum("n").alias("m"))
    by_class = labels.join(sizes, "class").join(partners.withColumnRenamed("a", "class"), "class", "left")
    by_class = by_class.select("class", F.col("label").alias("group"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return members.join(by_class, "class").select("id", "group", "links")
