"""Statistics of texts, and which texts aren't natural prose.

A text is cut at blank lines into blocks. A block is described by four distributions: character classes,
kinds of words (function words of each language, other words by case, numbers, mixed runs), kinds of lines
(cells, dot leaders, bullets, sentence ends, flowing, long, short) and repetition. Its distance to a profile
is the weighted sum of the Jensen-Shannon divergences of the four, and it takes the form of the nearest
profile, of which prose has its own for every language and manner of writing. Profiles are made from short
archetype texts below and, where labelled documents are given, from their blocks, clustered within each
form; the number of labelled documents used is bounded by a parameter.
A text whose prose blocks hold less than half of its characters isn't prose; its form is the one with most
characters among the rest.

All counting runs over whole batches of texts as numpy arrays; no character is looked at in Python code.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from findling.llm.arrow import map_rows
from findling.session import bounded

FORMS = ("prose", "list", "table", "junk")
#: Function words by language.
FUNCTION_WORDS = {
    "english": """the a an and or but of to in on at by for from with without as is are was were be been it its this that these those he she they we you i not no had has have his her their our my which who what when while until before after since if so because although nobody under over between""",
    "german": """der die das den dem des ein eine einen einem einer eines und oder aber von zu zum zur im in an am auf bei mit ohne für aus nach seit vor über unter zwischen durch um als wie ist sind war waren wird wurde hat hatte haben nicht kein keine er sie es wir ihr ich sein seine ihre unser mein dass da damit weil während bis bevor obwohl was wer wenn so alles noch niemand warum""",
    "french": """le la les l un une des du de d et ou mais à au aux en dans sur sous par pour avec sans chez depuis avant après pendant entre vers est sont était a ont avait été se trouvait il elle ils elles nous vous je ne n pas plus que qu qui quoi ce cet cette ces son sa ses leur leurs notre mon bien car parce alors comme si encore personne pourquoi""",
    "spanish": """el la los las un una unos unas de del y o pero a al en con sin por para desde hasta antes después durante entre sobre bajo es son era fue ha han había se su sus mi nuestro nuestra lo le les no ni que quien como cuando donde si ya porque aunque este esta esto ese esa nadie sabía qué""",
}
#: Characters by which lines begin that list, and that part cells.
BULLETS = "-–—•*·▪◦‣○●■□☐☑✓✗→►»"
ENDS = ".!?…:。！？"
CLASSES = ("lower", "upper", "digit", "space", "break", "stop", "comma", "quote", "dash", "cell", "bracket", "symbol", "strange", "letter")
WORDS = (*FUNCTION_WORDS, "shared", "lower", "capital", "caps", "number", "mixed", "long", "single", "none")
SHARED = len(FUNCTION_WORDS)
LINES = ("cells", "leader", "bullet", "end", "flowing", "long", "short")
WEIGHTS = {"chars": 1.0, "words": 1.6, "lines": 1.3, "repeat": 1.2}
PARTS = (("chars", len(CLASSES)), ("words", len(WORDS)), ("lines", len(LINES)), ("repeat", 6))
LABELLED, LABELLED_BLOCKS = 4000, 16
#: Profiles of each form: prose has those of every language, in sentences, wrapped, in capitals and without marks.
PROFILES = (40, 16, 16, 24)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of every character of the basic plane, and powers for hashing."""
    kind = np.zeros(0x10000, np.uint8)
    low = np.arange(0x10000, dtype=np.uint32)
    for o in range(0x10000):
        c = chr(o)
        g = unicodedata.category(c)
        if c in "\n\r\f\v\u2028\u2029\x85":
            k = 4
        elif g == "Ll" or c in "ªº":
            k = 0
        elif g in ("Lu", "Lt"):
            k = 1
        elif g == "Nd":
            k = 2
        elif c in "|;\t":
            k = 9
        elif g == "Zs" or c == "\t":
            k = 3
        elif c in ENDS:
            k = 5
        elif c in ",¿¡":
            k = 6
        elif g in ("Pi", "Pf") or c in "\"'’":
            k = 7
        elif c in BULLETS or g == "Pd":
            k = 8
        elif g in ("Ps", "Pe"):
            k = 10
        elif g in ("Lo", "Lm", "Mn", "Mc"):
            k = 13
        elif o < 0x250 and g[0] in "PSN":
            k = 12 if c in "\u00ad" else 11
        elif c in "€™‰":
            k = 11
        else:
            k = 12
        kind[o] = k
        lower = c.lower()
        if len(lower) == 1:
            low[o] = ord(lower)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
    return kind, low, power


def _hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, power: np.ndarray) -> np.ndarray:
    """A hash of every run [start, start + length) of codes; runs may not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    run = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        x = (codes[np.repeat(starts, lengths) + at].astype(np.uint64) + np.uint64(11)) * power[at & 63] * (np.uint64(1) + (at >> 6).astype(np.uint64))
        x ^= x >> np.uint64(29)
        return np.add.reduceat(x, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64)


@cache
def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words, and the language of each; a word of several languages is shared."""
    language: dict[str, int] = {}
    for k, text in enumerate(FUNCTION_WORDS.values()):
        for w in set(text.split()):
            language[w] = SHARED if w in language else k
    codes = np.array([ord(c) for w in language for c in w], np.uint32)
    lengths = np.array([len(w) for w in language])
    h = _hashes(codes, np.cumsum(lengths) - lengths, lengths, _tables()[2])
    order = np.argsort(h)
    return h[order], np.array(list(language.values()))[order]


def _function_language(h: np.ndarray) -> np.ndarray:
    """The language of each word that is a function word, or -1."""
    known, language = _function_hashes()
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[i] == h, language[i], -1)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


def describe(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts by document and the distributions of all blocks of a batch of texts."""
    kind_of, low_of, power = _tables()
    joined = "".join((t or "") + "\n" for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n_doc = len(texts)
    doc_len = np.array([len(t or "") + 1 for t in texts])
    doc_end = np.cumsum(doc_len)
    codes = np.minimum(raw, 0xFFFF)
    kind = kind_of[codes]
    kind[raw > 0xFFFF] = 12
    kind[doc_end - 1] = 4
    n = len(kind)
    doc = np.repeat(np.arange(n_doc), doc_len)
    # lines
    brk = kind == 4
    line_end = np.flatnonzero(brk)  # position of each line's break
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    n_line = len(line_end)
    line = np.repeat(np.arange(n_line), line_end - line_start + 1)
    ink = ~brk & (kind != 3) & (raw != 9)
    inked = np.bincount(line[ink], minlength=n_line) > 0
    line_doc = doc[line_end]
    # blocks: runs of lines with ink within a document
    first = inked & np.concatenate([[True], ~inked[:-1] | (line_doc[1:] != line_doc[:-1])])
    block_of_line = np.cumsum(first) - 1
    n_block = int(first.sum())
    block_of_line[~inked] = -1
    in_block = block_of_line[line]
    ok = in_block >= 0
    block_doc = line_doc[np.flatnonzero(first)]
    chars = np.bincount(in_block[ok] * len(CLASSES) + kind[ok], minlength=n_block * len(CLASSES)).reshape(n_block, len(CLASSES))
    # words
    w_start, w_len = _runs((kind < 3) | (kind == 13))
    n_word = len(w_start)
    cum = lambda m: np.concatenate([[0], np.cumsum(m)])
    upper, digit = cum(kind == 1), cum(kind == 2)
    n_up = upper[w_start + w_len] - upper[w_start]
    n_dig = digit[w_start + w_len] - digit[w_start]
    h = _hashes(low_of[codes], w_start, w_len, power)
    language = _function_language(h)
    func = language >= 0
    head_up = kind[w_start] == 1 if n_word else np.zeros(0, bool)
    word_kind = np.select(
        [n_dig == w_len, n_dig > 0, w_len > 30, func, w_len == 1, n_up == 0, (n_up == w_len), head_up & (n_up == 1)],
        [SHARED + 4, SHARED + 5, SHARED + 6, language, SHARED + 7, SHARED + 1, SHARED + 3, SHARED + 2], SHARED + 5,
    ) if n_word else np.zeros(0, int)
    w_block = in_block[w_start] if n_word else np.zeros(0, int)
    words = np.bincount(w_block * len(WORDS) + word_kind, minlength=n_block * len(WORDS)).reshape(n_block, len(WORDS))
    n_words_b = words.sum(1)
    words[n_words_b == 0, WORDS.index("none")] = 1
    # lines' kinds
    ink_at = np.flatnonzero(ink)
    lines_inked = np.flatnonzero(inked)
    lo = np.searchsorted(ink_at, line_start[lines_inked])
    hi = np.searchsorted(ink_at, line_end[lines_inked])
    a, z = ink_at[lo], ink_at[hi - 1]  # first and last inked character
    length = z - a + 1
    cell = cum(np.isin(raw, np.array([ord("|"), ord(";"), 9], np.uint32)))
    n_cell = cell[line_end[lines_inked]] - cell[line_start[lines_inked]]
    sp_start, sp_len = _runs((kind == 3) | (raw == 9))
    wide = sp_start[sp_len >= 3]  # two spaces also part the words of sloppy prose
    tight = cum((raw == ord(",")) & (kind_of[np.minimum(np.concatenate([raw[1:], [10]]), 0xFFFF)] < 3))
    n_tight = tight[line_end[lines_inked]] - tight[line_start[lines_inked]]
    gaps = np.searchsorted(wide, z) - np.searchsorted(wide, a)
    dot_start, dot_len = _runs(np.isin(raw, np.array([ord("."), ord("…"), ord("_"), ord("·")], np.uint32)))
    lead = dot_start[dot_len >= 4]
    leaders = np.searchsorted(lead, z) - np.searchsorted(lead, a)
    nxt1 = raw[np.minimum(a + 1, n - 1)]
    bullet = (kind[a] == 8) & ((nxt1 == 32) | (nxt1 == 9)) | ((raw[a] == ord("[")) & np.isin(nxt1, [ord(" "), ord("x"), ord("X"), ord("]")]) & (raw[np.minimum(a + 2, n - 1)] == ord("]")))
    bullet |= np.isin(raw[a], np.array([ord(c) for c in "•▪◦‣○●■□☐☑✓✗►"], np.uint32)) & (length > 1) & (nxt1 != raw[a])
    wi = np.minimum(np.searchsorted(w_start, a), max(n_word - 1, 0))
    if n_word:
        after = a + w_len[wi]
        mark = raw[np.minimum(after, n - 1)]
        bullet |= (w_start[wi] == a) & (word_kind[wi] == WORDS.index("number")) & (w_len[wi] <= 4) & ((mark == ord(".")) | (mark == ord(")"))) & (raw[np.minimum(after + 1, n - 1)] == 32)
    ended = kind[z] == 5
    ended |= np.isin(kind[z], [7, 10]) & (kind[np.maximum(z - 1, 0)] == 5)
    same = np.concatenate([block_of_line[lines_inked][1:] == block_of_line[lines_inked][:-1], [False]])
    next_low = np.concatenate([(kind[a][1:] == 0), [False]]) & same
    prev_flow = np.concatenate([[False], (next_low & ~bullet)[:-1]])
    cells = (n_cell + gaps >= 2) & ((n_cell + gaps) * 70 > length) | (n_tight >= 3) & (n_tight * 25 > length)
    line_kind = np.select([cells, leaders > 0, bullet & (length < 100) & ~(ended & (length > 45)), ended & (length > 30), next_low | prev_flow, length >= 55], [0, 1, 2, 3, 4, 5], 6)
    blk = block_of_line[lines_inked]
    # lines weigh by length, so that a wrapped paragraph's last word counts little
    lines = np.bincount(blk * len(LINES) + line_kind, weights=length, minlength=n_block * len(LINES)).reshape(n_block, len(LINES))
    # repetition: lines and words that came before in the block, and characters like the one before
    lh = _hashes(codes, a, length, power)
    n_lines_b = np.bincount(blk, minlength=n_block)
    d_lines = _distinct(blk, lh, n_block)
    d_words = _distinct(w_block, h, n_block)
    same_c = np.concatenate([[False], (raw[1:] == raw[:-1]) & ~brk[1:]])
    run_c = np.bincount(in_block[ok & same_c], minlength=n_block)
    size = chars.sum(1) - chars[:, 4]
    share = lambda part, whole: part / np.maximum(whole, 1)
    seen_l = share(n_lines_b - d_lines, n_lines_b)
    seen_w = np.where(n_words_b >= 12, share(n_words_b - d_words, np.sqrt(n_words_b) * 12), 0).clip(0, 1)
    run = share(run_c, size).clip(0, 1)
    repeat = np.stack([1 - seen_l, seen_l, 1 - seen_w, seen_w, 1 - run, run], 1) / 3
    vectors = np.concatenate([_unit(chars), _unit(words), _unit(lines), repeat], 1).astype(np.float32)
    n_word_d = np.bincount(doc[w_start], minlength=n_doc) if n_word else np.zeros(n_doc, int)
    by_doc = lambda x, d: np.bincount(d, weights=x, minlength=n_doc)
    dl = line_doc[lines_inked]
    n_line_d = np.bincount(dl, minlength=n_doc)
    symbols = (kind >= 5) & (kind != 13)
    return {
        "vectors": vectors, "block_doc": block_doc, "block_size": size,
        "chars": doc_len - 1, "words": n_word_d,
        "mean_word": share(by_doc(w_len, doc[w_start]), n_word_d) if n_word else np.zeros(n_doc),
        "symbol_ratio": share(by_doc(symbols, doc), by_doc(ink, doc)),
        "digit_ratio": share(by_doc(kind == 2, doc), by_doc(ink, doc)),
        "upper_ratio": share(by_doc(kind == 1, doc), by_doc((kind < 2) | (kind == 13), doc)),
        "lines": n_line_d, "ended_lines": share(by_doc(ended, dl), n_line_d),
        "bullet_lines": share(by_doc(bullet, dl), n_line_d),
        "common_words": share(by_doc(func, doc[w_start]), n_word_d) if n_word else np.zeros(n_doc),
        "distinct_words": share(_distinct(doc[w_start], h, n_doc), n_word_d) if n_word else np.zeros(n_doc),
        "repeated_lines": share(n_line_d - _distinct(dl, lh, n_doc), n_line_d),
    }


def _distinct(group: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return np.zeros(n, int)
    with np.errstate(over="ignore"):
        key = h ^ ((group.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    _, at = np.unique(key, return_index=True)
    return np.bincount(group[at], minlength=n)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(1, keepdims=True), 1e-9)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Weighted Jensen-Shannon divergences of every row of p to every row of q."""
    out = np.zeros((len(p), len(q)), np.float32)
    scale = np.concatenate([np.full(n, WEIGHTS[name], np.float32) for name, n in PARTS])
    ent = lambda x: x * np.log(np.maximum(x, 1e-12))
    hp = (ent(p) * scale).sum(1)
    hq = (ent(q) * scale).sum(1)
    for j in range(len(q)):
        m = (p + q[j]) * np.float32(0.5)
        out[:, j] = 0.5 * (hp + hq[j]) - (ent(m) * scale).sum(1)
    return out


def archetypes() -> list[tuple[str, str]]:
    """(form, text) of what the forms look like, made from a few words by rule."""
    rng = np.random.default_rng(7)
    names = "Annual report|Alter Vertrag|Lettre signée|Factura nueva|Zweite Rechnung|Floor plan|Bilan corrigé|Plano anual|Key register|Neues Handbuch".split("|")
    prose = (
        "The caretaker and our office sent the second letter at the end of March, because the total was wrong. Nobody knew why it had been so late.",
        "Der Hausmeister und unser Büro schickten den zweiten Brief Ende März, weil die Summe nicht stimmte. Niemand wusste, warum es so lange dauerte.",
        "Le gardien et notre bureau ont envoyé la deuxième lettre à la fin du mois de mars, car le total était faux. Personne ne savait pourquoi.",
        "El conserje y nuestra oficina enviaron la segunda carta a finales de marzo, porque el total no cuadraba. Nadie sabía por qué era así.",
    )

    def wrap(t: str, w: int) -> str:
        out, line = [], ""
        for word in t.split():
            if len(line) + len(word) > w and line:
                out.append(line)
                line = ""
            line += " " * bool(line) + word
        return "\n".join([*out, line])

    got = [("prose", t) for t in prose]
    got += [("prose", wrap(t, w)) for t in prose for w in (38, 72)] + [("prose", t.upper()) for t in prose] + [("prose", t.lower()) for t in prose]
    got += [("prose", f"{m} {t}") for t, m in zip(prose, ("1.", "§ 3.", "Art. 2.", "(4)"))] + [("prose", "\n".join(f"{i}. {t}" for i, t in enumerate(prose, 1)))]
    got += [("prose", wrap(t.upper(), 60)) for t in prose]
    plain = [" ".join(c for c in t.replace(",", "").replace(".", "").split()) for t in prose]  # as badly read or typed
    got += [("prose", t) for p in plain for t in (p.lower(), p, wrap(p.lower(), 60))]
    for k, mark in enumerate(("- ", "* ", "• ", "– ", "[ ] ", "{}. ", "{}) ", "")):
        got.append(("list", "\n".join(mark.format(i) + w for i, w in enumerate(names, 1))))
        got.append(("list", "\n".join(mark.format(i) + f"{w}: {w.split()[0].lower()}" for i, w in enumerate(names, 1))))
        got.append(("list", "\n".join(mark.format(i) + f"{(i * 7) % 19 + 1} x {w}" for i, w in enumerate(names, 1))))
        got.append(("list", "\n".join(mark.format(i) + f"{w}, {v.split()[1]}" for i, (w, v) in enumerate(zip(names, names[::-1]), 1))))
    got += [("list", "\n".join(f"{w} {'.' * (34 - len(w))} {3 * i}" for i, w in enumerate(names))), ("list", "\n".join(f"{i} {w} {'.' * 12} {3 * i}" for i, w in enumerate(names, 1)))]
    for sep in (" | ", ";", "\t", "   ", ","):
        rows = [[w, f"{i * 31.7 + 4:.2f}".replace(".", ","), f"{i % 28 + 1:02d}.{i % 12 + 1:02d}.20{i + 10}", v.split()[0]] for i, (w, v) in enumerate(zip(names, names[::-1]))]
        pad = (lambda c: c.ljust(20)) if sep == "   " else (lambda c: c)
        got.append(("table", "\n".join(sep.join(map(pad, r)) for r in rows)))
        got.append(("table", "\n".join(sep.join(map(pad, r[1:3] + r[1:2])) for r in rows)))
    got.append(("table", "\n".join("| " + " | ".join(r) + " |" for r in rows)))
    noise = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    got += [("junk", "\n".join(noise(b64, 76) for _ in range(6))), ("junk", noise(b64, 500)), ("junk", noise("0123456789abcdef", 400)), ("junk", " ".join(noise("0123456789abcdef", 2) for _ in range(150)))]
    got += [("junk", "".join(f"%{b:02X}" if b % 3 else chr(65 + b % 26) for b in rng.integers(0, 256, 200))), ("junk", noise("aeiou0lI1nrcmvw~^`°§<>{}[]()|\\/&%*+=;:,.?!'_- \n", 500))]
    got += [("junk", c * 300) for c in "=_.-*#�□xX0"] + [("junk", (a * 150)) for a in ("- ", ". ", "xX", "_ ", "* ", "=-", "\\o/ ")]
    letters = "abcdefghijklmnopqrstuvwxyz"
    for salad in (" ".join(noise(letters, int(n)) for n in rng.integers(2, 10, 90)), " ".join(noise("bdfklmnprst", 1) + noise("aeiou", 1) + noise(letters, 3) for _ in range(90))):
        got += [("junk", salad), ("junk", wrap(salad, 60)), ("junk", salad.capitalize() + ".")]  # words of no language
    for sep in (" | ", " > ", " · ", " / ", "  "):
        got.append(("junk", "\n".join([sep.join("Home Kontakt Login Suche Impressum Hilfe Start".split())] * 8)))
    got.append(("junk", "\n".join(f"2025-0{i % 9 + 1}-1{i % 9}T0{i % 9}:15:3{i % 9}Z {('INFO', 'WARN', 'ERR')[i % 3]} service[{8000 + 37 * i}] 0x{noise('0123456789abcdef', 8)}" for i in range(9))))
    got.append(("junk", "\n".join(f"[{i}.{i}00231] kernel: usb {i}-1: device 0x{noise('0123456789abcdef', 6)} at 10.0.{i}.{3 * i}:80{i}" for i in range(1, 9))))
    got.append(("junk", " ".join(("endobj", "(cid:%d)" % k, "/G%d" % k, "%d 0 R" % k, "<</Type", "�", "ﬁ")[k % 7] for k in rng.integers(1, 95, 120))))
    return got


def archetype_profiles() -> tuple[np.ndarray, list[str]]:
    seeds = archetypes()
    d = describe([t for _, t in seeds])
    return d["vectors"], [seeds[i][0] for i in d["block_doc"]]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Mean distributions of up to k clusters by divergence; starts from far points, so it is repeatable."""
    if len(x) <= k:
        return x
    centres = [x.mean(0)]
    d = divergence(x, centres[0][None])[:, 0]
    while len(centres) < k:
        centres.append(x[int(d.argmax())])
        d = np.minimum(d, divergence(x, centres[-1][None])[:, 0])
    c = np.stack(centres)
    for _ in range(rounds):
        own = divergence(x, c).argmin(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c.astype(np.float32)


class Profiles:
    def __init__(self, vectors: np.ndarray, forms: list[str]):
        self.vectors, self.forms = vectors.astype(np.float32), np.array([FORMS.index(f) for f in forms])

    @classmethod
    def fit(cls, labelled: list[tuple[str | None, str]], per_form: tuple[int, ...] = PROFILES) -> Profiles:
        """Profiles of the archetypes and of labelled texts."""
        if not labelled:
            return cls.of_blocks(np.zeros((0, sum(n for _, n in PARTS)), np.float32), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), per_form)
        d = describe([t for t, _ in labelled])
        label = np.array([FORMS.index(f) for _, f in labelled], int)[d["block_doc"]]
        return cls.of_blocks(d["vectors"], d["block_doc"], d["block_size"], label, per_form)

    @classmethod
    def of_blocks(cls, vectors: np.ndarray, document: np.ndarray, size: np.ndarray, label: np.ndarray, per_form: tuple[int, ...] = PROFILES) -> Profiles:
        """Profiles of the archetypes and of the blocks of labelled texts.

        A label names a whole text, so a block counts for it only where the archetypes don't see a better
        form for it: prose blocks of a list don't make profiles of lists, nor short odd blocks of prose.
        """
        base, forms = archetype_profiles()
        base_forms = np.array([FORMS.index(f) for f in forms])
        if len(vectors):
            near = base_forms[divergence(vectors, base).argmin(1)]
            biggest = np.zeros(len(label), bool)
            order = np.lexsort((-size, document))
            biggest[order[np.concatenate([[True], np.diff(document[order]) > 0])]] = True
            keep = (size >= 40) & ((near == label) | (biggest & ((label != 0) | (near == 0))))
            vectors, label = vectors[keep], label[keep]
        out, names = [], []
        for f, name in enumerate(FORMS):
            c = cluster(np.concatenate([base[base_forms == f], vectors[label == f]]), per_form[f])
            out.append(c)
            names += [name] * len(c)
        return cls(np.concatenate(out), names)

    def shares(self, d: dict[str, np.ndarray], n_doc: int) -> np.ndarray:
        """Characters of each document by form."""
        out = np.zeros((n_doc, len(FORMS)))
        if len(d["vectors"]):
            form = self.forms[divergence(d["vectors"], self.vectors).argmin(1)]
            np.add.at(out, (d["block_doc"], form), d["block_size"])
        return out


STATS = ("chars", "words", "mean_word", "symbol_ratio", "digit_ratio", "upper_ratio", "lines", "ended_lines", "bullet_lines", "common_words", "distinct_words", "repeated_lines")


def fit_profiles(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", form: str = "form", most: int = LABELLED, blocks: int = LABELLED_BLOCKS) -> Profiles:
    """Profiles from at most ``most`` labelled documents, those of the smallest hashes of their keys.

    The texts are described where they are; what is gathered are the vectors of at most the ``blocks``
    largest blocks of each.
    """
    chosen = labels.where(F.col(form).isin(*FORMS)).dropDuplicates([key]).select(F.col(key).alias("k"), F.col(form).alias("form")).orderBy(F.xxhash64("k"), "k").limit(most)
    # at most ``most`` rows; of a key that several documents share each counts
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select(F.xxhash64("k", "t").alias("h"), "t", "form")

    def fn(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("h", "form", "size", "vector")}
        for at, end in _portions(c["t"]):
            d = describe(c["t"][at:end])
            order = np.lexsort((-d["block_size"], d["block_doc"]))
            doc = d["block_doc"][order]
            start = np.searchsorted(doc, doc)
            for i in order[np.arange(len(doc)) - start < blocks]:
                n = at + int(d["block_doc"][i])
                for name, v in zip(out, (c["h"][n], c["form"][n], int(d["block_size"][i]), d["vectors"][i].tobytes())):
                    out[name].append(v)
        return out

    got = bounded(map_rows(rows, fn, "h bigint, form string, size bigint, vector binary"), 4 * most * blocks, "blocks of labelled documents")
    got = sorted(got, key=lambda r: (r["form"], r["h"], -r["size"], bytes(r["vector"])))
    width = sum(n for _, n in PARTS)
    vectors = np.frombuffer(b"".join(bytes(r["vector"]) for r in got), np.float32).reshape(-1, width)
    _, document = np.unique(np.array([r["h"] for r in got], np.int64), return_inverse=True)
    return Profiles.of_blocks(vectors, document, np.array([r["size"] for r in got], int), np.array([FORMS.index(r["form"]) for r in got], int))


def _portions(texts: list[str | None], most: int = 400_000) -> list[tuple[int, int]]:
    """From and to of portions by characters, so that long texts don't add up."""
    out, at = [], 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or "") < most):
            size += len(texts[end] or "") + 1
            end += 1
        out.append((at, end))
        at = end
    return out


def text_statistics(documents: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the statistics, ``prose_share`` and ``form`` of every text, one row per input row.

    Ratios of nothing are 0. A null, empty or blank text has share 0 and the form junk. Ties between forms
    go to the first of prose, list, table, junk.
    """
    kind = dict(documents.dtypes)[key]
    schema = f"key {kind}, chars bigint, words bigint, mean_word double, symbol_ratio double, digit_ratio double, upper_ratio double, lines bigint, ended_lines double, bullet_lines double, common_words double, distinct_words double, repeated_lines double, prose_share double, form string"

    def fn(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": c["key"], **{s: [] for s in STATS}, "prose_share": [], "form": []}
        for at, end in _portions(c["t"]):
            texts = c["t"][at:end]
            d = describe(texts)
            by = profiles.shares(d, len(texts))
            total = by.sum(1)
            prose = np.where(total > 0, by[:, 0] / np.maximum(total, 1), 0.0)
            rest = by[:, 1:].argmax(1) + 1
            form = np.where(total == 0, 3, np.where(prose < 0.5, rest, 0))
            for s in STATS:
                out[s] += d[s].tolist()
            out["prose_share"] += prose.tolist()
            out["form"] += [FORMS[f] for f in form]
        return out

    return map_rows(documents.select(F.col(key).alias("key"), F.col(text).alias("t")), fn, schema).withColumnRenamed("key", key)
