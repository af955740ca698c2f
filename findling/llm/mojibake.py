"""Texts read in a wrong character encoding: found, and restored where that is possible.

Two ways in which bytes get misread are told apart.

* UTF-8 read in a legacy code page. Every character is mapped back to its byte in the code page; an
  automaton over the byte structure of UTF-8 (lead byte, then exactly its continuation bytes, no overlong
  forms, no surrogates) finds maximal well-formed multibyte spans, and only those are decoded. The code
  page that explains most is taken, and the whole is repeated for text that went through it twice.
* One legacy code page read as another. Single bytes have no structure, so a word is judged: it is damaged
  if some pair of code pages turns it into a word that is clearly better formed, or whose letter triples
  the corpus has far more often. The triples are counted over all texts; their number is bounded by the
  alphabet, not by the corpus.

Replacement characters and C1 controls are damage wherever they stand. Foreign scripts, symbols between
spaces and names in other Latin alphabets stay, since no reading makes better words of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from math import log

from pyspark.sql import DataFrame, functions as F

from findling.llm.arrow import map_rows
from findling.session import bounded

#: Code pages in which UTF-8 gets read, likeliest first.
READ_AS = ("cp1252", "iso8859_15", "cp1250", "cp1251", "cp1254", "iso8859_2", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "cp1253")
#: Fixed values: (read as, written in) for single-byte text.
PAIRS = tuple((w, t) for t in ("cp1252", "mac_roman", "cp850", "cp437") for w in ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp866", "cp1253", "cp1254", "iso8859_2") if w != t and {w, t} != {"cp437", "cp850"})
#: Letters beyond ASCII that German, French, Spanish, Portuguese and Scandinavian texts use.
LETTERS = set("äöüßÄÖÜàâæçéèêëîïôœùûÀÂÆÇÉÈÊËÎÏÔŒÙÛñáíóúÁÍÓÚÑãõÃÕåøÅØìòÌÒªº")
#: Letters that stand alone as a word.
ALONE = set("àÀéÉêÊôÔóÓúÚáÁýÂâ")
UNITS = re.compile(r"(?:^|[^A-Za-z])[kcdm]?m[²³]")
LOST = re.compile("[\u0080-\u0084\u0086-\u009f�]")
NOT_ASCII = re.compile(r"[^\x00-\x7f]")
TOKEN = re.compile(r"\S+")


def _to_byte(codec: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # an undefined byte usually comes out as the C1 control of its number
    if codec in ("cp1252", "iso8859_15"):
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


def _class(chars: dict[str, int], low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in chars.items() if low <= b <= high) + "]"


def automaton(codec: str) -> tuple[dict[str, int], re.Pattern[str]]:
    """A code page's characters as bytes, and the UTF-8 automaton over them."""
    chars = _to_byte(codec)
    k = lambda low, high: _class(chars, low, high)
    tail = k(0x80, 0xBF)
    forms = (
        k(0xC2, 0xDF) + tail, k(0xE0, 0xE0) + k(0xA0, 0xBF) + tail, k(0xE1, 0xEC) + tail * 2, k(0xED, 0xED) + k(0x80, 0x9F) + tail,
        k(0xEE, 0xEF) + tail * 2, k(0xF0, 0xF0) + k(0x90, 0xBF) + tail * 2, k(0xF1, 0xF3) + tail * 3, k(0xF4, 0xF4) + k(0x80, 0x8F) + tail * 2,
    )
    return chars, re.compile("(?:" + "|".join(forms) + ")+")


AUTOMATA = {c: automaton(c) for c in READ_AS}
#: A lead and a continuation byte of some code page; hardly a sound text has them side by side.
MAYBE_SPAN = re.compile("|".join(_class(chars, 0xC2, 0xF4) + _class(chars, 0x80, 0xBF) for chars, _ in AUTOMATA.values()))
WIDE = re.compile(r"[^\x00-\x7f]{2}")


def _swap(read_as: str, written: str) -> dict[int, str]:
    out = {}
    for c, b in _to_byte(read_as).items():
        try:
            right = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        if right != c and (right in LETTERS or right in "€’‘“”„–—…«»§°²³½¿¡·©®" or right == " "):
            out[ord(c)] = right
    return out


SWAPS = {p: _swap(*p) for p in PAIRS}


def _expected(text: str) -> bool:
    """Decoded characters that texts hold: Latin letters, punctuation, Greek, Cyrillic, boxes."""
    foreign = 0
    for c in text:
        o = ord(c)
        if 0xA0 <= o <= 0xFF or c in "ŒœŸŠšŽž€™" or 0x2010 <= o <= 0x203A:
            continue
        if 0x370 <= o <= 0x3FF or 0x400 <= o <= 0x45F:
            foreign += 1
        elif not 0x2500 <= o <= 0x259F and not 0x3040 <= o <= 0x9FFF and o < 0x1F300:
            if not 0x80 <= o < 0xA0:  # a C1 control may be the first layer of text read wrongly twice
                return False
    return foreign != 1


@lru_cache(maxsize=50_000)
def malformed(token: str) -> int:
    """How badly a run of characters between spaces is formed; 0 for words as languages write them."""
    if token.isascii():
        return 0
    bad = 0
    n = len(token)
    for i, c in enumerate(token):
        if c < "\x80":
            continue
        prev, nxt = token[i - 1] if i else "", token[i + 1] if i + 1 < n else ""
        a, b = prev.isalpha(), nxt.isalpha()
        if LOST.match(c):
            bad += 4
        elif c in "ªºµ":
            bad += 3 * (a and b)
        elif c.isalpha():
            latin = unicodedata.name(c, "").startswith("LATIN")
            if not latin and ((a and _latin(prev)) or (b and _latin(nxt))):
                bad += 3
            elif latin and c not in LETTERS:
                bad += 2
            elif latin and c.isupper() and a and prev.islower():
                bad += 3
            elif not a and not b and c not in ALONE:
                bad += 2 if latin else 1
            elif c == "ß" and (not a or (b and nxt.isupper())):
                bad += 2
        elif c in "’‘":
            bad += 0 if c == "’" else (a and b)
        elif c in "“”„–—…«»€":
            bad += 3 if a and b else 0
        elif c in "¿¡":
            bad += 2 if a else 0
        elif c in "²³½¼¾°§µ·©®™ ­":
            if a and b:
                bad += 3
            elif c in "²³" and a:
                bad += 0 if UNITS.search(token[: i + 1]) else 2
            elif c in "½¼¾·" and (a or b):
                bad += 2
        elif a or b:
            bad += 3 if (a and b) or 0x2500 <= ord(c) <= 0x259F else 2
    return bad


def _latin(c: str) -> bool:
    return c < "\x80" or unicodedata.name(c, "").startswith("LATIN")


def triples(token: str) -> list[str]:
    """Lower-case letter triples with a letter beyond ASCII; the alphabet bounds how many there can be."""
    w = "^" + token.strip(".,;:!?\"'()[]<>«»“”„*_|-").lower() + "$"
    out = []
    for i in range(len(w) - 2):
        t = w[i : i + 3]
        if not t.isascii() and all(c in "^$" or "a" <= c <= "z" or c in LETTERS for c in t):
            out.append(t)
    return out


def count_triples(texts) -> Counter:
    out: Counter = Counter()
    words: Counter = Counter()
    for t in texts:
        if t and not t.isascii():
            words.update(w for w in t.split() if not w.isascii())
    for w, n in words.items():
        for t in triples(w):
            out[t] += n
    return out


def _decode_layers(text: str, model: dict[str, int]) -> tuple[str, int]:
    """The text with well-formed UTF-8 spans decoded, and how many were."""
    total = 0
    for _ in range(4):
        if not WIDE.search(text) or not MAYBE_SPAN.search(text):
            break
        best = None
        for codec, (chars, pattern) in AUTOMATA.items():
            found: list[tuple[int, int, str]] = []
            for m in pattern.finditer(text):
                right = bytes(chars[c] for c in m.group()).decode("utf-8", "replace")
                if _expected(right):
                    found.append((m.start(), m.end(), right))
            if found:
                gain = sum(b - a for a, b, _ in found)
                out, at = [], 0
                for a, b, right in found:
                    out += [text[at:a], right]
                    at = b
                fixed = "".join(out) + text[at:]
                key = (gain * 4 - _badness(fixed, model), -READ_AS.index(codec))
                if best is None or key > best[0]:
                    best = (key, fixed, len(found))
        if best is None:
            break
        text, total = best[1], total + best[2]
    return text, total


def _badness(text: str, model: dict[str, int]) -> float:
    bad = 0.0
    for w in text.split():
        if not w.isascii():
            bad += malformed(w)
            t = triples(w)
            bad += sum(1 for x in t if model.get(x, 0) < 3) / 2
    return bad


class Restorer:
    """Finds and restores damage with the corpus's letter triples."""

    def __init__(self, model: dict[str, int], ratio: float = 4.0, memo: int = 50_000):
        self.model, self.ratio, self.memo, self._seen = model, ratio, memo, {}

    def _gain(self, token: str, other: str) -> float:
        """Above 1: the other reading's triples are ``ratio`` times as frequent, or it is better formed."""
        better = malformed(token) - malformed(other)
        if better < 0:
            return 0.0
        a, b = triples(token), triples(other)
        own = min((self.model.get(x, 0) for x in a), default=0)
        new = min((self.model.get(x, 0) for x in b), default=0)
        if better >= 2:
            return better + min(0.9, 0.1 * log(new + 1))
        if not b or (not a and not better):
            return 0.0
        return 2.0 if (new + 0.5) / (own + 0.5) >= self.ratio and new >= 3 else 0.5 * better

    def readings(self, token: str) -> dict[tuple[str, str], tuple[str, float]]:
        got = self._seen.get(token)
        if got is None:
            got = {}
            for pair, swap in SWAPS.items():
                other = token.translate(swap)
                if other != token and all(c < "\x80" or c in LETTERS or not c.isalpha() for c in other):
                    if all(c < "\x80" or ord(c) in swap for c in token):
                        g = self._gain(token, other)
                        if g > 0:
                            got[pair] = (other, g)
            if len(self._seen) >= self.memo:
                self._seen.clear()
            self._seen[token] = got
        return got

    def restore(self, text: str | None) -> tuple[str | None, bool, bool]:
        """(text, whether it was damaged, whether damage is left)."""
        if not text or text.isascii():
            return text, False, False
        fixed, spans = _decode_layers(text, self.model)
        damaged = spans > 0
        words = [w for w in fixed.split() if not w.isascii()]
        votes: Counter = Counter()
        sure: Counter = Counter()
        for w in set(words):
            for pair, (_, g) in self.readings(w).items():
                votes[pair] += g
                sure[pair] = max(sure[pair], g)
        if votes:
            top = max(votes, key=lambda p: (sure[p] >= 2, votes[p], -PAIRS.index(p)))
            if sure[top] >= 2:
                damaged = True

                def change(m: re.Match[str]) -> str:
                    w = m.group()
                    if w.isascii():
                        return w
                    got = self.readings(w).get(top)
                    if got and got[1] > 0:
                        return got[0]
                    best = max(self.readings(w).values(), key=lambda x: x[1], default=("", 0.0))
                    return best[0] if best[1] >= 2 else w

                fixed = TOKEN.sub(change, fixed)
        if spans and re.search(r"(?:^|\s)Ã(?=\s)", fixed):  # a no-break space that became a plain one
            fixed = re.sub(r"(^|\s)Ã(?=\s)", "\\1à", fixed)
        left = bool(LOST.search(fixed))
        return fixed, damaged or left, left


def letter_triples(rows: DataFrame, fields: list[str]) -> dict[str, int]:
    """Counts over all texts; each task adds up its own before the shuffle."""
    names = [f"f{i}" for i in range(len(fields))]

    def fn(c: dict[str, list]) -> dict[str, list]:
        got = count_triples(t for n in names for t in c[n])
        return {"triple": list(got), "n": list(got.values())}

    counted = map_rows(rows.select(*[F.col(f).cast("string").alias(n) for f, n in zip(fields, names)]), fn, "triple string, n bigint", slice_rows=20_000)
    most = (2 + 26 + len(LETTERS)) ** 3
    return {r[0]: r[1] for r in bounded(counted.groupBy("triple").agg(F.sum("n").alias("n")), most, "letter triples")}


def restore_fields(rows: DataFrame, key: str, fields: list[str], model: dict[str, int] | None = None) -> DataFrame:
    """``key, field, damaged, lost, restored``: one row per input row and field that isn't null.

    ``lost`` tells that characters remain that can't be had back. Empty texts come out undamaged, null
    texts not at all; repeated rows come out as often as they come in; an empty table gives an empty one.
    """
    model = letter_triples(rows, fields) if model is None else model
    kind = dict(rows.dtypes)[key]
    names = [f"f{i}" for i in range(len(fields))]
    state: dict = {}

    def fn(c: dict[str, list]) -> dict[str, list]:
        r = state.setdefault("r", Restorer(model))
        out: dict[str, list] = {n: [] for n in ("key", "field", "damaged", "lost", "restored")}
        for n, f in zip(names, fields):
            for k, t in zip(c["key"], c[n]):
                if t is not None:
                    text, damaged, lost = r.restore(t)
                    for name, v in zip(out, (k, f, damaged, lost, text)):
                        out[name].append(v)
        return out

    narrow = rows.select(F.col(key).alias("key"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names)])
    return map_rows(narrow, fn, f"key {kind}, field string, damaged boolean, lost boolean, restored string", slice_rows=1000).withColumnRenamed("key", key)
