"""Text functions as Column expressions: all stay in generated code."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WORD = r"[\p{L}\p{N}]+"
#: Words that a search leaves out, English and German.
STOPWORDS = tuple(
    """a an and are as at be by for from has have i in is it its me my of on or that the this to was were what when
    where which who with about find show
    aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für fur hat ich im in
    ist mein meine mit nach oder sich sie und von vom was wie wo zu zum zur""".split()
)
MOST_TERMS, PREFIX_LETTERS, WHOLE_WORD_BELOW = 12, 3, 4


@cache
def _table() -> tuple[str, str]:
    """Letters with marks and what they are without, for the blocks that Latin, Greek and Cyrillic use."""
    src, dst = [], []
    for lo, hi in ((0xC0, 0x250), (0x370, 0x400), (0x400, 0x530), (0x1E00, 0x2000)):
        for o in range(lo, hi):
            c = chr(o)
            plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if len(plain) == 1 and plain != c and c.lower() == c:
                src.append(c)
                dst.append(plain)
    return "".join(src), "".join(dst)


def normalize(text: Column) -> Column:
    """Lower case without marks (ß stays); the letters of Latin, Greek and Cyrillic blocks."""
    src, dst = _table()
    return F.translate(F.lower(text), src, dst)


@F.pandas_udf(T.StringType())
def normalize_full(texts: pd.Series) -> pd.Series:
    """The same for any script, decomposed marks and compatibility letters."""

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t if t is None else t.lower()
        marks = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not any(a <= ord(c) <= b for a, b in marks)).lower()

    return texts.map(one)


def words(text: Column) -> Column:
    """Runs of letters and digits of the normalised text."""
    return F.regexp_extract_all(normalize(text), F.lit(f"({WORD})"), 1)


def query_terms(query: Column) -> Column:
    """A query's terms: no stop words (unless there are only such), no single letters, each once, the first twelve."""
    real = F.filter(words(query), lambda w: (F.length(w) > 1) | w.rlike(r"^\p{N}$"))
    content = F.filter(real, lambda w: ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(F.when(F.size(content) > 0, content).otherwise(real)), 1, MOST_TERMS)


def last_is_prefix(terms: Column) -> Column:
    """Whether the last term also counts as the start of words: it has three letters or more."""
    return F.length(F.element_at(terms, -1)) >= PREFIX_LETTERS


def looks_like_identifier(query: Column) -> Column:
    return query.rlike(r"\p{Nd}|_|\w[.\-/]\w|\"")


def has_all_terms(terms: Column, text: Column) -> Column:
    """Every term begins a word of the text; terms of fewer than four letters are whole words."""
    spaced = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    return F.forall(terms, lambda t: F.contains(spaced, F.when(F.length(t) < WHOLE_WORD_BELOW, F.concat(F.lit(" "), t, F.lit(" "))).otherwise(F.concat(F.lit(" "), t))))


def round4(x: Column) -> Column:
    return F.round(x * 10000) / 10000


WHITE = r"[\p{IsWhite_Space}\x1c-\x1f]"
WHITE_IN_LINE = r"[\p{IsWhite_Space}\x1c-\x1f&&[^\n]]"


def tidy(text: Column) -> Column:
    """White space tidied: line ends unified, tabs as four spaces, no trailing spaces, inner runs to one space
    with the indentation kept, at most one blank line, nothing around."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.replace(t, F.lit("\t"), F.lit("    "))
    t = F.regexp_replace(t, WHITE_IN_LINE + r"+\n", "\n")
    t = F.regexp_replace(t, r"(?<=[^\p{IsWhite_Space}\x1c-\x1f])" + WHITE_IN_LINE + r"{2,}", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, rf"\A{WHITE}+|{WHITE}+\z", "")


def clean_page(text: Column) -> Column:
    """Text of a page: a mark of a soft line end joins, control and private-use characters become spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"\x02\r?\n?", ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}]", " ")


def has_odd_characters(text: Column) -> Column:
    """Control characters or private-use characters that an older reader left in a text."""
    return text.rlike(r"[\x01-\x08\x0B\x0C\x0E-\x1F\x{E000}-\x{F8FF}]")


#: Entities by name that are decoded without a full table.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "euro": "€", "eacute": "é", "egrave": "è", "ndash": "–", "mdash": "—", "hellip": "…", "copy": "©"}


def strip_html(html: Column) -> Column:
    """Scripts and styles removed, tags as spaces, the named entities above decoded (&amp; last)."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, c in ENTITIES.items():
        t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
    return F.replace(t, F.lit("&amp;"), F.lit("&"))


def html_lines(html: Column) -> Column:
    """From the body on, ends of blocks as line ends, tags off, spaces collapsed, no empty lines."""
    t = F.regexp_replace(html, r"(?is)\A.*?<body\b[^>]*>", "")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, r"(?i)<br\b[^>]*>|</(p|div|li|tr|h[1-6]|table|ul|ol|blockquote|section|article|pre|dt|dd)\s*>", "\n")
    lines = F.transform(F.split(strip_html(t), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s ]+", " ")))
    return F.concat(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit("\n"))


def notebook_text(raw: Column) -> Column:
    """Sources of a notebook's cells joined by blank lines; what isn't JSON stays as it is."""
    cells = F.from_json(raw, "cells array<struct<source: string>>")["cells"]
    # a source is a string or a list of lines, which comes out as JSON again
    text = F.transform(cells, lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"]))
    return F.coalesce(F.array_join(F.filter(text, lambda x: x.isNotNull()), "\n\n"), raw)


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """The terms marked where they begin a word, in any case."""
    if not terms:
        return text
    one = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({one})", before + "$1" + after)
