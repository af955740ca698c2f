"""Mails reduced to what their sender newly wrote, by decoding their lines into spans.

A mail's lines are a sequence of spans: authored text, quoted lines (with a mark before each), the line
that introduces a quotation, an open quotation (no marks, to the end), a signature, a device note, a legal
or company notice, a warning of the mail system. A semi-Markov model scores whole spans and the best
sequence is found by dynamic programming. A span's score is made of

* boundary cues: a separator, an introduction with a date and a verb of writing, header lines, an opening
  phrase, a blank line before;
* its length: introductions take what 220 characters hold, notices a part of a paragraph or all of it,
  signatures without a separator a paragraph or its end, all else any number of lines;
* features of the whole span: how many lines hold contact data or a company, whether the joined text of a
  notice speaks of recipients and errors, or of seat and register, or of printing and nature; what follows.

Cue words are matched with a few free characters where languages have letters beyond ASCII, so a mail that
was read in a wrong encoding is decoded like any other.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, functions as F

from findling.llm.arrow import map_rows

LABELS = ("authored", "quoted", "introduction", "original", "signature", "device", "notice", "warning")
A, P, T, O, S, D, L, W, G = range(9)  # G: a signature that a separator opened, line by line; S in the end
#: Patterns of boundary cues.
PREFIX = re.compile(r"^[ \t]{0,3}(?:[^\W\d_a-z]{1,3}>|[>|»])")
DATE = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.? [^\W\d_]{3,12}\.? \d{4}"
WROTE = r"\b(?:schrieb(?:en)?|wrote|a .{1,4}crit|escribi.{1,4})(?!\w)"
INTRO_CHARS = 220
INTRO = re.compile(rf"^(?=.{{10,{INTRO_CHARS}}}$)(?=.*(?:{DATE}|<[^<>\s]+@[^<>\s]+>)).*{WROTE}.*[::]\s*$", re.I)
INTRO_DATE = re.compile(rf"(?:am|on|le|el)\s+(?:{DATE})", re.I)
WRITES = re.compile(WROTE, re.I)
ORIGINAL = re.compile(
    r"^\s*(?:-{2,}|_{2,}|={2,})\s*[^\W\d_][^\n]{3,50}?\s*(?:-{2,}|_{2,}|={2,})\s*$"
    r"|^(?:begin|anfang|beginn|d.{1,4}but|inicio|start)\b.{0,25}\b(?:forwarded message|weitergeleiteten nachricht|message r.{1,4}exp.{1,4}di.{1,4}|message transf.{1,4}r.{1,4}|mensaje reenviado)\s?:\s*$",
    re.I,
)
HEAD_FROM = re.compile(r"^\*?(?:von|from|de|exp.{1,4}diteur)\s?:\*?\s+\S", re.I)
HEAD = re.compile(r"^\*?(?:von|from|de|exp.{1,4}diteur|gesendet|sent|date|datum|fecha|envoy.{1,4}|enviado(?: el)?|an|to|para|cc|betreff|subject|objet|asunto|[^\x00-\x7f]{1,4}\s?)\s?:\*?(?:\s+\S|\s*$)", re.I)
SEPARATOR = re.compile(r"^\s*(?:-{2,3}|—+|_{3,}|\*{3,}|={3,}|#{3,}|~{3,}|\+{3,}|(?:[-*_=] ){2,}[-*_=]?)\s*$")
DEVICE = re.compile(
    r"^(?=.{8,90}$)(?:(?:von|vom) .*\bgesendet|gesendet (?:von|mit|.{1,4}ber)|unterwegs gesendet|sent (?:from|with|via)|envoy.{1,4} (?:de|depuis)|enviado (?:desde|con))\b(?=.*|$)",
    re.I,
)
DEVICE_WORD = re.compile(r"handy|telefon|t.{1,4}l.{1,4}phone|phone|mobil|tablet|tel.{1,4}fono|m.{1,4}vil|smartphone|unterwegs|iphone|android|outlook|ipad", re.I)
WARNING = re.compile(r"^\W*(?:achtung|vorsicht|warnung|caution|warning|attention|atenci.{1,4}n|aviso|extern\w*|external)\b.{0,6}[:!\]–-]", re.I)
WARNING_WORD = re.compile(r"mail|courriel|correo|message|nachricht|mensaje|absender|sender|exp.{1,4}diteur|remitente", re.I)
PHONE = re.compile(r"^(?:(?:tel(?:efon)?|t.{1,4}l(?:.{1,4}phone)?|t|fon|phone|mobile?|mobil|fax|m.{1,4}vil)[.:]*\s*)\(?\+?[\d(][\d ()/.-]{5,}$", re.I)
MAIL_OR_WEB = re.compile(r"^(?:e?-?mail:?\s*)?(?:[\w.+-]+@[\w.-]+\.\w+|(?:https?://|www\.)\S+)$", re.I)
COMPANY = re.compile(r"\b(?:GmbH|AG|eG|KG|OHG|UG|e\.V\.|SARL|SAS|SA|S\.L\.|S\.A\.|Ltd|Inc|LLC|PLC|Insurance|Versicherung(?:en)?|Hausverwaltung|Assurances?|Seguros|Bank)\.?$|&\s+\S+$")
PIPES = re.compile(r"^\S.{1,60}? [|·•] \S")
POSTSCRIPT = re.compile(r"^P\.?\s?[SD]\.?\s?[::]", re.I)
SENTENCE = re.compile(r"[.!?…][\"'”“»)]*\s*$")
#: Word groups of notices; a notice needs all groups of one kind.
NOTICES = tuple(
    tuple(re.compile(g, re.I) for g in kind)
    for kind in (
        (r"vertraulich|confidential|confidentiel|confidencial|privileged|gesch.{1,4}tzt", r"empf.{1,4}nger|addressee|recipient|destinataire|destinatari", r"l.{1,4}schen|delete|d.{1,4}trui|b.{1,4}rrel|absender|sender|exp.{1,4}diteur|remitente|error|irrt.{1,4}m|erreur"),
        (r"\bsitz\b|is registered in|si.{1,4}ge social|domicilio social|registered office", r"registergericht|regist\w* n(?:o|r|\W)|HRB|HRA|RCS"),
        (r"umwelt|forest|environment|\bnature\b|bosque|medio ambiente|\barbres?\b|planet|b.{1,4}ume", r"druck|print|imprim"),
        (r"opinions?|ansichten|meinungen|opiniones", r"not necessarily|nicht (?:zwingend|unbedingt)|pas n.{1,4}cessairement|no necesariamente"),
    )
)
#: Words that the other sentences of a notice hold.
NOTICE_LINES = 7
NOTICE_MORE = re.compile(r"gesch.{1,4}ftsf.{1,4}hr|vorstand|aufsichtsrat|managing|director|g.{1,4}rant|gerente|administrador|\bUSt|\bVAT\b|\bTVA\b|\bNIF\b|e-?mail|courriel|correo|message|mensaje|nachricht", re.I)
HINTS = ("vertraulich", "confiden", "regist", "hrb", "umwelt", "forest", "environ", "nature", "bosque", "ambiente", "arbre", "planet", "druck", "print", "imprim", "opinion", "sitz ", "ge social", "domicilio")
WRITING = ("schrieb", "wrote", "crit", "escribi")


class Line:
    """A line's cues, all found once for every distinct line."""

    __slots__ = ("quoted", "separator", "original", "head", "head_from", "device", "warning", "contact", "company", "pipes", "postscript", "sentence", "words", "hint", "intro", "text", "cue", "worth")

    def __init__(self, text: str):
        self.text = text
        self.quoted = bool(PREFIX.match(text))
        for name in self.__slots__[1:13]:
            setattr(self, name, False)
        self.words, self.hint, self.intro, self.cue, self.worth = 0, False, False, self.quoted, 2.0
        if self.quoted:
            return
        low = text.lower()
        self.separator = bool(SEPARATOR.match(text))
        self.original = not self.separator and bool(ORIGINAL.match(text))
        self.head = ":" in text and bool(HEAD.match(text))
        self.head_from = self.head and bool(HEAD_FROM.match(text))
        self.device = bool(DEVICE.match(text)) and bool(DEVICE_WORD.search(text))
        self.warning = bool(WARNING.match(text)) and bool(WARNING_WORD.search(text))
        self.contact = bool(PHONE.match(text) or MAIL_OR_WEB.match(text))
        self.company = len(text) < 60 and " " in text.strip() and bool(COMPANY.search(text))
        self.pipes = bool(PIPES.match(text))
        self.postscript = bool(POSTSCRIPT.match(text))
        self.sentence = bool(SENTENCE.search(text)) and not self.company and not self.contact
        self.words = text.count(" ") + 1
        self.hint = any(w in low for w in HINTS)
        self.intro = bool(INTRO_DATE.match(text)) or (any(w in low for w in WRITING) and bool(WRITES.search(text)))
        self.worth = 8.0 * self.original + 5.5 * self.separator + 5.5 * self.intro + 4.0 * self.device + 3.0 * self.hint + 2.0 * (self.contact or self.company or self.pipes) + 1.0 * self.head
        self.cue = any((self.separator, self.original, self.head, self.device, self.warning, self.contact, self.company, self.pipes, self.hint, self.intro))


def notice_score(text: str) -> float:
    best = 0.0
    for kind in NOTICES:
        if all(g.search(text) for g in kind):
            best += 3.0 + len(kind)
    if best:  # what else it says must belong to a notice, too
        for sentence in re.split(r"(?<=[a-zß\x80-\uffff)][.!?]) +", text.strip()):
            if not NOTICE_MORE.search(sentence) and not any(g.search(sentence) for kind in NOTICES for g in kind):
                best -= 4.0
    return best


def decode(lines: list[Line], gaps: list[int], sender: str | None = None) -> list[int]:
    """Labels of the lines (blank ones left out; ``gaps`` counts those before each line).

    A line of nothing but the ``sender``'s names isn't a role.
    """
    n = len(lines)
    if not any(x.cue for x in lines):
        return [A] * n  # no span but authored text can score above it
    names: frozenset[str] | None = None
    best = [[-1e9] * 9 for _ in range(n + 1)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * 9 for _ in range(n + 1)]
    rest = [0.0] * (n + 1)  # what the cues from a line on are worth to an open quotation
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + lines[i].worth
    start = [-1e9] * 9
    start[A] = 0.0
    best[0] = start
    for i in range(n):
        x = lines[i]
        here = best[i]
        top = max(here)
        if top <= -1e8:
            continue
        from_any = here.index(top)

        def put(label: int, end: int, score: float, source: int) -> None:
            if score > best[end][label]:
                best[end][label] = score
                back[end][label] = (i, source)

        # authored: one line at a time, which gives lengths no limit
        own = -6.0 if x.quoted else -3.0 * (x.original or x.device or x.warning) - 2.0 * x.separator - 1.0 * x.contact
        if x.head and ((i and lines[i - 1].head) or (i + 1 < n and lines[i + 1].head)):
            own -= 2.0
        score, source = max(
            (here[A], A), (here[P], P), (here[D], D), (here[L], L), (here[W], W),
            (here[S] - (0.0 if x.postscript else 4.0), S), (here[G] - (0.0 if x.postscript else 4.0), G), (here[T] - 3.0, T),
        )
        if score > -1e8:
            put(A, i + 1, score + own, source)
        if x.quoted:
            score, source = max((here[A], A), (here[P], P), (here[T] + 1.0, T), (here[S], S), (here[G], G), (here[D], D), (here[L], L), (here[W], W))
            if score > -1e8:
                put(P, i + 1, score + 2.0, source)
            continue
        if here[G] > -1e8 and not x.original and not x.postscript:
            put(G, i + 1, here[G] + (1.0 if (x.contact or x.company or x.pipes) else -2.0 if x.words > 8 else 0.1), G)
        if not x.cue and (x.sentence or x.words > 8) and not (i + 1 < n and lines[i + 1].hint and not gaps[i + 1]):
            continue
        if x.intro:  # an introduction may be wrapped
            joined, k = x.text, 1
            while len(joined) <= INTRO_CHARS:
                if INTRO.match(joined):
                    follows = i + k == n or lines[i + k].quoted or lines[i + k].head_from or lines[i + k].original
                    put(T, i + k, top + (5.0 if follows else 1.5), from_any)
                    break
                if i + k >= n or lines[i + k].quoted or gaps[i + k]:
                    break
                joined = joined.rstrip() + " " + lines[i + k].text.strip()
                k += 1
        heads = 0
        j = i + (1 if (x.original or (x.separator and i + 1 < n and lines[i + 1].head_from)) else 0)
        if j < n and (lines[j].head_from or x.original):
            while j + heads < n and heads < 6 and lines[j + heads].head and not (heads and gaps[j + heads] > 1):
                heads += 1
        if x.original or heads >= 2:
            # an open quotation takes all that follows, and so accounts for all cues in it
            put(O, n, top + 4.0 + 3.0 * (x.original or x.separator) + min(heads, 4) + rest[j + heads], from_any)
        if x.device:
            put(D, i + 1, top + 4.0, from_any)
        if x.warning:
            put(W, i + 1, top + (5.0 if i == 0 or lines[i - 1].warning else 2.5), from_any)
            if not x.sentence and i + 1 < n and not gaps[i + 1] and not lines[i + 1].cue and lines[i + 1].sentence and lines[i + 1].words < 8:
                put(W, i + 2, top + 5.0, from_any)
        # notices: lines of a paragraph that together make one, ending where a sentence does; beyond some lines
        # only as a whole paragraph, so that a long one is read once and not from each of its lines
        if x.hint or (i + 1 < n and lines[i + 1].hint and not gaps[i + 1]):
            parts = []
            whole = not i or bool(gaps[i])
            for k in range(1, (n - i if whole else min(NOTICE_LINES, n - i)) + 1):
                y = lines[i + k - 1]
                if y.quoted or y.separator or (k > 1 and (gaps[i + k - 1] or y.original)):
                    break
                parts.append(y.text.strip())
                last = i + k == n or bool(gaps[i + k])
                if not last and (k > NOTICE_LINES or not SENTENCE.search(y.text)):
                    continue
                joined = " ".join(parts)
                score = notice_score(joined)
                if score > 0:
                    ends = last or lines[i + k].hint
                    put(L, i + k, top + score - 0.35 * (min(k, NOTICE_LINES) - 1) - (0.0 if ends else 1.5) + (0.5 if gaps[i] else 0.0), from_any)
        # signatures
        if x.separator and not x.original:
            put(G, i + 1, top + 5.0, from_any)
        elif (x.words <= 8 and not x.sentence or x.pipes) and not x.head_from:
            # without a separator: a paragraph of its own, or what stands under the closing formula and name
            offset = 0
            while offset < 4 and i - offset > 0 and not gaps[i - offset] and not lines[i - offset - 1].quoted and not lines[i - offset - 1].postscript:
                offset += 1
            if offset <= 3 and (not offset or lines[i - 1].words <= 5):
                score, proof = (0.5, -0.3, 0.0, -1.5)[offset], 0
                names = sender_names(sender) if names is None else names
                for k in range(1, n - i + 1):  # to the paragraph's end at most, from its first lines only
                    y = lines[i + k - 1]
                    if y.quoted or y.original or y.separator or y.postscript or y.device or (y.sentence and not y.pipes) or (k > 1 and gaps[i + k - 1] > 0):
                        break
                    known = y.contact or y.company or y.pipes
                    proof += known
                    if known:
                        score += 2.0
                    elif y.words > 5:
                        score -= 3.0
                    elif names and all(w in names for w in fold(y.text).split()):
                        score -= 1.2
                    else:  # a role, where a company or contact data stand right under it
                        score += 0.4 if i + k < n and not gaps[i + k] and (lines[i + k].contact or lines[i + k].company) and not lines[i + k].pipes else -0.8 if k > 1 else -1.4
                    if proof:
                        at_end = i + k == n or lines[i + k].quoted or gaps[i + k]
                        put(S, i + k, top + score - (0.0 if at_end else 2.0), from_any)
    label = max(range(9), key=lambda k: best[n][k])
    out, end = [A] * n, n
    while end > 0:
        begin, source = back[end][label]
        for k in range(begin, end):
            out[k] = S if label == G else label
        end, label = begin, source
    return out


def fold(text: str) -> str:
    """Lower case without marks, letters only."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss")) if not unicodedata.combining(c))
    return re.sub(r"[^a-z]+", " ", plain).strip()


def sender_names(sender: str | None) -> frozenset[str]:
    return frozenset(fold(sender).split()) if sender else frozenset()


class Decoder:
    def __init__(self, memo: int = 100_000):
        self.memo, self._lines = memo, {}

    def line(self, text: str) -> Line:
        got = self._lines.get(text)
        if got is None:
            if len(self._lines) >= self.memo:
                self._lines.clear()
            got = self._lines[text] = Line(text)
        return got

    def labels(self, body: str, sender: str | None = None) -> list[tuple[int, int]]:
        """(line number from 1, label) of the lines that hold more than white space."""
        numbers, lines, gaps, blank = [], [], [], 0
        for k, raw in enumerate(body.split("\n"), 1):
            text = raw.rstrip()
            if not text.strip():
                blank += 1
                continue
            numbers.append(k)
            lines.append(self.line(text))
            gaps.append(blank)
            blank = 0
        return list(zip(numbers, decode(lines, gaps, sender)))


def mail_lines(mails: DataFrame, key: str = "mail_id", body: str = "body", sender: str = "sender", others_only: bool = False) -> DataFrame:
    """``key, line_no, label`` of every line that holds more than white space.

    Null and empty bodies have no lines; repeated mails come out as often as they come in.
    """
    kind = dict(mails.dtypes)[key]
    state: dict = {}

    def fn(c: dict[str, list]) -> dict[str, list]:
        d = state.setdefault("d", Decoder())
        out: dict[str, list] = {"key": [], "line_no": [], "label": []}
        for k, t, who in zip(c["key"], c["body"], c["sender"]):
            for no, label in d.labels(t, who) if t else ():
                if label or not others_only:
                    out["key"].append(k)
                    out["line_no"].append(no)
                    out["label"].append(LABELS[label])
        return out

    narrow = mails.select(F.col(key).alias("key"), F.col(body).alias("body"), F.col(sender).alias("sender"))
    return map_rows(narrow, fn, f"key {kind}, line_no bigint, label string").withColumnRenamed("key", key)


def newly_written(mails: DataFrame, key: str = "mail_id", body: str = "body", sender: str = "sender") -> DataFrame:
    """``key, written``: each mail with only its newly written lines in their order.

    Runs of blank lines become one and outer ones go. A null body stays null; one of which nothing is new
    comes out empty. One row per input row.
    """
    kind = dict(mails.dtypes)[key]
    state: dict = {}

    def text(d: Decoder, t: str, who: str | None) -> str:
        keep = {no for no, label in d.labels(t, who) if label == A}
        out: list[str] = []
        for no, raw in enumerate(t.split("\n"), 1):
            line = raw.rstrip("\r")
            if no in keep:
                out.append(line)
            elif out and out[-1]:
                out.append("")
        return "\n".join(out).strip("\n")

    def fn(c: dict[str, list]) -> dict[str, list]:
        d = state.setdefault("d", Decoder())
        return {"key": c["key"], "written": [None if t is None else text(d, t, who) for t, who in zip(c["body"], c["sender"])]}

    narrow = mails.select(F.col(key).alias("key"), F.col(body).alias("body"), F.col(sender).alias("sender"))
    return map_rows(narrow, fn, f"key {kind}, written string").withColumnRenamed("key", key)
