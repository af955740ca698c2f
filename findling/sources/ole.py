"""Old binary office files: the compound file they live in, and the text of mails, documents, sheets, slides."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END = 0xFFFFFFFA  # and above: no sector


class CompoundFile:
    """Streams by path (names joined by /), read through the sector tables."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC) or len(data) < 512:
            raise ValueError("damaged_document")
        self.data = data
        self.size = 1 << struct.unpack_from("<H", data, 30)[0]
        self.mini = 1 << struct.unpack_from("<H", data, 32)[0]
        directory, self.cutoff, mini_fat, difat = (struct.unpack_from("<I", data, p)[0] for p in (48, 56, 60, 68))
        sectors = list(struct.unpack_from("<109I", data, 76))
        while difat < END and len(sectors) < 1_000_000:
            more = self._ints(self._sector(difat))
            sectors += more[:-1]
            difat = more[-1]
        self.fat: list[int] = []
        for s in sectors:
            if s < END:
                self.fat += self._ints(self._sector(s))
        self.mini_fat = self._ints(self._chain(mini_fat)) if mini_fat < END else []
        raw = self._chain(directory)
        self.entries = [raw[i : i + 128] for i in range(0, len(raw) - 127, 128)]
        self.streams: dict[str, tuple[int, int]] = {}
        start, length = self._place(0)
        self.mini_stream = self._chain(start)[:length] if start < END else b""
        self._list(struct.unpack_from("<I", self.entries[0], 76)[0], "", set())

    @staticmethod
    def _ints(raw: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _chain(self, n: int) -> bytes:
        out, seen = [], 0
        while n < END and n < len(self.fat) and seen <= len(self.fat):
            out.append(self._sector(n))
            n, seen = self.fat[n], seen + 1
        return b"".join(out)

    def _place(self, i: int) -> tuple[int, int]:
        return struct.unpack_from("<II", self.entries[i], 116)

    def _list(self, first: int, above: str, seen: set[int]) -> None:
        todo = [(first, above)]
        while todo:
            i, path = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            e = self.entries[i]
            length, kind = struct.unpack_from("<HB", e, 64)
            name = path + e[: max(0, length - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", e, 68)
            todo += [(left, path), (right, path)]
            if kind == 1:
                todo.append((child, name + "/"))
            elif kind == 2:
                self.streams[name] = self._place(i)

    def read(self, path: str) -> bytes:
        start, length = self.streams[path]
        if length >= self.cutoff:
            return self._chain(start)[:length]
        out, n = [], start
        while n < END and n < len(self.mini_fat) and len(out) * self.mini < length:
            out.append(self.mini_stream[n * self.mini : (n + 1) * self.mini])
            n = self.mini_fat[n]
        return b"".join(out)[:length]


def message(f: CompoundFile) -> tuple[str, list[tuple[str, bytes]]]:
    """Header block, body and attachments of an Outlook mail."""

    def prop(tag: str, under: str = "") -> str | None:
        for kind, codec in (("001F", "utf-16-le"), ("001E", "cp1252")):
            path = f"{under}__substg1.0_{tag}{kind}"
            if path in f.streams:
                return f.read(path).decode(codec, "replace").rstrip("\0")
        return None

    head = [f"{name}: {v}" for name, tag in (("Subject", "0037"), ("From", "0C1A"), ("To", "0E04"), ("Cc", "0E03")) if (v := prop(tag))]
    attached = []
    for under in sorted({p.split("/")[0] + "/" for p in f.streams if p.startswith("__attach_version1.0_")}):
        name = prop("3707", under) or prop("3704", under)
        path = f"{under}__substg1.0_37010102"
        if name and path in f.streams:
            attached.append((name, f.read(path)))
    if attached:
        head.append("Attachments: " + ", ".join(n for n, _ in attached))
    body = prop("1000")
    if not body and "__substg1.0_10130102" in f.streams:
        body = re.sub(r"(?s)<[^>]*>", " ", f.read("__substg1.0_10130102").decode("utf-8", "replace"))
    return "\n".join(head) + "\n\n" + (body or "").replace("\r\n", "\n").strip(), attached


def word(f: CompoundFile) -> str:
    """A document's text by its piece table; field codes go, cells are parted by bars."""
    main = f.read("WordDocument")
    flags = struct.unpack_from("<H", main, 10)[0]
    table = f.read("1Table" if flags & 0x200 else "0Table")
    if flags & 0x100:
        raise ValueError("password")
    length = struct.unpack_from("<I", main, 0x4C)[0]
    at, size = struct.unpack_from("<II", main, 0x1A2)
    clx, p = table[at : at + size], 0
    while p < len(clx) and clx[p] == 1:
        p += 3 + struct.unpack_from("<H", clx, p + 1)[0]
    size = struct.unpack_from("<I", clx, p + 1)[0]
    plc = clx[p + 5 : p + 5 + size]
    n = (len(plc) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", plc)
    out = []
    for k in range(n):
        where = struct.unpack_from("<I", plc, (n + 1) * 4 + k * 8 + 2)[0]
        count = ends[k + 1] - ends[k]
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            out.append(main[start : start + count].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * count].decode("utf-16-le", "replace"))
    text = "".join(out)[:length]
    text = re.sub(r"\x13[^\x13-\x15]*\x14([^\x13-\x15]*)\x15", r"\1", text)
    text = re.sub(r"\x13[^\x13-\x15]*\x15", "", text)
    text = re.sub(r"\x07\x07", "\n", text).replace("\x07", " | ")
    text = text.replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\f")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[\x00-\x08\x0e-\x1f]", "", text)).strip()


def _records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    p = 0
    while p + 4 <= len(raw):
        kind, size = struct.unpack_from("<HH", raw, p)
        yield kind, raw[p + 4 : p + 4 + size]
        p += 4 + size


class _Parts:
    """Bytes of a record and its continuations; a string's letters may change width where a part begins."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.p = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            got = self.parts[self.k][self.p : self.p + n]
            out, n, self.p = out + got, n - len(got), self.p + len(got)
            if self.p >= len(self.parts[self.k]) and n:
                self.k, self.p = self.k + 1, 0
        return out

    def string(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while count:
            if self.p >= len(self.parts[self.k]):
                self.k, self.p = self.k + 1, 0
                if self.k >= len(self.parts):
                    break
                wide, self.p = self.parts[self.k][0] & 1, 1
            here = (len(self.parts[self.k]) - self.p) // (2 if wide else 1)
            now = min(count, here)
            if not now:
                break
            out += self.take(now * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            count -= now
        self.take(4 * runs + extra)
        return out


def _rk(v: int) -> float:
    x = float(v >> 2 if v < 0x80000000 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return x / 100 if v & 1 else x


def _shown(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.10g}"


def sheets(f: CompoundFile, most_rows: int | None = None) -> str:
    """Sheets as ``Sheet X:`` and rows ``a | b``."""
    raw = f.read("Workbook" if "Workbook" in f.streams else "Book")
    records = list(_records(raw))
    names: list[tuple[int, str]] = []
    shared: list[str] = []
    for n, (kind, body) in enumerate(records):
        if kind == 0x2F:
            raise ValueError("password")
        if kind == 0x85:
            count, flags = body[6], body[7]
            names.append((struct.unpack_from("<I", body)[0], body[8 : 8 + count * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")))
        elif kind == 0xFC:
            parts = [body[8:]]
            for k, more in records[n + 1 :]:
                if k != 0x3C:
                    break
                parts.append(more)
            reader = _Parts(parts)
            shared = [reader.string() for _ in range(struct.unpack_from("<I", body, 4)[0])]
    out = []
    for start, name in names:
        rows: dict[int, dict[int, str]] = {}
        depth = 0
        for kind, body in _records(raw[start:]):
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if not depth:
                    break
            elif kind in (0xFD, 0x203, 0x27E, 0x06, 0x204):
                r, c = struct.unpack_from("<HH", body)
                if kind == 0xFD:
                    i = struct.unpack_from("<I", body, 6)[0]
                    v = shared[i] if i < len(shared) else ""
                elif kind == 0x27E:
                    v = _shown(_rk(struct.unpack_from("<I", body, 6)[0]))
                elif kind == 0x204:
                    v = _Parts([body[6:]]).string()
                else:
                    v = "" if kind == 0x06 and body[12:14] == b"\xff\xff" else _shown(struct.unpack_from("<d", body, 6)[0])
                rows.setdefault(r, {})[c] = v
            elif kind == 0xBD:
                r, c = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    rows.setdefault(r, {})[c + k] = _shown(_rk(struct.unpack_from("<I", body, 6 + 6 * k)[0]))
        lines = [" | ".join(cells[c] for c in sorted(cells) if cells[c]) for _, cells in sorted(rows.items())[:most_rows]]
        out.append(f"Sheet {name}:\n" + "\n".join(x for x in lines if x))
    return "\f".join(out)


def slides(f: CompoundFile) -> str:
    """Slides' texts in order; masters and their placeholders are left out."""
    raw = f.read("PowerPoint Document")
    found: list[list[str]] = []

    def atoms(a: int, z: int, into: list[str]) -> None:
        p = a
        while p + 8 <= z:
            head, kind, size = struct.unpack_from("<HHI", raw, p)
            begin, end = p + 8, min(p + 8 + size, z)
            if kind == 0x0FA0:
                into.append(raw[begin:end].decode("utf-16-le", "replace"))
            elif kind == 0x0FA8:
                into.append(raw[begin:end].decode("latin-1"))
            elif head & 15 == 15:
                atoms(begin, end, into)
            p = end if end > p else z

    def walk(a: int, z: int) -> None:
        p = a
        while p + 8 <= z:
            head, kind, size = struct.unpack_from("<HHI", raw, p)
            begin, end = p + 8, min(p + 8 + size, z)
            if kind == 0x0FF0 and head >> 4 == 0:  # the outline of the slides
                q = begin
                while q + 8 <= end:
                    _, inner, length = struct.unpack_from("<HHI", raw, q)
                    if inner == 0x03F3:
                        found.append([])
                    elif inner in (0x0FA0, 0x0FA8) and found:
                        found[-1].append(raw[q + 8 : q + 8 + length].decode("utf-16-le" if inner == 0x0FA0 else "latin-1", "replace"))
                    q += 8 + length
            elif kind == 0x03EE:
                own.append([])
                atoms(begin, end, own[-1])
            elif head & 15 == 15 and kind not in (0x03F8, 0x03F0):
                walk(begin, end)
            p = end if end > p else z

    own: list[list[str]] = []
    walk(0, len(raw))
    out = []
    for k in range(max(len(found), len(own))):
        texts = [*(found[k] if k < len(found) else []), *(own[k] if k < len(own) else [])]
        lines = [x for t in dict.fromkeys(texts) for x in re.split(r"[\r\n\x0b]", t) if x.strip()]
        out.append(f"Slide {k + 1}:\n" + "\n".join(lines))
    return "\f".join(out)


def text(data: bytes) -> str:
    f = CompoundFile(data)
    if "WordDocument" in f.streams:
        return word(f)
    if "Workbook" in f.streams or "Book" in f.streams:
        return sheets(f)
    if "PowerPoint Document" in f.streams:
        return slides(f)
    if any(p.startswith("__substg1.0_") for p in f.streams):
        return message(f)[0]
    raise ValueError("type")
