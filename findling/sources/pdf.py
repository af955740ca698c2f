"""Text of PDF pages as far as it stands in them as text: content streams read with the fonts' own tables.

Encrypted files and pages that are only pictures have no text here, which is a reason, not an error.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


class Pdf:
    def __init__(self, data: bytes):
        if b"/Encrypt" in data[-4096:] or re.search(rb"trailer.{0,2000}/Encrypt", data, re.S):
            raise ValueError("password")
        self.objects: dict[int, bytes] = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                raw = self.stream(body)
                n, first = self._int(body, b"N"), self._int(body, b"First")
                if raw is None or n is None or first is None:
                    continue
                head = list(map(int, raw[:first].split()[: 2 * n]))
                places = list(zip(head[::2], head[1::2]))
                for k, (number, at) in enumerate(places):
                    to = places[k + 1][1] if k + 1 < len(places) else len(raw) - first
                    self.objects.setdefault(number, raw[first + at : first + to])

    def _int(self, body: bytes, name: bytes) -> int | None:
        m = re.search(rb"/" + name + rb"\s+(\d+)(\s+\d+\s+R)?", body)
        if not m:
            return None
        return int(self.objects.get(int(m[1]), b"0").strip() or 0) if m[2] else int(m[1])

    def stream(self, body: bytes) -> bytes | None:
        m = re.search(rb"stream\r?\n", body)
        if not m:
            return None
        raw = body[m.end() :]
        length = self._int(body[: m.start()], b"Length")
        raw = raw[:length] if length and length <= len(raw) else re.sub(rb"\r?\n?endstream.*\Z", b"", raw, flags=re.S)
        if b"FlateDecode" in body[: m.start()]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                return None
        return raw

    def resolve(self, value: bytes | None) -> bytes:
        m = re.match(rb"\s*(\d+)\s+\d+\s+R", value or b"")
        return self.objects.get(int(m[1]), b"") if m else value or b""

    def entry(self, body: bytes, name: bytes) -> bytes | None:
        """A dictionary's value by name, as it stands: a reference, a dictionary, an array or a word."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return None
        rest = body[m.end() :]
        if rest.startswith((b"<<", b"[")):
            pair = (b"<<", b">>") if rest.startswith(b"<<") else (b"[", b"]")
            depth, p = 0, 0
            while p < len(rest):
                if rest.startswith(pair[0], p):
                    depth, p = depth + 1, p + len(pair[0])
                elif rest.startswith(pair[1], p):
                    depth, p = depth - 1, p + len(pair[1])
                    if not depth:
                        return rest[:p]
                else:
                    p += 1
            return rest
        return re.match(rb"\d+\s+\d+\s+R|/?[^\s/<>\[\]]+", rest)[0] if re.match(rb"\d+\s+\d+\s+R|/?[^\s/<>\[\]]+", rest) else None

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree; in file order where there is none."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[bytes] = []

        def walk(body: bytes, above: bytes | None, depth: int) -> None:
            own = self.entry(body, b"Resources") or above
            kids = self.entry(body, b"Kids")
            if kids is None:
                out.append(body if self.entry(body, b"Resources") or not own else body + b" /Resources " + own)
            elif depth < 40:
                for n in re.findall(rb"(\d+)\s+\d+\s+R", self.resolve(kids)):
                    if int(n) in self.objects:
                        walk(self.objects[int(n)], own, depth + 1)

        tree = self.resolve(self.entry(root, b"Pages"))
        if tree:
            walk(tree, None, 0)
        return out or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page(?![a-z])", b)]

    def fonts(self, page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Bytes of a code and the table of each font that a page names."""
        resources = self.resolve(self.entry(page, b"Resources"))
        table = self.resolve(self.entry(resources, b"Font"))
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", table):
            font = self.objects.get(int(n), b"")
            raw = self.stream(self.resolve(self.entry(font, b"ToUnicode"))) or b""
            codes: dict[int, str] = {}
            text = lambda h: bytes.fromhex(h.decode() + "0" * (len(h) % 2)).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
                for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", block):
                    codes[int(a, 16)] = text(b)
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
                for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    for k in range(min(int(z, 16) - int(a, 16) + 1, 65536)):
                        codes[int(a, 16) + k] = text(b)[:-1] + chr(ord(text(b)[-1:] or "?") + k)
            wide = b"/Type0" in font or b"Identity-H" in font
            out[name] = (2 if wide else 1, codes)
        return out

    def page_text(self, page: bytes) -> str:
        contents = self.entry(page, b"Contents")
        numbers = re.findall(rb"(\d+)\s+\d+\s+R", contents or b"")
        if len(numbers) == 1 and self.objects.get(int(numbers[0]), b"").lstrip().startswith(b"["):
            numbers = re.findall(rb"(\d+)\s+\d+\s+R", self.objects[int(numbers[0])])
        raw = b"\n".join(self.stream(self.objects.get(int(n), b"")) or b"" for n in numbers)
        fonts, font = self.fonts(page), (1, {})
        out: list[str] = []
        stack: list[bytes] = []

        def shown(t: bytes) -> str:
            if t.startswith(b"<"):
                digits = re.sub(rb"\s", b"", t[1:-1]).decode()
                codes = bytes.fromhex(digits + "0" * (len(digits) % 2))
            else:
                codes = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r\n") else ESCAPES.get(m[1], m[1]), t[1:-1], flags=re.S)
            width, table = font
            if width == 2:
                return "".join(table.get(int.from_bytes(codes[k : k + 2], "big"), "") for k in range(0, len(codes), 2))
            return "".join(table.get(c) or bytes([c]).decode("cp1252", "replace") for c in codes)

        for m in TOKEN.finditer(raw):
            t = m[0]
            if t in (b"Tj", b"TJ", b"'", b'"'):
                if t in (b"'", b'"'):
                    out.append("\n")
                for x in stack:
                    if x[:1] in b"(<" and x:
                        out.append(shown(x))
                    elif t == b"TJ" and re.fullmatch(rb"-\d+(?:\.\d+)?", x) and float(x) < -180:
                        out.append(" ")
                stack = []
            elif t in (b"Td", b"TD") and len(stack) >= 2:
                out.append("\n" if re.fullmatch(rb"[-+.\d]+", stack[-1]) and abs(float(stack[-1] or 0)) > 0.01 else " ")
                stack = []
            elif t in (b"T*", b"BT", b"Tm", b"ET"):
                out.append("\n")
                stack = []
            elif t == b"Tf":
                name = next((x[1:] for x in stack if x.startswith(b"/")), b"")
                font = fonts.get(name, (1, {}))
                stack = []
            elif re.fullmatch(rb"[A-Za-z*]+", t):
                stack = []
            else:
                stack.append(t)
        text = re.sub(r"\x02\n?|\u00ad\n", "", "".join(out))
        text = re.sub(r"[\x00-\x08\x0b\x0e-\x1f\ue000-\uf8ff]", " ", text)
        return "\n".join(x for x in (re.sub(r" {2,}", " ", y).strip() for y in text.split("\n")) if x)


def text(data: bytes) -> str:
    """The pages' texts, parted by form feeds; empty where the pages hold no text."""
    pdf = Pdf(data)
    return "\f".join(pdf.page_text(p) for p in pdf.pages()).strip("\f")
