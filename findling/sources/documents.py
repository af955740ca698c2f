"""Text of documents by their bytes: plain files, web pages, mails, and office formats that are ZIP or text.

One function per format takes bytes and gives text; form feeds part pages. ``read_documents`` runs them where
the files are. What can't be read comes out as a reason, never as an error of the job: formats that need a
library this engine doesn't have (PDF glyphs, pictures, old binary office files) say so.
"""

from __future__ import annotations

import email
import email.policy
import html
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from findling.functions import filetypes as T
from findling.sources import ole, pdf

OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"


class Unreadable(ValueError):
    """The reason why a document has no text here."""


def decode(data: bytes) -> str:
    """Bytes as text: by their mark, else UTF-8, else windows-1252; zero bytes mean it isn't text."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(codec, "replace")
    if b"\0" in data[:8192]:
        raise Unreadable("binary")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


def web_page(text: str) -> str:
    body = re.sub(r"(?is)\A.*?<body\b[^>]*>", "", text)
    body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", body)
    body = re.sub(r"\s+", " ", body)
    body = re.sub(r"(?i)<br\b[^>]*>|</(?:p|div|li|tr|h[1-6]|table|ul|ol|blockquote|section|article|pre|dt|dd)\s*>", "\n", body)
    lines = (re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]*>", " ", x))).strip() for x in body.split("\n"))
    return "\n".join(x for x in lines if x)


def notebook(text: str) -> str:
    try:
        cells = json.loads(text)["cells"]
        return "\n\n".join("".join(c.get("source", "")) for c in cells)
    except (ValueError, KeyError, TypeError, AttributeError):
        return text


def mail_parts(data: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """Header block and body of a mail, and its attachments under names of their own."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    names: dict[str, int] = {}
    attached = []
    for part in m.walk():
        if part.is_multipart() or part.get_content_maintype() == "multipart":
            continue
        name = part.get_filename()
        inline = part.get("Content-ID") and part.get_content_maintype() == "image"
        if name and not inline:
            n = names[name.lower()] = names.get(name.lower(), 0) + 1
            stem, dot, ext = name.rpartition(".")
            unique = name if n == 1 else f"{stem} ({n}).{ext}" if dot else f"{name} ({n})"
            attached.append((unique, part.get_payload(decode=True) or b""))
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = web_page(text)
    head = [f"{h}: {m[h]}" for h in ("Subject", "From", "To", "Cc", "Date") if m[h]]
    if attached:
        head.append("Attachments: " + ", ".join(n for n, _ in attached))
    return "\n".join(head) + "\n\n" + text.strip(), attached


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unreadable("damaged_archive") from e


def word(data: bytes) -> str:
    """Paragraphs and table rows (``a | b``) in order; drawings, field codes and deleted text are left out."""
    with _zip(data) as z:
        root = ET.fromstring(z.read("word/document.xml"))

    def text(e: ET.Element) -> str:
        tag = _local(e.tag)
        if tag in ("drawing", "pict", "instrText", "del", "delText", "AlternateContent"):
            return ""
        if tag == "t":
            return e.text or ""
        if tag in ("tab", "br", "cr"):
            return "\t" if tag == "tab" else "\n"
        return "".join(map(text, e))

    def blocks(e: ET.Element) -> Iterator[str]:
        for x in e:
            tag = _local(x.tag)
            if tag == "p":
                yield text(x)
            elif tag == "tbl":
                for row in (r for r in x if _local(r.tag) == "tr"):
                    yield " | ".join(" ".join(blocks(c)) for c in row if _local(c.tag) == "tc")
            elif tag != "del":
                yield from blocks(x)

    return "\n".join(b for b in blocks(root) if b.strip())


def slides(data: bytes) -> str:
    with _zip(data) as z:
        names = set(z.namelist())
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        out = []
        for k, name in enumerate(sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number), 1):
            paragraphs = _paragraphs(z.read(name))
            out.append(f"Slide {k}:\n" + "\n".join(paragraphs))
            note = f"ppt/notesSlides/notesSlide{number(name)}.xml"
            if note in names and (said := [p for p in _paragraphs(z.read(note)) if not p.isdigit()]):
                out[-1] += "\nNotes: " + " ".join(said)
        return "\f".join(out)


def _paragraphs(xml: bytes) -> list[str]:
    out = []
    for p in (e for e in ET.fromstring(xml).iter() if _local(e.tag) == "p"):
        t = "".join(e.text or "" for e in p.iter() if _local(e.tag) == "t").strip()
        if t:
            out.append(t)
    return out


def workbook(data: bytes, most_rows: int | None = None) -> str:
    """Sheets as ``Sheet X:`` and rows ``a | b``; a longer sheet ends with a note of its rows."""
    with _zip(data) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in (e for e in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(e.tag) == "si"):
                shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"):
            rid = next(v for k, v in s.attrib.items() if _local(k) == "id")
            path = rels[rid].lstrip("/")
            rows = []
            for n, row in enumerate(e for e in ET.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter() if _local(e.tag) == "row"):
                if most_rows is not None and n >= most_rows:
                    rows.append("…")
                    break
                cells = []
                for c in row:
                    value = "".join(x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else {"1": "TRUE", "0": "FALSE"}.get(value, value) if c.get("t") == "b" else _number(value) if c.get("t") in (None, "n") else value)
                if any(cells):
                    rows.append(" | ".join(cells).rstrip(" |"))
            out.append(f"Sheet {s.get('name')}:\n" + "\n".join(rows))
        return "\f".join(out)


def _number(value: str) -> str:
    try:
        x = float(value)
    except ValueError:
        return value
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.10g}"


def open_document(data: bytes) -> str:
    """Text, sheets and slides of OpenDocument files, zipped or flat; tracked deletions are left out."""
    if data.startswith(b"PK"):
        with _zip(data) as z:
            if "META-INF/manifest.xml" in z.namelist() and b"encryption-data" in z.read("META-INF/manifest.xml"):
                raise Unreadable("password")
            data = z.read("content.xml")
    body = next((e for e in ET.fromstring(data).iter() if _local(e.tag) == "body"), None)
    if body is None:
        raise Unreadable("no_text")

    def text(e: ET.Element) -> str:
        out = e.text or ""
        for x in e:
            tag = _local(x.tag)
            if tag == "s":
                count = next((v for k, v in x.attrib.items() if _local(k) == "c"), "1")
                out += " " * int(count)
            elif tag in ("tab", "line-break"):
                out += "\t" if tag == "tab" else "\n"
            elif tag not in ("tracked-changes", "annotation", "note-citation"):
                out += text(x)
            out += x.tail or ""
        return out

    def name(e: ET.Element) -> str:
        return next((v for k, v in e.attrib.items() if _local(k) == "name"), "")

    def blocks(e: ET.Element) -> Iterator[str]:
        number = 0
        for x in e:
            tag = _local(x.tag)
            if tag in ("p", "h"):
                yield text(x)
            elif tag == "table":
                if _local(e.tag) == "spreadsheet":
                    yield f"Sheet {name(x)}:"
                for row in (r for r in x.iter() if _local(r.tag) == "table-row"):
                    cells = [" ".join(blocks(c)) for c in row if _local(c.tag) == "table-cell"]
                    if any(cells):
                        yield " | ".join(cells).rstrip(" |")
            elif tag == "page":
                number += 1
                yield f"Slide {number}:"
                yield from blocks(x)
            elif tag != "tracked-changes":
                yield from blocks(x)

    return "\n".join(b for b in blocks(body) if b.strip())


def rich_text(data: bytes) -> str:
    """RTF read token by token: groups of other destinations are skipped, code pages and \\u are heeded."""
    other = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "themedata", "generator", "fldinst", "listtable", "listoverridetable", "header", "footer", "datastore", "xmlnstbl", "latentstyles", "rsidtbl"}
    source = data.decode("latin-1")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skip, unicode_skip, drop, codec = False, 1, 0, "cp1252"
    for m in re.finditer(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+", source):
        control, number, byte, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((skip, unicode_skip))
        elif brace == "}":
            skip, unicode_skip = stack.pop() if stack else (False, 1)
        elif control:
            if control in other:
                skip = True
            elif control == "ansicpg" and number:
                codec = f"cp{number}"
            elif control == "uc":
                unicode_skip = int(number or 1)
            elif not skip and control in ("par", "line", "row", "sect"):
                out.append("\n")
            elif not skip and control == "page":
                out.append("\f")
            elif not skip and control in ("tab", "cell"):
                out.append("\t" if control == "tab" else " | ")
            elif not skip and control == "u" and number:
                out.append(chr(int(number) % 65536))
                drop = unicode_skip
            elif not skip and control in ("emdash", "endash", "bullet", "lquote", "rquote", "ldblquote", "rdblquote"):
                out.append(dict(emdash="—", endash="–", bullet="•", lquote="‘", rquote="’", ldblquote="“", rdblquote="”")[control])
        elif byte:
            if drop:
                drop -= 1
            elif not skip:
                out.append(bytes.fromhex(byte).decode(codec, "replace"))
        elif symbol:
            if symbol == "*":
                skip = True
            elif not skip:
                out.append({"~": "\u00a0", "_": "-", "-": ""}.get(symbol, symbol if symbol in "\\{}" else "\n" if symbol in "\r\n" else ""))
        elif plain and not skip:
            kept = plain[drop:]
            drop = max(0, drop - len(plain))
            out.append(kept)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def book(data: bytes) -> str:
    """An EPUB's pages in the order of its spine."""
    with _zip(data) as z:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        root = ET.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in root.iter() if _local(e.tag) == "item"}
        base = opf.rpartition("/")[0]
        pages = []
        for ref in (e.get("idref") for e in root.iter() if _local(e.tag) == "itemref"):
            path = f"{base}/{items[ref]}" if base else items[ref]
            if path in z.namelist() and (t := web_page(decode(z.read(path)))):
                pages.append(t)
        return "\f".join(pages)


def by_zip(data: bytes) -> Callable[[bytes], str]:
    with _zip(data) as z:
        names = z.namelist()
    for start, f in (("word/", word), ("ppt/", slides), ("xl/", workbook), ("content.xml", open_document), ("META-INF/container.xml", book)):
        if any(n.startswith(start) for n in names):
            return f
    raise Unreadable("type")


def sniff(data: bytes) -> str | None:
    """image, doc or text by the first bytes; null for what can't be read."""
    head = data[:4096]
    if not head:
        return None
    pictures = (b"\xff\xd8\xff", b"\x89PNG", b"GIF8", b"BM", b"II*\0", b"MM\0*", b"8BPS")
    if head.startswith(pictures) or head[8:12] in (b"WEBP", b"avif") or head[4:12] in (b"ftypheic", b"ftypavif", b"ftypmif1"):
        return "image"
    if head.startswith((b"%PDF", b"{\\rtf", OLE)):
        return "doc"
    if head.startswith(b"PK\x03\x04"):
        try:
            by_zip(data)
            return "doc"
        except Unreadable:
            return None
    if not head.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        if b"\0" in head or sum(1 for b in head if (b < 32 and b not in (9, 10, 12, 13)) or b == 127) > len(head) // 100:
            return None
    return "image" if b"<svg" in head[:1024].lower() else "text"


def extract(name: str, data: bytes) -> str:
    """The text of a file by its content first, then by its name."""
    ext = "." + name.rpartition(".")[2].lower() if "." in name.strip(".") else ""
    if not data:
        raise Unreadable("empty")
    if data.startswith(b"PK\x03\x04"):
        text = by_zip(data)(data)
    elif data.startswith(b"{\\rtf"):
        text = rich_text(data)
    elif data.startswith(OLE):
        try:
            text = ole.text(data)
        except ValueError as e:
            raise Unreadable(str(e) if str(e) in ("password", "type") else "damaged_document") from e
        except (struct.error, KeyError, IndexError) as e:
            raise Unreadable("damaged_document") from e
    elif data.startswith(b"%PDF"):
        try:
            text = pdf.text(data)
        except ValueError as e:
            raise Unreadable("password" if str(e) == "password" else "damaged_document") from e
        except (KeyError, IndexError, RecursionError, zlib.error) as e:
            raise Unreadable("damaged_document") from e
    elif ext in (".eml", ".mht", ".mhtml"):
        text = mail_parts(data)[0]
    elif ext in (".fodt", ".fods", ".fodp", ".fodg"):
        text = open_document(data)
    elif sniff(data) == "image" and ext != ".svg":
        raise Unreadable("needs_reader_picture")
    else:
        text = decode(data)
        if ext == ".ipynb":
            text = notebook(text)
        elif ext in (".html", ".htm", ".xhtml") or text.lstrip().startswith("<"):
            text = web_page(text)
    if not text.strip():
        raise Unreadable("no_text")
    return text


def problem(e: Exception) -> str:
    """A short key for what went wrong; anything else as said, without paths."""
    if isinstance(e, Unreadable):
        return f"!{e}"
    if isinstance(e, (zipfile.BadZipFile, ET.ParseError, KeyError)):
        return "!damaged_document"
    if isinstance(e, MemoryError):
        return "!no_memory"
    return re.sub(r"(?:[A-Za-z]:)?[\\/][^\s'\"]+", "…", str(e)).strip()[:300]


def read_documents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path, kind, text, error`` of files with their bytes; one of text and error is null.

    Files over the size limit of their kind aren't read (``!too_large``).
    """
    kind = F.coalesce(T.kind_of(F.col(path)), F.lit("text"))
    limited = files.select(F.col(path).alias("path"), kind.alias("kind"), F.when(F.length(content) <= T.max_bytes(kind, F.col(path)), F.col(content)).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for name, data in zip(b["path"], b["content"]):
                try:
                    if data is None:
                        raise Unreadable("too_large")
                    texts.append(extract(name, bytes(data)))
                    errors.append(None)
                except Exception as e:  # one bad file is a row with a reason
                    texts.append(None)
                    errors.append(problem(e))
            yield pd.DataFrame({"path": b["path"], "kind": b["kind"], "text": texts, "error": errors})

    return limited.mapInPandas(run, "path string, kind string, text string, error string")
