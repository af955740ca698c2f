import struct

import pytest

from findling.sources import containers as C, documents as D, ole


def compound(streams):
    """A compound file of streams by path, all of them in big sectors."""
    names, tree = [], {}
    for path in streams:
        for k in range(path.count("/") + 1):
            p = "/".join(path.split("/")[: k + 1])
            if p not in tree:
                tree[p] = 1 + len(names)
                names.append(p)
    sectors, fat = [], []

    def put(raw):
        start = len(sectors)
        parts = [raw[i : i + 512].ljust(512, b"\0") for i in range(0, max(len(raw), 1), 512)]
        sectors.extend(parts)
        fat.extend([*range(start + 1, start + len(parts)), 0xFFFFFFFE])
        return start

    places = {p: (put(d.ljust(4096, b"\0")), max(len(d), 4096)) for p, d in streams.items()}
    none = 0xFFFFFFFF

    def entry(name, kind, right, child, start, size):
        n = name.encode("utf-16-le")
        return (n + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", len(n) + 2, kind, 1) + struct.pack("<III", none, right, child) + b"\0" * 36 + struct.pack("<III", start, size, 0)

    def siblings(above):
        return [p for p in names if p.rpartition("/")[0] == above]

    first = lambda above: tree[siblings(above)[0]] if siblings(above) else none
    rows = [entry("Root Entry", 5, none, first(""), 0xFFFFFFFE, 0)]
    for p in names:
        peers = siblings(p.rpartition("/")[0])
        after = peers[peers.index(p) + 1 :]
        right = tree[after[0]] if after else none
        rows.append(entry(p.rpartition("/")[2], 2 if p in places else 1, right, first(p), *places.get(p, (0, 0))))
    directory = put(b"".join(rows).ljust(-(-len(rows) * 128 // 512) * 512, b"\0"))
    where = len(sectors)
    fat.append(0xFFFFFFFD)
    n_fat = -(-(len(fat) + 2) // 128)
    fat += [0xFFFFFFFD] * (n_fat - 1)
    table = b"".join(struct.pack("<I", x) for x in fat).ljust(n_fat * 512, b"\xff")
    head = ole.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIIII", n_fat, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, where)
    head += struct.pack("<108I", *[where + 1 + k if k < n_fat - 1 else none for k in range(108)])
    return head.ljust(512, b"\0") + b"".join(sectors) + table


def doc(text):
    main = bytearray(0x600)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<I", main, 0x4C, len(text))
    half = len(text) // 2
    wide, narrow = text[:half].encode("utf-16-le"), text[half:].encode("cp1252")
    plc = struct.pack("<III", 0, half, len(text)) + struct.pack("<HIH", 0, 0x600, 0) + struct.pack("<HIH", 0, 0x40000000 | (0x600 + len(wide)) * 2, 0)
    clx = b"\x01\x02\x00ab\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    return compound({"WordDocument": bytes(main) + wide + narrow, "1Table": clx})


def test_word():
    text = "Sehr geehrte Frau Beispiel,\rdie Miete steigt \x13 PAGE \x142\x15 ab Mai – für alle.\ra\x07b\x07\x07Ende"
    assert D.extract("Brief.doc", doc(text)) == "Sehr geehrte Frau Beispiel,\ndie Miete steigt 2 ab Mai – für alle.\na | b\nEnde"


def test_mail_and_its_attachment():
    u = lambda t: t.encode("utf-16-le")
    raw = compound({"__substg1.0_0037001F": u("Rechnung"), "__substg1.0_0C1A001F": u("Ann"), "__substg1.0_1000001F": u("Hallo\r\nText"), "__attach_version1.0_#00000000/__substg1.0_3707001F": u("preise.txt"), "__attach_version1.0_#00000000/__substg1.0_37010102": b"1;2"})
    text = D.extract("Rechnung.msg", raw)
    assert text.startswith("Subject: Rechnung") and "Attachments: preise.txt" in text and text.endswith("Hallo\nText")
    assert [(p, s) for p, _, _, _, s in C.walk("m.msg", raw)] == [("m.msg\\preise.txt", None)]


def test_sheets():
    r = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    long_ = "y" * 30
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", 5, 0) + b"Miete" + struct.pack("<HB", 34, 0) + b"Lang" + long_[:10].encode()
    cells = r(0x809, b"\0" * 16) + r(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + r(0x203, struct.pack("<HHHd", 0, 1, 0, 59.5)) + r(0xFD, struct.pack("<HHHI", 1, 0, 0, 1)) + r(0x27E, struct.pack("<HHHI", 1, 1, 0, (800 << 2) | 2)) + r(0x0A, b"")
    begin = r(0x809, b"\0" * 16)
    rest = r(0xFC, sst) + r(0x3C, b"\0" + long_[10:].encode()) + r(0x0A, b"")
    sheet = lambda at: r(0x85, struct.pack("<IHBB", at, 0, 6, 0) + b"Kosten")
    globals_ = begin + sheet(len(begin + sheet(0) + rest)) + rest
    assert D.extract("H.xls", compound({"Workbook": globals_ + cells})) == f"Sheet Kosten:\nMiete | 59.5\nLang{long_} | 800"


def test_slides():
    a = lambda kind, body, head=0: struct.pack("<HHI", head, kind, len(body)) + body
    listed = a(0x03F3, b"\0" * 20) + a(0x0FA0, "Urlaubsplanung".encode("utf-16-le")) + a(0x03F3, b"\0" * 20) + a(0x0FA8, b"Zwei\rDrei")
    raw = a(0x03E8, a(0x0FF0, listed, 0x0F), 0x0F) + a(0x03F8, a(0x0FA8, b"Master"), 0x0F) + a(0x03EE, a(0x0FA8, b"Kasten"), 0x0F)
    assert D.extract("V.ppt", compound({"PowerPoint Document": raw})).replace("\f", "\n") == "Slide 1:\nUrlaubsplanung\nKasten\nSlide 2:\nZwei\nDrei"


@pytest.mark.parametrize("raw", [ole.MAGIC, ole.MAGIC + b"\xff" * 600, doc("x")[:700]])
def test_damage_has_a_reason(raw):
    with pytest.raises(D.Unreadable):
        D.extract("x.doc", raw)
