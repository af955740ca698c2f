import zlib

import pytest

from findling.sources import documents as D

CMAP = b"1 beginbfchar <0001> <0047> endbfchar 2 beginbfrange <0002> <0003> <0072> <0004> <0004> <00FC> endbfrange"


def make(contents, packed=True):
    out, kids = [b"%PDF-1.4"], []
    obj = lambda n, body: out.append(b"%d 0 obj\n" % n + body + b"\nendobj")
    stream = lambda raw: b"<< /Length %d %s >>\nstream\n" % (len(z := zlib.compress(raw) if packed else raw), b"/Filter /FlateDecode" if packed else b"") + z + b"\nendstream"
    for k, raw in enumerate(contents):
        obj(20 + 2 * k, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (21 + 2 * k))
        obj(21 + 2 * k, stream(raw))
        kids.insert(0, b"%d 0 R" % (20 + 2 * k))  # the tree's order differs from the file's
    obj(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    obj(2, b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>")
    obj(5, b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>")
    obj(6, b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R >>")
    obj(7, stream(CMAP))
    return b"\n".join(out) + b"\ntrailer << /Root 1 0 R >>"


@pytest.mark.parametrize("packed", [True, False])
def test_pages_in_order_with_their_fonts(packed):
    one = rb"BT /F1 12 Tf 10 700 Td (Rental agree\(ment\)) Tj 0 -14 Td [(Pre) -20 (is:) -300 (5 \200)] TJ ET"
    two = b"BT /F2 9 Tf <00010002000400030003> Tj T* <0002> Tj ET"
    text = D.extract("lease.pdf", make([one, two], packed))
    assert text == "Grüss\nr\fRental agree(ment)\nPreis: 5 €"


def test_pdfs_without_text_have_a_reason():
    for raw, why in ((b"%PDF-1.4\n", "no_text"), (make([b"q 1 0 0 1 0 0 cm Q"]), "no_text"), (make([b"BT (x) Tj ET"]) + b" /Encrypt 9 0 R", "password")):
        with pytest.raises(D.Unreadable, match=why):
            D.extract("x.pdf", raw)
