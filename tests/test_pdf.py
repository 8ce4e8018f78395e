"""Text of PDF files that are written here, by this module's writer and by hand."""

import zlib

import pytest

from kgloom.sources import pdf as P


@pytest.mark.parametrize("compress", [True, False])
def test_text_comes_back(spark, compress):
    files = {"a": ["first line\nsecond (line) \\ here", "page two"], "b": ["é – 漢字 😀 ß", "", "x" * 3000], "c": ["one"]}
    df = spark.createDataFrame([(n, bytearray(P.pdf(p, compress))) for n, p in files.items()], "path string, content binary")
    got = {(r.path, r.page): (r.text, r.problem) for r in P.pdf_pages(df).collect()}
    want = {(n, i): (t, None if t else "empty page") for n, ps in files.items() for i, t in enumerate(ps, 1)}
    assert got == want


def by_hand(content, extra=b"", page=b"", head=b"%PDF-1.4\n"):
    body = b"<< /Length %d >>\nstream\n%b\nendstream" % (len(content), content)
    return head + b"1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[3 0 R]/Count 1>>\nendobj\n3 0 obj\n<</Type/Page/Contents 4 0 R" + page + b">>\nendobj\n4 0 obj\n" + body + b"\nendobj\n" + extra


def test_operators():
    text = rb"BT /F1 9 Tf 10 700 Td (Hel) Tj (lo \(big\) \101\n) Tj 0 -14 Td [(W) 20 (orld) -300 (again)] TJ (next) ' 1 0 0 1 5 5 Tm <48 69> Tj 5 0 Td (!) Tj ET"
    assert list(P.pages_of(by_hand(text))) == [(1, "Hello (big) A\nWorld again\nnext\nHi!", None)]


def test_objects_in_streams_and_later_versions():
    inner = b"3 0 4 36 <</Type/Page/Contents [6 0 R 7 0 R]>> unused"
    first = inner.index(b"<<")
    packed = zlib.compress(inner)
    raw = b"%%PDF-1.5\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids [3 0 R]>>\nendobj\n5 0 obj\n<</Type/ObjStm/N 2/First %d/Filter/FlateDecode/Length %d>>\nstream\n" % (first, len(packed)) + packed + b"\nendstream\nendobj\n"
    raw += b"6 0 obj\n<</Length 14>>\nstream\nBT (old) Tj ET\nendstream\nendobj\n6 0 obj\n<</Length 14>>\nstream\nBT (new) Tj ET\nendstream\nendobj\n7 0 obj\n<</Length 15>>\nstream\nBT (more) Tj ET\nendstream\nendobj\n"
    assert list(P.pages_of(raw)) == [(1, "new\nmore", None)]


def test_what_cannot_be_read_is_refused_by_name(spark):
    cases = {
        "encrypted": by_hand(b"BT (x) Tj ET", b"trailer <</Encrypt 9 0 R>>"),
        "not a PDF file": b"hello",
        "image only": by_hand(b"q /Im1 Do Q", page=b"/Resources<</XObject<</Im1 8 0 R>>>>"),
        "empty page": by_hand(b""),
        "no pages": b"%PDF-1.4\n",
    }
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in cases.items()], "path string, content binary")
    assert {r.path: r.problem for r in P.pdf_pages(df).collect()} == {n: n for n in cases}
    filtered = by_hand(b"x").replace(b"/Length 1 ", b"/Length 1 /Filter /LZWDecode ")
    assert list(P.pages_of(filtered)) == [(1, None, "a filter other than FlateDecode")]
