"""Text of PDF files, a row a page, with the standard library: objects, Flate streams, object streams, page trees and text operators."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.DOTALL)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
#: Tokens of a content stream: strings, hex strings, arrays' ends, names, numbers, operators.
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.DOTALL)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.DOTALL)
NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A move of so many thousandths of the font's size to the right between two strings is a space.
WORD_GAP = 200


class Refused(ValueError):
    """What a file or page can't be read for."""


def stream_of(body: bytes) -> bytes | None:
    """The decoded stream of an object; None if it has none."""
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return None
    head, raw = body[: m.start()], body[m.end() : body.rfind(b"endstream")]
    length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
    raw = raw[: int(length[1])] if length else raw
    if b"/FlateDecode" in head:
        return zlib.decompressobj().decompress(raw)
    if b"/Filter" in head:
        raise Refused("a filter other than FlateDecode")
    return raw


def objects_of(raw: bytes) -> dict[int, bytes]:
    """Bodies by number; later ones replace earlier ones, as updates do."""
    found = {int(m[1]): m[3] for m in OBJECT.finditer(raw)}
    for body in list(found.values()):
        if b"/ObjStm" in body.split(b"stream", 1)[0]:
            data = stream_of(body) or b""
            n, first = (int(re.search(rb"/%b\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
            heads = [int(x) for x in data[:first].split()[: 2 * n]]
            starts = [first + x for x in heads[1::2]] + [len(data)]
            for number, a, z in zip(heads[::2], starts, starts[1:], strict=False):
                found.setdefault(number, data[a:z])
    return found


def entry(body: bytes, name: bytes, objects: dict[int, bytes]) -> bytes:
    """What follows a key of a dictionary, with a reference looked up."""
    m = re.search(rb"/%b(?![A-Za-z0-9])\s*(.*)" % name, body, re.DOTALL)
    if not m:
        return b""
    ref = re.match(rb"(\d+)\s+\d+\s+R\b", m[1])
    return objects.get(int(ref[1]), b"") if ref else m[1]


def unescaped(s: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else NAMED.get(c, b"" if c.strip(b"\r\n") == b"" else c)

    return ESCAPE.sub(one, s)


def unicode_map(cmap: bytes) -> dict[int, str]:
    """Characters by code of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(b)
            out |= {c: first[:-1] + chr(ord(first[-1]) + c - int(a, 16)) for c in range(int(a, 16), min(int(z, 16), int(a, 16) + 0xFFFF) + 1)}
    return out


def shown(token: bytes, codes: dict[int, str] | None) -> str:
    raw = unescaped(token[1:-1]) if token[:1] == b"(" else bytes.fromhex((h := re.sub(rb"\s", b"", token[1:-1]).decode()) + "0" * (len(h) % 2))
    if codes:
        width = 2 if max(codes) > 255 or token[:1] == b"<" else 1
        return "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
    return raw.decode("utf-16") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def page_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """The strings of the text operators; a new line where the text moves to one."""
    out, stack, codes = [], [], None
    for m in TOKEN.finditer(content):
        t = m[0]
        if t == b"Tf":
            codes = next((fonts.get(x[1:]) for x in reversed(stack) if x[:1] == b"/"), None)
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append("\n")
            for x in stack:
                if x[:1] in (b"(", b"<"):
                    out.append(shown(x, codes))
                elif t == b"TJ" and x[:1] not in (b"/", b"[", b"]") and float(x) < -WORD_GAP:
                    out.append(" ")
        elif t in (b"T*", b"TD", b"Td", b"Tm", b"ET"):
            down = t == b"T*" or t in (b"Tm", b"ET") or (len(stack) > 1 and float(stack[-1]) != 0)
            if down and out and not out[-1].endswith("\n"):
                out.append("\n")
        elif not (t[:1].isalpha() or t in (b"*",)):
            stack.append(t)
            continue
        stack = []
    return "".join(out).strip("\n")


def pages_of(raw: bytes) -> Iterator[tuple[int, str | None, str | None]]:
    """(page from 1, text, problem) of a file; what can't be read is refused by name."""
    if not raw.lstrip()[:5] == b"%PDF-":
        yield 0, None, "not a PDF file"
        return
    if re.search(rb"/Encrypt\s", raw):
        yield 0, None, "encrypted"
        return
    try:
        objects = objects_of(raw)
    except (Refused, zlib.error, TypeError, ValueError) as e:
        yield 0, None, f"broken: {e}"
        return
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    todo, pages = [entry(root, b"Pages", objects)], []
    while todo and len(pages) <= len(objects):
        node = todo.pop(0)
        if re.search(rb"/Type\s*/Pages", node):
            kids = re.match(rb"\s*\[(.*?)\]", entry(node, b"Kids", objects), re.DOTALL)
            todo = [objects.get(int(n), b"") for n in REFERENCE.findall(kids[1] if kids else b"")] + todo
        elif re.search(rb"/Type\s*/Page\b", node):
            pages.append(node)
    for number, page in enumerate(pages, 1):
        try:
            m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
            content = b"\n".join(stream_of(objects.get(int(n), b"")) or b"" for n in REFERENCE.findall(m[1] if m else b""))
            resources = entry(page, b"Resources", objects) or page
            fonts = {}
            for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", entry(resources, b"Font", objects)):
                cmap = entry(objects.get(int(ref), b""), b"ToUnicode", objects)
                if cmap:
                    fonts[name] = unicode_map(stream_of(cmap) or b"")
            text = page_text(content, fonts)
            yield number, text, None if text else "image only" if b"/XObject" in resources or b" Do" in content else "empty page"
        except (Refused, zlib.error, ValueError) as e:
            yield number, None, str(e)


def pdf_pages(files: DataFrame) -> DataFrame:
    """Rows (path, page, text, problem) of ``files`` (path, content). A file is one row here, as its objects lie anywhere in it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(pages_of(bytes(raw) if raw is not None else b"")) or [(0, None, "no pages")]
                yield pd.DataFrame({"path": path, "page": [r[0] for r in rows], "text": [r[1] for r in rows], "problem": [r[2] for r in rows]})

    return files.select("path", "content").mapInPandas(read, "path string, page int, text string, problem string")


def pdf(pages: list[str], compress: bool = True) -> bytes:
    """A minimal PDF of pages of text: each line a string, characters as two bytes with a ToUnicode map."""
    chars = sorted(set("".join(pages)) - {"\n"})
    code = {c: i + 1 for i, c in enumerate(chars)}
    blocks = ["".join(f"<{code[c]:04x}> <{c.encode('utf-16-be').hex()}>\n" for c in chars[i : i + 100]) for i in range(0, len(chars), 100)]
    cmap = "".join(f"{len(b.splitlines())} beginbfchar\n{b}endbfchar\n" for b in blocks).encode()
    stream = lambda s: (b"<< /Length %d%b >>\nstream\n" % (len(d := zlib.compress(s) if compress else s), b" /Filter /FlateDecode" if compress else b"")) + d + b"\nendstream"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", stream(cmap)]
    kids = []
    for text in pages:
        lines = " ".join(f"<{''.join(f'{code[c]:04x}' for c in line)}> Tj T*" for line in text.split("\n"))
        objects.append(stream(b"BT /F1 12 Tf 14 TL 40 800 Td " + lines.encode() + b" ET"))
        kids.append(len(objects) + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%b] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"
