"""The text of simple PDF files: page after page, without a library.

Objects are read by their marks, also those in compressed object streams; pages
follow the page tree. Of a page's content the strings that are shown count; a move
to another line ends a line, a wide gap between strings is a space. Strings are
Latin (PDFDocEncoding read as cp1252) or UTF-16 with its mark. Not read: encrypted
files, filters other than Flate, fonts whose codes are not characters. A file
that can't be read has no text (null).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*)\bendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+|/[^\s/<>\[\]()]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap of so many thousandths of the font size between strings is a space.
WIDE = 200


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Dictionary text and decoded stream of every object, by number."""
    held = {}
    for number, body in _OBJECT.findall(data):
        parts = _STREAM.match(body)
        head, stream = (parts[1], parts[2]) if parts else (body, b"")
        if b"/FlateDecode" in head:
            stream = zlib.decompressobj().decompress(stream)
        elif b"/Filter" in head:
            stream = b""
        held[int(number)] = (head, stream)
    for head, stream in list(held.values()):
        if re.search(rb"/Type\s*/ObjStm", head):
            first = int(re.search(rb"/First\s+(\d+)", head)[1])
            numbers = [int(x) for x in stream[:first].split()]
            ends = [*numbers[3::2], len(stream) - first]
            for number, a, b in zip(numbers[::2], numbers[1::2], ends, strict=True):
                held.setdefault(number, (stream[first + a : first + b], b""))
    return held


def _references(head: bytes, key: bytes) -> list[int]:
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found else []


def _pages(objects: dict[int, tuple[bytes, bytes]]) -> list[int]:
    root = next((n for n, (head, _) in objects.items() if re.search(rb"/Type\s*/Catalog", head)), None)
    out, open_, seen = [], _references(objects[root][0], b"Pages") if root is not None else [], set()
    while open_:
        number = open_.pop(0)
        if number in seen or number not in objects:
            continue
        seen.add(number)
        head = objects[number][0]
        if re.search(rb"/Type\s*/Pages", head):
            open_ = _references(head, b"Kids") + open_
        else:
            out.append(number)
    return out


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    out, last = [], []
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/" or token[:1] in b"+-.0123456789":
            last.append(token)
            continue
        numbers = [float(x) for x in last if x[:1] in b"+-.0123456789"]
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"') and out:
                out.append("\n")
            for x in last:
                if x[:1] in b"(<":
                    out.append(_string(x))
                elif token == b"TJ" and x[:1] in b"+-.0123456789" and float(x) < -WIDE:
                    out.append(" ")
        elif (token == b"T*" or token in (b"Td", b"TD", b"Tm") and len(numbers) > 1 and (token == b"Tm" or numbers[-1] != 0)) and out and out[-1] != "\n":
            out.append("\n")
        last = []
    return "".join(out).strip("\n")


def text_of(data: bytes | None) -> str | None:
    """The pages' texts, one after the other."""
    try:
        objects = _objects(data)
        texts = []
        for page in _pages(objects):
            streams = [objects[n][1] for n in _references(objects[page][0], b"Contents") if n in objects]
            texts.append(_shown(b"\n".join(streams)))
        return "\n".join(texts) if texts else None
    except (ValueError, TypeError, zlib.error, KeyError):
        return None


def pdf_text(files: DataFrame) -> DataFrame:
    """path, text of files read as binaryFile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [text_of(c) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
