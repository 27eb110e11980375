"""Small files of many formats, made from a name and a number, for queries and tests of the parsers."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
FREE, END, FAT = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of up to some 60 KB: one table sector, the directory, then every stream in sectors in a row."""
    entry = lambda name, kind, start, size: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB12x36xIQ", 2 * len(name) + 2, kind, 1, start, size)
    sectors = (len(streams) + 1 + 3) // 4
    chain, place, body, entries = [FAT, *range(2, sectors + 1), END], 1 + sectors, b"", [entry("Root Entry", 5, END, 0)]
    for name, data in streams.items():
        n = max(1, -(-len(data) // 512))
        entries.append(entry(name, 2, place, len(data)))
        chain += [*range(place + 1, place + n), END]
        body += data.ljust(512 * n, b"\0")
        place += n
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 0, END, 0, END, 0, 0) + struct.pack("<108I", *[FREE] * 108)
    return head + struct.pack("<128I", *chain, *[FREE] * (128 - len(chain))) + b"".join(entries).ljust(512 * sectors, b"\0") + body


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def workbook(sheet: str, cells: bytes, before: bytes = b"") -> bytes:
    """A workbook stream: one sheet with these cell records; before: records of the workbook, as shared strings."""
    name = struct.pack("<HBB", 0, len(sheet), 0) + sheet.encode("latin-1")
    start = record(0x809, bytes(16))
    place = len(start) + 4 + 4 + len(name) + len(before) + 4
    return start + record(0x85, struct.pack("<I", place) + name) + before + record(0x0A, b"") + start + cells + record(0x0A, b"")


def atom(kind: int, body: bytes, container: bool = False) -> bytes:
    return struct.pack("<HHI", 15 if container else 0, kind, len(body)) + body


# Formats by suffix; each takes a name and a number.
OFFICE: dict[str, Callable[[str, int], bytes]] = {
    "docx": lambda name, n: zipped({"word/document.xml": f'<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{escape(name)}</w:t></w:r></w:p><w:p><w:r><w:t>No. {n}</w:t></w:r></w:p></w:body></w:document>'}),
    "xlsx": lambda name, n: zipped({"xl/workbook.xml": '<w><sheets><sheet name="One"/></sheets></w>', "xl/sharedStrings.xml": f"<s><si><t>{escape(name)}</t></si></s>", "xl/worksheets/sheet1.xml": f'<s><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>{n}</v></c></row></s>'}),
    "pptx": lambda name, n: zipped({"ppt/slides/slide1.xml": f"<s><sp><p><t>{escape(name)}</t></p></sp></s>", "ppt/slides/slide2.xml": f"<s><sp><p><t>{n}</t></p></sp></s>"}),
}
LEGACY: dict[str, Callable[[str, int], bytes]] = {
    "xls": lambda name, n: compound({"Workbook": workbook("One", record(0x204, struct.pack("<HHHHB", 0, 0, 0, len(name), 0) + name.encode("latin-1", "replace")) + record(0x203, struct.pack("<HHHd", 0, 1, 0, n)))}),
    "ppt": lambda name, n: compound({"PowerPoint Document": atom(1000, atom(1006, atom(4000, name.encode("utf-16-le")) + atom(4008, str(n).encode()), True), True)}),
    "msg": lambda name, n: compound({"__substg1.0_0037001F": name.encode("utf-16-le"), "__substg1.0_1000001F": f"No. {n}".encode("utf-16-le")}),
    "doc": lambda name, n: compound({"WordDocument": struct.pack("<2xH6xH12xII", 0x65, 0, 64, 64 + len(f"{name}\r{n}")).ljust(64, b"\0") + f"{name}\r{n}".encode("cp1252", "replace")}),
}
GRAPHICS: dict[str, Callable[[str, int], bytes]] = {
    "svg": lambda name, n: f'<svg xmlns="http://www.w3.org/2000/svg"><title>{escape(name)}</title><text>{n}</text></svg>'.encode(),
    "ps": lambda name, n: f"%!PS\n%%Title: {n}\n({name}) show\n".encode("latin-1", "replace"),
    "drawio": lambda name, n: f'<mxfile><diagram name="{n}"><m><mxCell id="1" value="{escape(name)}"/></m></diagram></mxfile>'.encode(),
    "png": lambda name, n: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", n, 1, 8, 2, 0, 0, 0) + bytes(4) + struct.pack(">I4s", len(name) + 2, b"tEXt") + b"k\0" + name.encode("latin-1", "replace") + bytes(4),
}
TEXTS: dict[str, Callable[[str, int], bytes]] = {
    "rtf": lambda name, n: rf"{{\rtf1{{\fonttbl x}}{name}\par {n}}}".encode("latin-1", "replace"),
    "ipynb": lambda name, n: json.dumps({"metadata": {}, "cells": [{"cell_type": "markdown", "source": [name]}, {"cell_type": "code", "source": str(n), "outputs": []}]}).encode(),
    "csv": lambda name, n: f"name;n\n{name};{n}\n".encode(),
    "jsonl": lambda name, n: (json.dumps({"name": name}) + "\n" + json.dumps({"n": n})).encode(),
    "json": lambda name, n: json.dumps([n]).encode(),
    "xml": lambda name, n: f"<?xml version='1.0'?><!-- <x> --><supplier>{n}</supplier>".encode(),
    "html": lambda name, n: f"<title>{n}</title><p>{escape(name)}</p><script>{n}</script>".encode(),
    "gz": lambda name, n: (lambda press: press.compress(name.encode()) + press.flush())(zlib.compressobj(wbits=31)),
}
