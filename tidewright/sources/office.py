"""Text out of zipped office files: documents, slides, sheets, diagrams. Damaged packages are salvaged as far as they go."""

from __future__ import annotations

import datetime
import io
import re
import struct
import xml.etree.ElementTree as et
import zipfile
import zlib

from tidewright.sources.model import Parsed, ParseError, register
from tidewright.sources.plain import TABLE_ROWS, ordered, table


def _inflated(raw: bytes, step: int = 512) -> bytes:
    """What a stream gives until it ends or breaks."""
    engine, out = zlib.decompressobj(-15), []
    try:
        for at in range(0, len(raw), step):
            out.append(engine.decompress(raw[at : at + step]))
            if engine.eof:
                break
    except zlib.error:
        pass
    return b"".join(out)


class Package:
    """Parts by name. Where the central directory is lost, local headers are followed and cut streams kept as far as they reach."""

    def __init__(self, data: bytes):
        self.salvaged, self.parts = False, {}
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                self.parts = {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}
        except Exception:
            self.salvaged, self.parts = True, self._follow(data)
        if not self.parts:
            raise ParseError("no part of the package can be read")

    @staticmethod
    def _follow(data: bytes) -> dict[str, bytes]:
        out, at = {}, data.find(b"PK\x03\x04")
        while 0 <= at <= len(data) - 30:
            method, size, named, extra = *struct.unpack_from("<8xH8xI", data, at), *struct.unpack_from("<HH", data, at + 26)
            name = data[at + 30 : at + 30 + named].decode("utf-8", "replace")
            begin = at + 30 + named + extra
            following = data.find(b"PK\x03\x04", begin)
            raw = data[begin : begin + size if size else following if following > 0 else len(data)]
            if method == 8:
                raw = _inflated(raw)
            if method in (0, 8) and raw and not name.endswith("/"):
                out[name] = raw
            at = following
        return out

    def names(self, pattern: str) -> list[str]:
        """Parts whose names fit, in the order of their numbers."""
        fit = [n for n in self.parts if re.fullmatch(pattern, n)]
        return sorted(fit, key=lambda n: [int(x) for x in re.findall(r"\d+", n)] or [0])

    def tree(self, name: str) -> et.Element | None:
        data = self.parts.get(name)
        if data is None:
            return None
        try:
            return et.fromstring(data)
        except et.ParseError:
            self.salvaged = True
            try:
                return et.fromstring(mended(data.decode("utf-8", "replace")))
            except et.ParseError:
                return None


def mended(text: str) -> str:
    """Cut after the last whole tag, bare ampersands escaped, open tags closed."""
    text = text[: text.rfind(">") + 1]
    text = re.sub(r"&(?!#?\w+;)", "&amp;", text)
    held = []
    for close, name, alone in re.findall(r"<(/?)([\w:.-]+)[^<>]*?(/?)>", text):
        if close:
            if held and held[-1] == name:
                held.pop()
        elif not alone:
            held.append(name)
    return text + "".join(f"</{n}>" for n in reversed(held))


def swept(data: bytes) -> list[str]:
    """Distinct text between tags with at least two letters: for parts beyond repair."""
    found = re.findall(r">([^<>]{2,})<", data.decode("utf-8", "replace"))
    return ordered(t.strip() for t in found if len(re.findall(r"[^\W\d_]", t)) >= 2)


def local(node: et.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def attribute(node: et.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def all_of(node: et.Element | None, *names: str):
    return (x for x in (node.iter() if node is not None else ()) if local(x) in names)


def properties(package: Package) -> dict[str, str]:
    """Core and application properties that have a value."""
    wanted = "title subject creator keywords description lastModifiedBy created modified category Pages Words Slides Application Company Paragraphs".split()
    out = {}
    for part in ("docProps/core.xml", "docProps/app.xml"):
        for node in package.tree(part) if package.tree(part) is not None else ():
            if local(node) in wanted and (node.text or "").strip():
                out[local(node)] = node.text.strip()
    return out


def package_of(data: bytes, main: str) -> Package:
    if data[:4] == b"\xd0\xcf\x11\xe0":
        if "EncryptedPackage".encode("utf-16-le") in data[: 1 << 17]:
            raise ParseError("the file is encrypted; remove its password first")
        raise ParseError("an older binary format under a newer suffix")
    package = Package(data)
    if not any(n.startswith(main) for n in package.parts):
        raise ParseError(f"not the package its suffix says: {main} is missing")
    return package


def _run(node: et.Element) -> str:
    out = []
    for x in node.iter():
        name = local(x)
        out.append(x.text or "" if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
    return "".join(out)


def _cells(node: et.Element, row: str, cell: str) -> list[list[str]]:
    return [[" ".join(filter(None, (_run(p).strip() for p in all_of(c, "p")))) for c in r if local(c) == cell] for r in node if local(r) == row]


@register([".docx", ".docm", ".dotx"], "word document")
def document(path: str, data: bytes) -> Parsed:
    package = package_of(data, "word/")

    def blocks(parent: et.Element | None) -> list[str]:
        out = []
        for node in parent if parent is not None else ():
            if local(node) == "tbl":
                out.append(table(_cells(node, "tr", "tc")))
            elif local(node) == "p":
                body = _run(node).strip()
                style = next((attribute(s, "val") or "" for s in all_of(node, "pStyle")), "")
                level = re.search(r"heading\s*(\d)", style, re.I)
                mark = "#" * min(int(level[1]), 6) + " " if level else "# " if style.lower() == "title" else "- " if any(True for _ in all_of(node, "numPr")) else ""
                out.append(f"*{body}*" if body and style.lower() == "caption" else mark + body if body else "")
            else:
                out += blocks(node)
        return [x for x in out if x]

    root = package.tree("word/document.xml")
    body = blocks(next(all_of(root, "body"), root)) if root is not None else swept(package.parts.get("word/document.xml", b""))
    for kind in ("header", "footer", "footnotes", "endnotes", "comments"):
        for name in package.names(rf"word/{kind}\d*\.xml"):
            more = [t for t in (_run(p).strip() for p in all_of(package.tree(name), "p")) if t]
            if more:
                body.append(f"[{kind}] " + "\n".join(more))
    return Parsed(path, "document", "\n\n".join(body), properties(package), ["the package is damaged"] * package.salvaged, "partial" if package.salvaged else "full")


@register([".pptx", ".pptm", ".potx"], "slides")
def slides(path: str, data: bytes) -> Parsed:
    package, out = package_of(data, "ppt/"), []
    names = package.names(r"ppt/slides/slide\d+\.xml")
    for n, name in enumerate(names, 1):
        tree, body = package.tree(name), []
        for shape in all_of(tree, "sp", "graphicFrame", "pic"):
            if local(shape) == "pic":
                body += [f"[image: {d}]" for d in (attribute(x, "descr") for x in all_of(shape, "cNvPr")) if d]
            elif tables := list(all_of(shape, "tbl")):
                body += [table(_cells(t, "tr", "tc")) for t in tables]
            else:
                body += [t for t in (_run(p).strip() for p in all_of(shape, "p")) if t]
        if tree is None:
            body = swept(package.parts[name])
        number = re.search(r"\d+", name)[0]
        notes = [t for t in (_run(p).strip() for p in all_of(package.tree(f"ppt/notesSlides/notesSlide{number}.xml"), "p")) if t and not t.isdigit()]
        out.append("\n".join([f"## Slide {n}", *body, *(["Notes: " + " ".join(notes)] if notes else [])]))
    return Parsed(path, "slides", "\n\n".join(out), properties(package) | {"slides": len(names)}, ["the package is damaged"] * package.salvaged, "partial" if package.salvaged else "full")


def column_number(ref: str) -> int:
    """A1 is 0, AA1 is 26."""
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def serial_text(value: float) -> str:
    """A day number since 1899-12-30 as a date, with its time if it has one."""
    at = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(value * 86400))
    return at.strftime("%Y-%m-%d" if at.time() == datetime.time() else "%Y-%m-%d %H:%M:%S")


# Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


@register([".xlsx", ".xlsm", ".xltx"], "spreadsheet")
def sheets(path: str, data: bytes) -> Parsed:
    package, warnings = package_of(data, "xl/"), []
    shared = [_run(si) for si in all_of(package.tree("xl/sharedStrings.xml"), "si")]
    styles = package.tree("xl/styles.xml")
    own = {attribute(f, "numFmtId") for f in all_of(styles, "numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", attribute(f, "formatCode") or ""), re.I)}
    formats = [attribute(x, "numFmtId") for xfs in all_of(styles, "cellXfs") for x in xfs]
    dated = [f in own or (f or "").isdigit() and int(f) in _DATE_FORMATS for f in formats]
    titles = [attribute(s, "name") for s in all_of(package.tree("xl/workbook.xml"), "sheet")]
    out, names = [], package.names(r"xl/worksheets/sheet\d+\.xml")

    def shown(cell: et.Element) -> str:
        kind, value = attribute(cell, "t"), next((v.text or "" for v in cell if local(v) == "v"), "")
        if kind == "s":
            return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
        if kind == "inlineStr":
            return _run(cell)
        if kind == "b":
            return "TRUE" if value == "1" else "FALSE"
        style = int(attribute(cell, "s") or 0)
        if value and kind in (None, "n") and style < len(dated) and dated[style]:
            try:
                return serial_text(float(value))
            except (ValueError, OverflowError):
                return value
        return value

    for k, name in enumerate(names):
        rows = []
        for row in all_of(package.tree(name), "row"):
            if len(rows) == TABLE_ROWS:
                warnings.append(f"{name}: only the first {TABLE_ROWS} rows")
                break
            cells: list[str] = []
            for cell in (c for c in row if local(c) == "c"):
                at = column_number(attribute(cell, "r") or "") if attribute(cell, "r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                cells[at] = shown(cell).strip()
            while cells and not cells[-1]:
                cells.pop()
            rows.append(cells)
        out.append(f"## {titles[k] if k < len(titles) else name}\n\n{table(rows)}")
    warnings += ["the package is damaged"] * package.salvaged
    return Parsed(path, "sheets", "\n\n".join(out), properties(package) | {"sheets": len(names)}, warnings, "partial" if package.salvaged else "full")


@register([".vsdx", ".vsdm"], "diagram")
def diagram(path: str, data: bytes) -> Parsed:
    """Shapes with text, and connectors as edges between them; an edge that lacks an end is left out."""
    package, out = package_of(data, "visio/"), []
    names = package.names(r"visio/pages/page\d+\.xml")
    for n, name in enumerate(names, 1):
        tree = package.tree(name)
        label = {attribute(s, "ID"): " ".join("".join(t.itertext()).split()) for s in all_of(tree, "Shape") for t in [next((x for x in s if local(x) == "Text"), None)] if t is not None}
        ends: dict[str, dict[str, str]] = {}
        for c in all_of(tree, "Connect"):
            ends.setdefault(attribute(c, "FromSheet"), {})["src" if (attribute(c, "FromCell") or "").startswith("Begin") else "dst"] = attribute(c, "ToSheet")
        edges = [f"{label[e['src']]} -> {label[e['dst']]}" + (f" ({label[k]})" if label.get(k) else "") for k, e in ends.items() if label.get(e.get("src")) and label.get(e.get("dst"))]
        out.append("\n".join([f"## Page {n}", *[f"- {v}" for k, v in label.items() if v and k not in ends], *ordered(edges)]))
    return Parsed(path, "diagram", "\n\n".join(out), properties(package) | {"pages": len(names)}, ["the package is damaged"] * package.salvaged, "partial" if package.salvaged else "full")


@register([".thmx"], "office theme")
def theme(path: str, data: bytes) -> Parsed:
    return Parsed(path, "theme", "\n".join(sorted(Package(data).parts)), {}, [], "metadata-only")
