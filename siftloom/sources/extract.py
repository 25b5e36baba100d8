"""Files as text: extractors by type with the standard library, and their DataFrame form.

An extractor takes bytes and gives text or raises; a file that cannot be read,
for whatever reason, becomes a row with the error. PDF text needs a library
that may be missing, which is an error then; images give a placeholder.
"""

from __future__ import annotations

import datetime as dt
import email
import email.message
import email.policy
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import NamedTuple, Protocol
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.session import ship
from siftloom.sources.formats import matches, resolve

#: Cells and characters of a workbook, and characters of a cell, at most; a larger workbook is an error, a longer cell is cut with a note.
MAX_CELLS, MAX_CHARS, MAX_CELL_CHARS, HEADER_EVERY = 500_000, 5_000_000, 10_000, 50
#: Bytes that an archive may unpack to; larger ones are an error, as they may be made to fill the memory.
MAX_UNZIPPED = 200 << 20


def decode(data: bytes) -> str:
    """UTF-8 where the bytes are that, else by their mark, else by the character set that they look like, else UTF-8 with replacements; no byte is dropped."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-32" if data[:4] == b"\xff\xfe\0\0" else "utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    for name in likely_charsets(data):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def likely_charsets(data: bytes) -> Iterator[str]:
    """Names of character sets to try: what charset_normalizer tells where it is installed, else what NULs and letters suggest."""
    nul = data.count(0)
    if nul * 4 > len(data):
        yield "utf-16-le" if data[1::2].count(0) >= data[::2].count(0) else "utf-16-be"
    try:
        import charset_normalizer
    except ImportError:
        pass
    else:
        best = charset_normalizer.from_bytes(data).best()
        # text in wide characters has NULs or a mark
        if best is not None and (nul or not best.encoding.startswith(("utf_16", "utf_32"))):
            yield best.encoding
    high = sum(1 for x in data if x >= 0xC0)
    letters = high + sum(1 for x in data if 65 <= x <= 90 or 97 <= x <= 122)
    if high * 2 > letters:
        yield "cp1251"
    yield "cp1252"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.skipped: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skipped.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped and tag == self.skipped[-1]:
            self.skipped.pop()

    def handle_data(self, data: str) -> None:
        if not self.skipped and (text := data.strip()):
            self.found.append(text)


def html_text(markup: str) -> str:
    """The stripped text nodes, one a line, without scripts and styles."""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return "\n".join(parser.found)


def json_text(data: bytes) -> str:
    return json.dumps(json.loads(decode(data)), indent=2, ensure_ascii=False)


_CUE = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,]\d{1,3}\s*-->")


def cues_text(data: bytes) -> str:
    """The text of subtitle cues; the time stands before every tenth one, hours as minutes."""
    out: list[str] = []
    n = 0
    for block in re.split(r"\n\s*\n", decode(data).replace("\r\n", "\n").replace("\r", "\n")):
        lines = block.strip().split("\n")
        at = next((i for i, x in enumerate(lines) if _CUE.search(x)), None)
        if at is None or not (text := " ".join(x.strip() for x in lines[at + 1 :] if x.strip())):
            continue
        hours, minutes, seconds = _CUE.search(lines[at]).groups()
        if n % 10 == 0:
            out.append(f"[t={60 * int(hours or 0) + int(minutes):02d}:{seconds}]")
        out.append(re.sub(r"<[^>]+>", "", text))
        n += 1
    if not n:
        raise ValueError("no cues")
    return "\n".join(out)


def mail_text(data: bytes) -> str:
    """Headers, the plain body or else the HTML one as text, and the names of attachments."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    heads = [f"{k}: {message[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if message[k]]
    body = message.get_body(("plain", "html"))
    text = "" if body is None else _part_text(body) if body.get_content_subtype() == "plain" else html_text(_part_text(body))
    names = [f"[attachment: {a.get_filename() or 'unnamed'}]" for a in message.iter_attachments()]
    return "\n\n".join(filter(None, ["\n".join(heads), text.strip(), "\n".join(names)]))


def _part_text(part: email.message.EmailMessage) -> str:
    """A part as text; one whose character set nobody knows by what its bytes look like."""
    try:
        return part.get_content()
    except (LookupError, UnicodeError):
        return decode(part.get_payload(decode=True) or b"")


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not a zip archive") from e
    if sum(i.file_size for i in archive.infolist()) > MAX_UNZIPPED:
        raise ValueError("too large when unpacked")
    return archive


def _tree(archive: zipfile.ZipFile, name: str) -> ET.Element:
    """A member as XML; entity declarations are refused."""
    try:
        data = archive.read(name)
    except KeyError as e:
        raise ValueError(f"no {name}") from e
    if b"<!ENTITY" in data:
        raise ValueError(f"entities in {name}")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise ValueError(f"bad XML in {name}") from e


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _attr(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


def _table(rows: list[list[str]]) -> str:
    """A table in markdown, the first row as its head."""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join([c.replace("|", "\\|").replace("\n", " ") for c in cells] + [""] * (width - len(cells))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def roman(n: int) -> str:
    out = ""
    for value, letters in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += letters * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    """1 is a, 26 z, 27 aa."""
    out = ""
    while n > 0:
        n, rest = divmod(n - 1, 26)
        out = chr(97 + rest) + out
    return out


class Level(NamedTuple):
    """How a list's level counts and shows: its text has %1 for the first level's number and so on; ``legal`` shows all of them as plain digits."""

    form: str = "decimal"
    text: str = ""
    start: int = 1
    legal: bool = False


class Numbers(NamedTuple):
    """A list number: the base that it counts with, the base's levels, and levels that begin anew at a start of their own."""

    base: str
    levels: dict[int, Level]
    starts: dict[int, int]


# How the counts of a format are shown; bullets have none.
SHOWN: dict[str, Callable[[int], str]] = {"decimal": str, "lowerRoman": roman, "upperRoman": lambda n: roman(n).upper(), "lowerLetter": letters, "upperLetter": lambda n: letters(n).upper()}


def list_labels(items: Iterable[tuple[str, int]], lists: Mapping[str, Numbers]) -> Iterator[str]:
    """The label of each list paragraph (list number, level), in order.

    A base's counts are the path from its first level to the one counted last:
    a paragraph cuts the path at its level and puts its own count there, so
    whatever was deeper begins anew. A number's own start counts once.
    """
    paths: dict[str, tuple[int | None, ...]] = {}
    once = {(number, level): start for number, told in lists.items() for level, start in told.starts.items()}
    for number, depth in items:
        base, levels, _ = lists[number]
        of = lambda i: levels.get(i, Level(text=f"%{i + 1}."))  # noqa: B023, E731
        path = paths.get(base, ())
        path += (None,) * (depth + 1 - len(path))
        before = path[depth]
        count = once.pop((number, depth), of(depth).start if before is None else before + 1)
        paths[base] = path = (*path[:depth], count)
        yield label_of(path, of)


def label_of(path: tuple[int | None, ...], of: Callable[[int], Level]) -> str:
    """The text of the path's last level with its numbers put in; a level that was never counted shows its start."""
    own = of(len(path) - 1)
    if own.form == "bullet":
        return "-"

    def shown(m: re.Match) -> str:
        i = int(m[1]) - 1
        count = path[i] if 0 <= i < len(path) else None
        return SHOWN.get("decimal" if own.legal else of(i).form, str)(of(i).start if count is None else count)

    return re.sub(r"%([1-9])", shown, own.text)


def _numbering(archive: zipfile.ZipFile) -> dict[str, Numbers]:
    """The list numbers of a document."""
    if "word/numbering.xml" not in archive.namelist():
        return {}
    root = _tree(archive, "word/numbering.xml")
    own = lambda node, kind: [x for x in node if _local(x) == kind]
    one = lambda node, name, default: next((_attr(x, "val") for x in own(node, name)), default)
    on = lambda node, name: any(_attr(x, "val") not in ("0", "false", "off") for x in own(node, name))
    bases: dict[str | None, dict[int, Level]] = {}
    for told in own(root, "abstractNum"):
        levels = {int(_attr(x, "ilvl")): Level(one(x, "numFmt", "decimal"), one(x, "lvlText", ""), int(one(x, "start", "1")), on(x, "isLgl")) for x in own(told, "lvl")}
        bases[_attr(told, "abstractNumId")] = levels
    found = {}
    for num in own(root, "num"):
        base = one(num, "abstractNumId", "")
        starts = {int(_attr(o, "ilvl")): int(v) for o in own(num, "lvlOverride") if (v := one(o, "startOverride", None))}
        found[_attr(num, "numId")] = Numbers(base, bases.get(base, {}), starts)
    return found


def docx_text(data: bytes) -> str:
    """Paragraphs, with the labels of lists, and tables, in the document's order."""
    archive = _zip(data)
    lists = _numbering(archive)
    body = next((x for x in _tree(archive, "word/document.xml").iter() if _local(x) == "body"), None)

    def words(node: ET.Element) -> str:
        return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in node.iter())

    def item(node: ET.Element) -> tuple[str, int] | None:
        told = next((x for x in node.iter() if _local(x) == "numPr"), ())
        ids = {_local(x): _attr(x, "val") for x in told}
        return (ids["numId"], int(ids.get("ilvl") or 0)) if ids.get("numId") in lists else None

    blocks: list[tuple[str, tuple[str, int] | None]] = []
    for node in body if body is not None else ():
        if _local(node) == "p" and (text := words(node).strip()):
            blocks.append((text, item(node)))
        elif _local(node) == "tbl" and (rows := [[words(c).strip() for c in r if _local(c) == "tc"] for r in node if _local(r) == "tr"]):
            blocks.append((_table(rows), None))
    labels = list_labels([at for _, at in blocks if at], lists)
    return "\n\n".join(f"{next(labels)} {text}" if at else text for text, at in blocks)


#: The last column that a workbook may have, XFD.
MAX_COLUMNS = 16_384
# Fixed values of the published format: numbers of the built-in formats that show a date or a time, and what such a format of one's own holds outside quotes and brackets.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
DATE_SIGNS = re.compile("[dmhysDMHYS]")


def _column(ref: str) -> int:
    """The number of a cell's column, 0 without. Raises ValueError beyond the last one that there can be."""
    letters = re.match("[A-Z]*", ref)[0]
    column = 0
    for c in letters[:4]:
        column = 26 * column + ord(c) - 64
    if column > MAX_COLUMNS:
        raise ValueError(f"no column {letters[:8]}")
    return column


def _date_styles(archive: zipfile.ZipFile) -> set[str]:
    """The numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = _tree(archive, "xl/styles.xml")
    own = {_attr(x, "numFmtId"): re.sub(r'"[^"]*"|\\[\s\S]|\[[^\]]*\]', "", _attr(x, "formatCode") or "") for x in root.iter() if _local(x) == "numFmt"}
    dates = {str(n) for n in DATE_FORMATS} | {i for i, code in own.items() if i and DATE_SIGNS.search(code.split(";")[0])}
    styles = next((x for x in root.iter() if _local(x) == "cellXfs"), ())
    return {str(i) for i, x in enumerate(styles) if (_attr(x, "numFmtId") or "0") in dates}


def _date(serial: str, since: dt.datetime) -> str:
    """A serial number as an ISO date, with its time unless that is midnight; below one day a time; what is no such number stays."""
    try:
        days = float(serial)
        at = since + dt.timedelta(seconds=round(days * 86_400, 3))
    except (ValueError, OverflowError):
        return serial
    if 0 <= days < 1:
        return at.time().isoformat()
    return at.date().isoformat() if at.time() == dt.time() else at.isoformat()


def xlsx_text(data: bytes) -> str:
    """Each sheet under ``## Sheet: name``, cells joined by `` | ``; heading and head row come again every 50 rows."""
    archive = _zip(data)
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _tree(archive, "xl/sharedStrings.xml") if _local(s) == "si"]
    links = {_attr(r, "Id"): _attr(r, "Target") for r in _tree(archive, "xl/_rels/workbook.xml.rels")}
    dated = _date_styles(archive)
    old = any(_local(x) == "workbookPr" and _attr(x, "date1904") in ("1", "true") for x in _tree(archive, "xl/workbook.xml").iter())
    since = dt.datetime(1904, 1, 1) if old else dt.datetime(1899, 12, 30)
    out, cells, chars = [], 0, 0
    for sheet in (x for x in _tree(archive, "xl/workbook.xml").iter() if _local(x) == "sheet"):
        target = links.get(_attr(sheet, "id")) or ""
        heading, head, nth = f"## Sheet: {_attr(sheet, 'name')}", None, 0
        out.append(heading)
        root = _tree(archive, posixpath.normpath(posixpath.join("xl", target.lstrip("/").removeprefix("xl/"))))
        merged = {ref.partition(":")[0]: ref for x in root.iter() if _local(x) == "mergeCell" and (ref := _attr(x, "ref"))}
        for row in (x for x in root.iter() if _local(x) == "row"):
            values: list[str] = []
            for cell in row:
                column = _column(_attr(cell, "r") or "")
                values += [""] * (column - 1 - len(values))
                text = "".join(x.text or "" for x in cell.iter() if _local(x) in ("v", "t"))
                kind = _attr(cell, "t")
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind in (None, "n") and (_attr(cell, "s") or "0") in dated:
                    text = _date(text, since)
                if len(text) > MAX_CELL_CHARS:
                    text = f"{text[:MAX_CELL_CHARS]}...[truncated, {len(text)} chars]"
                if text and (ref := merged.get(_attr(cell, "r") or "")):
                    text = f"{text} [merged {ref}]"
                values.append(text)
            cells += len(values)
            line = " | ".join(v.replace("\n", " ") for v in values)
            chars += len(line)
            if cells > MAX_CELLS or chars > MAX_CHARS:
                raise ValueError("too many cells" if cells > MAX_CELLS else "too many characters")
            if not any(v.strip() for v in values):
                continue
            head = head or line
            if nth and nth % HEADER_EVERY == 0:
                out += [f"{heading} (continued)", head]
            out.append(line)
            nth += 1
    return "\n".join(out)


def pptx_text(data: bytes) -> str:
    """Each slide under ``## Slide n: title`` with its paragraphs, tables and notes."""
    archive = _zip(data)
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    said = lambda node: "".join(t.text or "" for t in node.iter() if _local(t) == "t").strip()
    for nth, (number, name) in enumerate(slides, 1):
        title, parts = "", []
        for shape in _tree(archive, name).iter():
            if _local(shape) == "sp":
                is_title = any(_local(x) == "ph" and _attr(x, "type") in ("title", "ctrTitle") for x in shape.iter())
                lines = [t for p in shape.iter() if _local(p) == "p" and (t := said(p))]
                if is_title and not title:
                    title = " ".join(lines)
                else:
                    parts += lines
            elif _local(shape) == "tbl":
                parts.append(_table([[said(c) for c in r if _local(c) == "tc"] for r in shape if _local(r) == "tr"]))
        notes = f"ppt/notesSlides/notesSlide{number}.xml"
        if notes in archive.namelist() and (text := "\n".join(t for p in _tree(archive, notes).iter() if _local(p) == "p" and (t := said(p)))):
            parts.append(f"Notes: {text}")
        out.append("\n".join([f"## Slide {nth}: {title}" if title else f"## Slide {nth}", *parts]))
    return "\n\n".join(out)


def odt_text(data: bytes) -> str:
    """Paragraphs and headings, one a line; tracked changes and annotations are left out."""
    lines: list[str] = []

    def walk(node: ET.Element, into: list[str]) -> None:
        kind = _local(node)
        if kind in ("tracked-changes", "annotation"):
            return
        own = [] if kind in ("p", "h") else into
        if kind == "s":
            own.append(" " * int(_attr(node, "c") or 1))
        elif kind == "tab":
            own.append("\t")
        elif kind == "line-break":
            own.append("\n")
        own.append(node.text or "")
        for child in node:
            walk(child, own)
            own.append(child.tail or "")
        if own is not into:
            lines.append("".join(own).strip())

    for body in (x for x in _tree(_zip(data), "content.xml").iter() if _local(x) == "body"):
        walk(body, [])
    return "\n".join(x for x in lines if x)


def epub_text(data: bytes) -> str:
    """Chapters in the order of the spine under ``## heading``; navigation, covers, and empty or missing ones are left out."""
    archive = _zip(data)
    if "META-INF/encryption.xml" in archive.namelist():
        raise ValueError("encrypted")
    package = next((_attr(x, "full-path") for x in _tree(archive, "META-INF/container.xml").iter() if _local(x) == "rootfile"), None)
    if not package:
        raise ValueError("no package")
    root = _tree(archive, package)
    items = {_attr(x, "id"): x for x in root.iter() if _local(x) == "item"}
    out = []
    for nth, ref in enumerate((x for x in root.iter() if _local(x) == "itemref"), 1):
        item = items.get(_attr(ref, "idref"))
        properties = (_attr(item, "properties") or "").split() if item is not None else ["nav"]
        if {"nav", "cover-image"} & set(properties) or "html" not in (_attr(item, "media-type") or ""):
            continue
        name = posixpath.normpath(posixpath.join(posixpath.dirname(package), _attr(item, "href") or ""))
        if name not in archive.namelist():
            continue
        markup = decode(archive.read(name))
        found = re.search(r"<title[^>]*>(.*?)</title>", markup, re.S | re.I) or re.search(r"<h1[^>]*>(.*?)</h1>", markup, re.S | re.I)
        heading = html_text(found[1]).replace("\n", " ").strip() if found else ""
        text = html_text(re.sub(r"(?is)<head\b.*?</head>", "", markup))
        if text:
            out.append(f"## {heading or f'Chapter {nth}'}\n\n{text}")
    return "\n\n".join(out)


def pdf_text(data: bytes) -> str:
    """Pages by pypdf where it is installed, normalised, joined by blank lines."""
    try:
        import pypdf
    except ImportError as e:
        raise ValueError("no PDF library") from e
    pages = [re.sub(r"[ \t]+", " ", re.sub(r"([a-z])-\n([a-z])", r"\1\2", p.extract_text() or "")).strip() for p in pypdf.PdfReader(io.BytesIO(data)).pages]
    return "\n\n".join(p for p in pages if p)


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}]+)", re.S)


def rtf_text(data: bytes) -> str:
    """Text of an RTF file: control words dropped, escapes resolved, destinations skipped.

    A character by its number is followed by what older readers show in its
    place, as many signs as ``\\uc`` says; those are passed over.
    """
    out: list[str] = []
    # of each open group: whether it is skipped, and how many signs follow a number
    groups, passed = [(False, 1)], 0
    for word, number, code, escaped, brace, plain in _RTF.findall(data.decode("latin-1")):
        skipped, shown = groups[-1]
        if brace:
            passed = 0
            if brace == "{":
                groups.append(groups[-1])
            elif len(groups) > 1:
                groups.pop()
        elif word in ("fonttbl", "colortbl", "stylesheet", "info", "pict") or escaped == "*":
            groups[-1] = (True, shown)
        elif word == "uc":
            groups[-1] = (skipped, max(0, int(number or 1)))
        elif skipped:
            continue
        elif plain:
            plain = plain.replace("\r", "").replace("\n", "")
            over = min(passed, len(plain))
            passed -= over
            out.append(plain[over:])
        elif passed:
            passed -= 1
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            passed = shown
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif escaped in ("\\", "{", "}"):
            out.append(escaped)
    # pairs of surrogates are one character, lone ones none
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace").strip()


EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    "pdf": pdf_text, "docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text, "odt": odt_text, "epub": epub_text, "rtf": rtf_text,
    "html": lambda b: html_text(decode(b)), "xml": lambda b: html_text(decode(b)), "json": json_text, "eml": mail_text, "srt": cues_text, "vtt": cues_text,
}


def extract(data: bytes, mime: str | None, name: str | None) -> tuple[str | None, str | None, str | None]:
    """(type, text, error): text without NUL characters, or what is wrong."""
    kind = resolve(mime, name)
    if kind is None:
        return None, None, "unknown type"
    if not matches(data, kind):
        return kind.key, None, "the content is of another type"
    if kind.key == "image":
        return kind.key, f"[image: {name or 'unnamed'}, no text extracted]", None
    try:
        text = EXTRACTORS.get(kind.key, decode)(data).replace("\x00", "")
        # what is no character cannot be stored as UTF-8
        text = text.encode("utf-8", "replace").decode("utf-8")
    except MemoryError:
        raise
    except Exception as e:  # noqa: BLE001  any damage is the file's, not the job's
        return kind.key, None, f"{type(e).__name__}: {e}".removeprefix("ValueError: ").rstrip(": ")
    return (kind.key, text, None) if text.strip() else (kind.key, None, "no text")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files under a path that fit a pattern: path, modificationTime, length, content. Raises ValueError for a path that climbs."""
    if ".." in path.split("/"):
        raise ValueError("the path climbs")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


class Connector(Protocol):
    """Where files come from: one under a name, or all that fit a pattern, as :func:`read_files` has them."""

    def files(self, spark: SparkSession, name: str = "", pattern: str = "*") -> DataFrame: ...


@dataclass(frozen=True)
class FolderConnector:
    """Files under a base path, and none beside it."""

    base: str

    def files(self, spark: SparkSession, name: str = "", pattern: str = "*") -> DataFrame:
        """Raises ValueError for a name that is absolute, climbs or names a drive."""
        if re.search(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:", name):
            raise ValueError(f"{name!r} leaves the base path")
        return read_files(spark, f"{self.base.rstrip('/')}/{name}".rstrip("/"), pattern)


def extract_files(files: DataFrame, name_col: str = "path", content_col: str = "content", mime_col: str | None = None) -> DataFrame:
    """A row for each file: name, file_type, text, error."""
    ship(files.sparkSession)
    mime = F.col(mime_col) if mime_col else F.lit(None).cast("string")
    rows = files.select(F.col(name_col).alias("name"), mime.alias("mime"), F.col(content_col).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                told = [extract(c or b"", m, (n or "").rpartition("/")[2]) for n, m, c in zip(*(part.column(k).to_pylist() for k in ("name", "mime", "content")), strict=True)]
                kinds, texts, errors = zip(*told, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("name"), *(pa.array(x, pa.string()) for x in (kinds, texts, errors))], ["name", "file_type", "text", "error"])

    return rows.mapInArrow(run, "name string, file_type string, text string, error string")


def html_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The text of each page: page_id, text; null stays null."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if h is None else html_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string")
