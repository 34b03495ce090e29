"""Raw folders as a data source, with DOCX and simple PDF read by the standard library.

`read_folder` plans partitions by bytes: files go to a task until it has PARTITION_BYTES, so
that many small files don't make many tasks. A file is parsed within its task by suffix:
DOCX as its paragraphs, then its tables as pipe tables; PDF as its pages' texts; whatever
else as UTF-8 without undecodable bytes. A file that can't be parsed gives an empty text,
and empty texts drop out, as do hidden files.

PDF: content streams, plain or deflated, with strings in single-byte encodings. Object
streams, encryption and fonts with character maps of their own are not read; with pypdf
installed, it is asked first.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T

PARTITION_BYTES = 64 << 20
#: What opening a file costs, in bytes, when partitions are planned.
OPEN_BYTES = 256 << 10
#: A part of an archive that unpacks to more is not read.
MOST_UNPACKED = 256 << 20
#: Folders that a task remembers to have made.
MOST_FOLDERS = 1_000
#: Tasks a core to which rows are dealt whose work is far more than their bytes.
DEALT = 4

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


# -- DOCX ----------------------------------------------------------------------------------


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for node in p.iter():
        if node.tag == f"{_W}t":
            out.append(node.text or "")
        elif node.tag == f"{_W}tab":
            out.append("\t")
        elif node.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def _cells(row: ElementTree.Element) -> Iterator[str]:
    for cell in row.findall(f"{_W}tc"):
        text = "\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")).strip()
        span = cell.find(f"{_W}tcPr/{_W}gridSpan")
        yield from [text] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        info = archive.getinfo("word/document.xml")
        if info.file_size > MOST_UNPACKED:
            raise ValueError("too large")
        xml = archive.read(info)
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("entities are not read")
    body = ElementTree.fromstring(xml).find(f"{_W}body")
    lines = [_paragraph(p) for p in body.findall(f"{_W}p")]
    for table in body.findall(f"{_W}tbl"):
        for i, row in enumerate(table.findall(f"{_W}tr")):
            cells = list(_cells(row))
            lines.append("| " + " | ".join(cells) + " |")
            if i == 0:
                lines.append("|" + "---|" * len(cells))
    return "\n".join(lines)


# -- PDF -----------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
#: Strings, hex strings, numbers, names, operators, brackets.
_LEX = re.compile(rb"\((?:[^()\\]|\\.)*\)|\(|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]/%]*|[-+.\d]+|[A-Za-z'\"*]+|[\[\]]|%[^\r\n]*", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.DOTALL)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _unescaped(m: re.Match) -> bytes:
    x = m.group(1)
    if x[:1].isdigit() and x[:1] < b"8":
        return bytes([int(x, 8) & 255])
    return b"" if x.endswith(b"\n") and x != b"n" else _ESCAPED.get(x, x)


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(_unescaped, token[1:-1])


def _nested(data: bytes, at: int) -> int:
    """The end of the string that begins at `at`, which holds brackets of its own."""
    depth, i = 0, at
    while i < len(data):
        c = data[i : i + 1]
        if c == b"\\":
            i += 1
        elif c == b"(":
            depth += 1
        elif c == b")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(data)


def _shown(data: bytes) -> str:
    """The text that a content stream shows; a new line for each that it begins."""
    out, held, numbers, at, listed = [], [], [], 0, False
    line = lambda: out.append(b"\n") if out and out[-1] != b"\n" else None
    while m := _LEX.search(data, at):
        token, at = m.group(), m.end()
        if token == b"(":
            at = _nested(data, m.start())
            token = data[m.start() : at]
        if token[:1] in b"(<":
            held.append(_string(token))
        elif token in (b"[", b"]"):
            listed = token == b"["
        elif re.fullmatch(rb"[-+.\d]+", token):
            try:
                value = float(token)
            except ValueError:
                continue
            numbers.append(value)
            # A wide step back between strings of a list is a blank.
            if listed and value < -200:
                held.append(b" ")
        else:
            if token in (b"'", b'"', b"T*"):
                line()
            if token in (b"Td", b"TD") and len(numbers) > 1 and numbers[-1] != 0 or token in (b"Tm", b"BT"):
                line()
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out += held
            held, numbers = [], []
    return b"".join(out).decode("cp1252", "ignore").strip()


def _objects(content: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while m := _OBJECT.search(content, at):
        at = content.find(b"endobj", m.end())
        if at < 0:
            return
        yield int(m.group(1)), content[m.end() : at]


def _unpacked(part: bytes) -> bytes:
    head, _, data = part.partition(b"stream")
    data = data[: data.rfind(b"endstream")].removeprefix(b"\r").removeprefix(b"\n")
    if b"/FlateDecode" not in head:
        return data
    machine = zlib.decompressobj()
    try:
        return machine.decompress(data, MOST_UNPACKED)
    except zlib.error:
        return b""


def pdf_text(content: bytes) -> str:
    """The pages' texts, in the order of the page tree, with blank lines between."""
    try:
        from pypdf import PdfReader

        return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    except ImportError:
        pass
    objects = dict(_objects(content))

    def kids(n: int, seen: frozenset) -> Iterator[bytes]:
        part = objects.get(n, b"")
        head = part.split(b"stream", 1)[0]
        listed = re.search(rb"/Kids\s*\[(.*?)\]", head, re.DOTALL)
        if n in seen:
            return
        if listed is None:
            yield head
            return
        for ref in _REFERENCE.finditer(listed.group(1)):
            yield from kids(int(ref.group(1)), seen | {n})

    root = next((m for part in objects.values() if re.search(rb"/Type\s*/Catalog\b", part) and (m := re.search(rb"/Pages\s+(\d+)", part))), None)
    pages = []
    for head in kids(int(root.group(1)), frozenset()) if root else ():
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", head, re.DOTALL)
        streams = [_unpacked(objects.get(int(r.group(1)), b"")) for r in _REFERENCE.finditer(m.group(1))] if m else []
        pages.append(_shown(b"\n".join(streams)))
    return "\n\n".join(pages)


# -- the source ----------------------------------------------------------------------------


def parse(name: str, content: bytes) -> str:
    """The text of a file by its suffix; empty where it can't be parsed."""
    suffix = name.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    reader = {"docx": docx_text, "pdf": pdf_text}.get(suffix, lambda c: c.decode("utf-8", "ignore"))
    try:
        return reader(content)
    except Exception:  # whatever a broken file makes a parser raise
        return ""


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, root = _system(self.folder)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
        out, size = [[]], 0
        for path, n in found:
            inner = path[len(root) :].lstrip("/")
            if any(part.startswith(".") for part in inner.split("/")):
                continue
            if out[-1] and size + n > self.most:
                out.append([])
                size = 0
            out[-1].append((path, inner))
            size += n + OPEN_BYTES
        return [_Files(files) for files in out]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _system(self.folder)
        for path, inner in partition.files:
            with system.open_input_stream(path) as source:
                yield inner, inner, parse(inner, source.read())


class RawFolder(DataSource):
    """Files under `path` as doc_id (the path within it), source, text."""

    @classmethod
    def name(cls) -> str:
        return "raw_folder"

    def schema(self) -> str:
        return "doc_id string, source string, text string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_folder(spark: SparkSession, folder: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """doc_id, source, text of the files under folder that have any text."""
    spark.dataSource.register(RawFolder)
    rows = spark.read.format("raw_folder").option("partitionBytes", partition_bytes).load(folder)
    return rows.where(F.length(T.strip(F.col("text"))) > 0)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to a few tasks a core: rows of few bytes that become a file each lie
    in few partitions of their table, often in one."""
    return rows.repartition(DEALT * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (name, content) as files under folder, by tasks, whole under another name
    and then renamed; how many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        (system, root), made = _system(folder), set()
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                path = f"{root}/{name}"
                inner = path.rsplit("/", 1)[0]
                if inner not in made:
                    system.create_dir(inner, recursive=True)
                    made = {inner} if len(made) >= MOST_FOLDERS else made | {inner}
                part = f"{inner}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(bytes(content))
                system.move(part, path)
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


# -- simple documents ----------------------------------------------------------------------


def docx_document(paragraphs: list[str], table: list[list[str]] = ()) -> bytes:
    """A DOCX of paragraphs and a table."""
    from xml.sax.saxutils import escape

    p = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    body = "".join(map(p, paragraphs)) + (f"<w:tbl>{rows}</w:tbl>" if rows else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf_document(pages: list[list[str]], deflate: bool = True) -> bytes:
    """A PDF of pages of lines, in Latin letters."""
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    numbers = []
    for lines in pages:
        shown = [line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for line in lines]
        data = b"BT /F1 11 Tf 50 800 Td\n" + b"\n".join(b"(" + s + b") Tj 0 -14 Td" for s in shown) + b"\nET"
        data = zlib.compress(data) if deflate else data
        kind = b" /Filter /FlateDecode" if deflate else b""
        parts.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), kind, data))
        parts.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(parts))
        numbers.append(len(parts))
    parts[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(numbers), b" ".join(b"%d 0 R" % n for n in numbers))
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, p) for i, p in enumerate(parts))
    return b"%PDF-1.4\n" + body + b"trailer << /Root 1 0 R >>\n%%EOF\n"
