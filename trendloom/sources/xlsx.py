"""Spreadsheet files by the standard library: read and written on the executors, in ranges of rows, as files of a sheet each.

A workbook is a ZIP of XML parts.  Read are the first sheet's cells of shared and
inline strings, numbers and booleans; all values are texts, as the papers' tables
want them, and empty cells null.  Dates are the numbers that the file holds.

A large sheet may be read by several tasks: each cuts the sheet's XML at the ends
of rows, which is quick, and parses only the blocks of rows that are its own.
"""

from __future__ import annotations

import functools
import io
import itertools
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence, Set
from typing import IO, NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import text as X
from trendloom.scratch import written
from trendloom.sources import tables

# The names that the format uses, a sheet's rows and a cell's characters at most.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet").get(REL)
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == first:
            target = r.get("Target")
            return target[1:] if target.startswith("/") else f"xl/{target}"
    raise ValueError("a workbook without a sheet")


class _Shared:
    """The strings that cells share; read when the first cell asks for one."""

    def __init__(self, book: zipfile.ZipFile) -> None:
        self.book, self.known = book, None

    def __getitem__(self, k: int) -> str:
        if self.known is None:
            items = ElementTree.fromstring(self.book.read("xl/sharedStrings.xml"))
            self.known = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in items]
        return self.known[k]


def _cells(row: ElementTree.Element, shared: _Shared, wanted: Set[int] | None) -> list[str | None]:
    """A row's texts, of the wanted columns only; the others are null."""
    out: list[str | None] = []
    for k, cell in enumerate(row.findall(f"{MAIN}c")):
        at = column_number(cell.get("r")) if cell.get("r") else k
        if wanted is not None and at not in wanted:
            continue
        out += [None] * (at + 1 - len(out))
        kind, value = cell.get("t"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            out[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        elif value is not None and value.text is not None:
            out[at] = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}[value.text] if kind == "b" else value.text
    return out


BLOCK = 2000  # ends of rows that lie between two cuts


def _blocks(part: IO[bytes]) -> Iterator[tuple[int, bytes]]:
    """Number and XML of each block of a sheet's rows, whole rows each, with the sheet's own tag around them."""
    held, size, head, number = b"", 1 << 20, b"", 0
    while chunk := part.read(size):
        held += chunk
        if not head:
            m = re.search(rb"<(?:worksheet)\b[^>]*>", held)
            start = re.search(rb"<sheetData\b[^>]*>", held)
            if not m or not start:
                if len(held) > 64 * size:
                    raise ElementTree.ParseError("no rows of the usual form")
                continue
            head, held = m[0], held[start.end() :]
        ends = [m.end() for m in re.finditer(b"</row>", held)]
        at = 0
        for k in range(BLOCK - 1, len(ends), BLOCK):
            yield number, head + held[at : ends[k]] + b"</worksheet>"
            at, number = ends[k], number + 1
        held = held[at:]
    last = re.search(rb"</sheetData>|<sheetData\b[^>]*/>", held)
    rest = held[: last.start()] if last else held
    if head and rest.strip():
        yield number, head + rest + b"</worksheet>"


def _parsed_rows(book: zipfile.ZipFile, k: int, ranges: int) -> Iterator[tuple[bool, ElementTree.Element]]:
    """Rows of the first block and of this range's own blocks, and whether they are the range's own; by a full parse where tags have prefixes."""
    name = _first_sheet(book)
    with book.open(name) as part:
        plain = b"<worksheet" in part.read(1 << 16)
    with book.open(name) as part:
        if plain:
            for number, block in _blocks(part):
                own = number % ranges == k
                if own or number == 0:
                    for row in ElementTree.fromstring(block).iter(f"{MAIN}row"):
                        yield own, row
        else:
            for n, (_, row) in enumerate(x for x in ElementTree.iterparse(part) if x[1].tag == f"{MAIN}row"):
                yield n // BLOCK % ranges == k, row
                row.clear()


def sheet_rows(content: bytes, columns: Sequence[str] | None = None, k: int = 0, ranges: int = 1) -> Iterator[list[str | None]]:
    """The names, then the rows of the first sheet that the range k of so many has; rows that the file leaves out are left out.

    With ``columns`` only cells under these names are read, and rows have them in
    that order, null where a name is absent.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, names, places = _Shared(book), None, None
        for own, row in _parsed_rows(book, k, ranges):
            if names is None:
                names = _cells(row, shared, None)
                if columns is not None:
                    texts = [str(x) for x in names]
                    places = [texts.index(c) if c in texts else None for c in columns]
                yield names
            elif own:
                out = _cells(row, shared, None if places is None else {p for p in places if p is not None})
                yield out if places is None else [out[p] if p is not None and p < len(out) else None for p in places]


def read(spark: SparkSession, path: str, columns: Sequence[str], skip_bad: bool = False, ranges: int = 1) -> DataFrame:
    """``parsed`` of the workbooks at path, a file, a folder or a pattern; with ``ranges`` each is read by so many tasks."""
    parts = [parsed(spark.read.format("binaryFile").load(path), columns, skip_bad, k, ranges) for k in range(ranges)]
    return functools.reduce(DataFrame.unionByName, parts)


def parsed(files: DataFrame, columns: Sequence[str], skip_bad: bool = False, k: int = 0, ranges: int = 1) -> DataFrame:
    """The stated columns, as texts, of workbooks in the column ``content``; absent ones are null.

    The first row holds the names.  Cells of other columns are not read.  A file
    that is no workbook ends the job, or with skip_bad gives no rows.
    """
    wanted = list(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                try:
                    rows = sheet_rows(content, wanted, k, ranges)
                    next(rows, [])
                    while some := list(itertools.islice(rows, 5000)):
                        yield pd.DataFrame(some, columns=wanted, dtype=object)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    if not skip_bad:
                        raise

    return files.select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in wanted))


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, rows, bad, error of each workbook at path; the rows are counted on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = sheet_rows(content)
                    next(rows, [])
                    out.append((name, sum(1 for _ in rows), 0, None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((name, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "rows", "bad", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, rows long, bad long, error string")


class Piece(NamedTuple):
    """Compressed bytes that may be joined with others, and what a checksum of the whole needs to know of them."""

    content: bytes
    crc: int
    length: int
    rows: int


def _piece(text: str, rows: int = 0, last: bool = False) -> Piece:
    raw = text.encode()
    press = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    # Ended at a whole byte with nothing to look back to, pieces follow one another as one stream.
    return Piece(press.compress(raw) + press.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH), zlib.crc32(raw), len(raw), rows)


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of the checksum; the highest bit is the constant term."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a, b = a << 1 & 0xFFFFFFFF, b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts one after another, the second of so many bytes, from the CRC-32 of each."""
    shift, byte = 0x80000000, 0x00800000
    while length:
        if length & 1:
            shift = _times(shift, byte)
        byte, length = _times(byte, byte), length >> 1
    return _times(shift, first) ^ second


def _archive(entries: Iterable[tuple[str, Iterable[Piece]]]) -> Iterator[bytes]:
    """A ZIP file of the entries, whose pieces are taken one by one; nothing but sums is kept of them."""
    at, count, directory = 0, 0, b""
    for name, pieces in entries:
        # Sizes and checksum follow the data; a fixed date keeps equal tables equal files.
        fixed, label = (20, 0x808, 8, 0, 0x21), name.encode()
        head = struct.pack("<4s5H3L2H", b"PK\3\4", *fixed, 0, 0, 0, len(label), 0) + label
        yield head
        crc = length = size = 0
        for p in pieces:
            crc, length, size = joined_crc(crc, p.crc, p.length), length + p.length, size + len(p.content)
            if max(length, size, at) >= 1 << 32:
                raise ValueError("a sheet of 4 GB or more")
            yield p.content
        yield struct.pack("<4s3L", b"PK\7\x08", crc, size, length)
        directory += struct.pack("<4s6H3L5H2L", b"PK\1\2", 20, *fixed, crc, size, length, len(label), 0, 0, 0, 0, 0, at) + label
        at, count = at + len(head) + size + 16, count + 1
    yield directory + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, count, count, len(directory), at, 0)


def _line(values: Sequence[str | None]) -> str:
    """A row; its cells are told by their order, so that no row needs its number."""
    cells = ("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in values)
    return f"<row>{''.join(cells)}</row>"


def _book(names: Sequence[str], rows: Iterable[Piece]) -> Iterator[bytes]:
    """A workbook of one sheet with the names and the rows of the pieces."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    office = REL[1 : REL.index("}")]
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    sheet = itertools.chain([_piece(f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{_line(names)}')], rows, [_piece("</sheetData></worksheet>", last=True)])
    return _archive([*((name, [_piece(head + text, last=True)]) for name, text in parts.items()), ("xl/worksheets/sheet1.xml", sheet)])


ROWS = 5000  # that are compressed together


def _pieces(rows: Iterable[Sequence[str | None]]) -> Iterator[Piece]:
    for some in itertools.batched(rows, ROWS):
        yield _piece("".join(map(_line, some)), len(some))


def workbook(names: Sequence[str], rows: Iterable[Sequence[str | None]]) -> bytes:
    """A workbook of one sheet of texts."""
    return b"".join(_book(names, _pieces(rows)))


def _cells_of(df: DataFrame) -> DataFrame:
    """All columns as texts that a cell may hold: without control characters, cut at what a cell holds."""
    return df.select(*[X.sanitise(F.col(f"`{c}`").cast("string"), MOST_CHARS).alias(c) for c in df.columns])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, ...]]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def workbooks(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """part, number, rows, content: df as workbooks of at most so many rows, each made whole by the task that has its rows.

    No rows, no workbook.  ``parsed`` reads the column ``content``.
    """
    if not 0 < most_rows < MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS} rows at most, its names among them")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows_of(batches)
        for number in itertools.count():
            pieces = list(_pieces(itertools.islice(rows, most_rows)))
            if not pieces:
                return
            yield pa.RecordBatch.from_pydict({"number": [number], "rows": [sum(p.rows for p in pieces)], "content": [b"".join(_book(names, pieces))]})

    return _cells_of(df).mapInArrow(run, "number long, rows long, content binary").select(F.spark_partition_id().alias("part"), "number", "rows", "content")


def write(df: DataFrame, path: str) -> None:
    """One workbook at path, a file of any store, in the order of df; its rows must fit a sheet.

    The tasks make and compress the XML of their rows; the pieces, a table in the
    shared folder, are then joined one after another as they stand, without being
    unpacked, and the file replaces a former one in one step.  Control characters
    are removed and texts cut at what a cell holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, p in enumerate(_pieces(_rows_of(batches))):
            yield pa.RecordBatch.from_pydict({"number": [number], **{k: [v] for k, v in p._asdict().items()}})

    spark = df.sparkSession
    made = _cells_of(df).mapInArrow(run, "number long, content binary, crc long, length long, rows long")
    made = written(made.select(F.spark_partition_id().alias("part"), "number", "content", "crc", "length", "rows"), "sheet")
    if (made.agg(F.sum("rows")).first()[0] or 0) >= MOST_ROWS:
        raise ValueError(f"a sheet holds {MOST_ROWS} rows at most, its names among them")
    ordered = made.orderBy("part", "number").select("content", "crc", "length", "rows").toLocalIterator()
    tables.replaced(spark, path, _book(df.columns, (Piece(bytes(r.content), r.crc, r.length, r.rows) for r in ordered)))
