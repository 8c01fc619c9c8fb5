"""Spreadsheet workbooks (.xlsx) as sensor tables: a file a row of a scan, its sheet read as a stream of cells.

Spark's binaryFile source fetches the files, so they may lie in any store that Spark reads; tasks unpack them. What a task
holds is one packed file, its shared strings, and a batch of rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Day 0 of serial dates, in workbooks that count from 1900 and from 1904. Fixed values.
EPOCHS = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}
BATCH = 20_000


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element) -> str:
    """The text of a string item: its runs one after another, without phonetic hints."""
    return "".join(t.text or "" for part in element for t in ([part] if _tag(part) == "t" else part if _tag(part) == "r" else []) if _tag(t) == "t")


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, e in iterparse(book.open("xl/sharedStrings.xml")):
        if _tag(e) == "si":
            out.append(_text(e))
            e.clear()
    return out


def _sheet(book: zipfile.ZipFile, name: str | None) -> tuple[str, bool]:
    """The path of a sheet, by default the first, and whether dates count from 1904."""
    sheets, from_1904 = {}, False
    for _, e in iterparse(book.open("xl/workbook.xml")):
        if _tag(e) == "workbookPr":
            from_1904 = e.get("date1904") in ("1", "true")
        elif _tag(e) == "sheet":
            sheets[e.get("name")] = next(v for k, v in e.attrib.items() if k.endswith("}id"))
    if name is not None and name not in sheets:
        raise ValueError(f"there is no sheet {name}, only {', '.join(sheets)}")
    links = {e.get("Id"): e.get("Target") for _, e in iterparse(book.open("xl/_rels/workbook.xml.rels")) if _tag(e) == "Relationship"}
    target = links[sheets[name] if name is not None else next(iter(sheets.values()))]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", from_1904


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def cells(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts, as long as each row is; empty cells are None. First comes the epoch's row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, from_1904 = _sheet(book, sheet)
        strings = _strings(book)
        yield ["1904" if from_1904 else "1900"]
        rows = None
        for event, e in iterparse(book.open(path), events=("start", "end")):
            if event == "start" and _tag(e) == "sheetData":
                rows = e
            if event == "end" and _tag(e) == "row":
                out: list[str | None] = []
                for at, c in enumerate(x for x in e if _tag(x) == "c"):
                    place = _column(c.get("r")) if c.get("r") else max(at, len(out))
                    out += [None] * (place + 1 - len(out))
                    value = next((v.text for v in c if _tag(v) == "v"), None)
                    kind = c.get("t", "n")
                    if kind == "s" and value is not None:
                        value = strings[int(value)]
                    elif kind == "inlineStr":
                        value = next((_text(v) for v in c if _tag(v) == "is"), None)
                    out[place] = None if kind == "e" else value
                yield out
                rows.clear()  # rows that were read are let go


def _time(value: str | None, fmt: str, from_1904: bool) -> datetime | None:
    """A serial number or a text in the format; anything else is an error."""
    if value is None:
        return None
    if re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", value):
        return EPOCHS[from_1904] + timedelta(seconds=round(float(value) * 86400))
    return datetime.strptime(value, fmt)


def read_sensor_sheet(spark: SparkSession, path: str, columns: dict[str, str], fmt: str = "%Y-%m-%d %H:%M:%S", sheet: str | None = None, series_id: str = "all") -> DataFrame:
    """The workbooks at a path as one sensor table: series_id, row_id, ts, the other columns as doubles, day.

    columns gives the header's name for each of ours, ts among them; a header that lacks one is an error. Times are serial
    numbers or texts in the format; a bad one is an error. Numbers that are empty, errors or NaN become NULL; a text that
    is no number is an error. Rows without a time and without numbers are left out. row_id orders the rows of a
    file as they stand in it, and files by their paths' hashes.
    """
    names = [n for n in columns if n != "ts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = cells(content, sheet)
                from_1904, header = next(rows) == ["1904"], next(rows, [])
                if missing := [v for v in columns.values() if v not in header]:
                    raise ValueError(f"the header has no {', '.join(missing)}")
                at = {n: header.index(v) for n, v in columns.items()}
                held: list[list] = []
                for i, row in enumerate(rows):
                    own = {n: row[k] if k < len(row) else None for n, k in at.items()}
                    if any(v not in (None, "") for v in own.values()):
                        numbers = [None if own[n] in (None, "") else float(own[n]) for n in names]
                        held.append([file + i, _time(own["ts"], fmt, from_1904), *[None if v != v else v for v in numbers]])
                    if len(held) == BATCH:
                        yield _batch(held, names)
                        held = []
                if held:
                    yield _batch(held, names)

    place = F.shiftleft(F.pmod(F.xxhash64("path"), F.lit(1 << 31)), 32)
    files = spark.read.format("binaryFile").load(path).select(place.alias("file"), "content")
    rows = files.mapInArrow(run, ", ".join(["row_id long", "ts timestamp_ntz", *[f"`{n}` double" for n in names]]))
    return rows.select(F.lit(series_id).alias("series_id"), "*", F.to_date("ts").alias("day"))


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.timestamp("us"), *[pa.float64()] * len(names)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row_id", "ts", *names])
