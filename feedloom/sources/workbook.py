"""Workbook corpora: every sheet of every .xlsx file as rows of cells.

One file is one row of the listing, so files are spread over tasks; a file
itself is bounded by the size guard. Only the small reader below runs in Python.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.sources.files import MAX_FILE_BYTES, split_by_size

CELL_SCHEMA = "path string, sheet string, row_index bigint, cells map<string,string>, error string"

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
ROWS_PER_BATCH = 2000


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_MAIN + "t"))


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group(0):
        number = number * 26 + ord(letter) - 64
    return number - 1


class _Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        book = self._tree("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        self.sheets = [
            (s.get("name"), targets[s.get(_LINK)]) for s in book.find(_MAIN + "sheets")
        ]
        flags = book.find(_MAIN + "workbookPr")
        self.epoch = datetime(1904, 1, 1) if flags is not None and flags.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        names = self.zip.namelist()
        shared = "xl/sharedStrings.xml"
        self.strings = [_text(s) for s in self._tree(shared)] if shared in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else set()

    def _tree(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _date_styles(self) -> set[int]:
        styles = self._tree("xl/styles.xml")
        custom = set()
        for fmt in styles.iter(_MAIN + "numFmt"):
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt.get("formatCode", "")).lower()
            if re.search(r"[ymdhs]", code):
                custom.add(int(fmt.get("numFmtId")))
        formats = styles.find(_MAIN + "cellXfs")
        ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
        return {i for i, n in enumerate(ids) if n in DATE_FORMATS or n in custom}

    def _value(self, cell) -> str | None:
        kind, raw = cell.get("t"), cell.findtext(_MAIN + "v")
        if kind == "inlineStr":
            return _text(cell)
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind in ("str", "d"):
            return raw
        if int(cell.get("s", 0)) in self.dates:
            return (self.epoch + timedelta(seconds=round(float(raw) * 86400))).isoformat()
        return raw[:-2] if raw.endswith(".0") else raw

    def rows(self, target: str) -> Iterator[dict[int, str | None]]:
        name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with self.zip.open(name) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != _MAIN + "row":
                    continue
                yield {
                    _column_number(c.get("r")) if c.get("r") else i: self._value(c)
                    for i, c in enumerate(node.iter(_MAIN + "c"))
                }
                node.clear()


def _sheet_rows(path: str, content: bytes, wanted: str | None) -> Iterator[tuple]:
    book = _Workbook(content)
    names = [n for n, _ in book.sheets]
    target = wanted if wanted is not None else names[0]
    if wanted == "*":
        chosen = book.sheets
    elif target in names:
        chosen = [s for s in book.sheets if s[0] == target]
    else:
        raise ValueError(f"sheet {target!r} not found; available sheets: {', '.join(names)}")
    for sheet, part in chosen:
        header: dict[int, str] = {}
        index = 0
        for row in book.rows(part):
            if not header:
                header = {i: v if v not in (None, "") else f"Unnamed: {i}" for i, v in row.items()}
                continue
            yield path, sheet, index, {h: row.get(i) for i, h in header.items()}, None
            index += 1


def read_workbooks(files: DataFrame, sheet: str | None = None, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, sheet, row_index, cells, error) from a listing of .xlsx files.

    ``sheet`` names a sheet, ``"*"`` means all, None the first. The first row is
    the header. A file that cannot be read, or is above the size limit, yields
    one row with its error.
    """
    accepted, rejected = split_by_size(files, limit)
    too_large = rejected.select(
        "path", F.lit(None).cast("string").alias("sheet"), F.lit(-1).cast("int").alias("row_index"),
        F.lit(None).cast("map<string,string>").alias("cells"),
        F.format_string(f"%d bytes are over the limit of {limit}", "length").alias("error"),
    )
    columns = ["path", "sheet", "row_index", "cells", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                try:
                    for row in _sheet_rows(path, content, sheet):
                        rows.append(row)
                        if len(rows) == ROWS_PER_BATCH:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except Exception as problem:  # noqa: BLE001 - one bad file must not stop the corpus
                    rows.append((path, None, -1, None, str(problem)))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    cells = accepted.select("path", "content").mapInPandas(read, CELL_SCHEMA)
    return cells.unionByName(too_large.select(*[F.col(f.name).cast(f.dataType) for f in cells.schema.fields]))


def sheet_table(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed columns (name -> Spark type) out of the cell maps."""
    good = cells.where(F.col("error").isNull())
    picked = [F.try_element_at("cells", F.lit(n)).try_cast(t).alias(n) for n, t in columns.items()]
    return good.select("path", "sheet", "row_index", *picked)
