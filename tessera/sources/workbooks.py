"""Workbooks and office documents: zip archives of XML, read a file to a task by their own parts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = re.compile(r"\{[^}]*\}")


def _name(tag: str) -> str:
    return _NS.sub("", tag)


def _texts(node: ElementTree.Element) -> str:
    return "".join(e.text or "" for e in node.iter() if _name(e.tag) == "t")


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, number of the row, cells) of an xlsx workbook; empty sheets have no rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = set(z.namelist())
        shared = [_texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in files else []
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for sheet in (e for e in book.iter() if _name(e.tag) == "sheet"):
            link = next(v for k, v in sheet.attrib.items() if _name(k) == "id")
            target = links[link].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for n, row in enumerate((e for e in root.iter() if _name(e.tag) == "row"), 1):
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v = next((e.text for e in c if _name(e.tag) == "v"), None)
                    cells[at] = _texts(c) if c.get("t") == "inlineStr" else shared[int(v)] if c.get("t") == "s" and v else v
                yield sheet.get("name"), int(row.get("r") or n), cells


def paragraphs(data: bytes) -> Iterator[str]:
    """Paragraphs of a docx document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for p in ElementTree.fromstring(z.read("word/document.xml")).iter():
            if _name(p.tag) == "p":
                yield _texts(p)


ROWS = "path string, part string, row_no int, cells array<string>, error string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``path, part, row_no, cells, error`` of all workbooks, documents and texts under *path*.

    A workbook gives a row for each row of each sheet, a document for each paragraph, a text for
    each line. What cannot be read, and kinds that are not known, give one row with the error;
    files without a byte give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                try:
                    if kind in ("xlsx", "xlsm"):
                        out = [(name, s, n, c, None) for s, n, c in sheets(bytes(data))]
                    elif kind == "docx":
                        out = [(name, "", n, [p], None) for n, p in enumerate(paragraphs(bytes(data)), 1)]
                    elif kind in ("txt", "md", "csv", "json", "html", "yaml", "yml"):
                        out = [(name, "", n, [t], None) for n, t in enumerate(bytes(data).decode("utf-8", "replace").split("\n"), 1)]
                    else:
                        out = [(name, None, None, None, f"unknown kind {kind}")]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, IndexError, ValueError) as e:
                    out = [(name, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=["path", "part", "row_no", "cells", "error"]).astype({"row_no": "Int32"})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, ROWS)
