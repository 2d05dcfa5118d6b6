"""Word files and formulas as tables: bytes in, Markdown, counts and errors out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import mtef, parsers


def word_documents(files: DataFrame) -> DataFrame:
    """(path, markdown, counts, error) of Word files (path, content). A file that can't be read, or isn't safe to unpack, has an error and no text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    text, counts = parsers.docx_markdown(bytes(content))
                    rows.append((path, text, {k: int(v) for k, v in counts.items()}, None))
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, AttributeError, TypeError) as e:
                    rows.append((path, None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "counts", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, markdown string, counts map<string, long>, error string")


def unsafe_members(files: DataFrame) -> DataFrame:
    """(path, member, size, packed, problem) of the members of archives (path, content) that break a limit; an archive of too many members, or too large, has one row with member null."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    infos = zipfile.ZipFile(io.BytesIO(bytes(content))).infolist()
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, "no archive"))
                    continue
                if len(infos) > parsers.MEMBERS:
                    rows.append((path, None, len(infos), None, "too many members"))
                if (total := sum(i.file_size for i in infos)) > parsers.TOTAL_SIZE:
                    rows.append((path, None, total, None, "too large"))
                for i in infos:
                    if i.file_size > parsers.MEMBER_SIZE:
                        rows.append((path, i.filename, i.file_size, i.compress_size, "member too large"))
                    elif i.file_size > 10 << 20 and i.file_size > parsers.RATIO * max(1, i.compress_size):
                        rows.append((path, i.filename, i.file_size, i.compress_size, "packed too tightly"))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "packed", "problem"])

    return files.select("path", "content").mapInPandas(look, "path string, member string, size long, packed long, problem string")


def _omml(xml: pd.Series) -> pd.DataFrame:
    rows = []
    for text in xml:
        try:
            f = parsers.WordFormula()
            rows.append((f.latex(ElementTree.fromstring(text)), list(f.unsupported), None))
        except (ElementTree.ParseError, TypeError) as e:
            rows.append((None, [], str(e)))
    return pd.DataFrame(rows, columns=["latex", "unsupported", "error"])


def office_formula(xml: str | Column) -> Column:
    """(latex, unsupported, error) of an Office formula given as XML."""
    return F.pandas_udf(_omml, "latex string, unsupported array<string>, error string")(xml)


def _equations(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mtef.latex(bytes(x)) if x is not None else ("", "no equation") for x in data], columns=["latex", "warning"])


def equation(data: str | Column) -> Column:
    """(latex, warning) of the bytes of an equation object; '' and a warning where they can't be read."""
    return F.pandas_udf(_equations, "latex string, warning string")(data)
