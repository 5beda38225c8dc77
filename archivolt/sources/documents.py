"""Text of files as the scan gives them (binaryFile): docx is zipped XML; native and scanned text go by a chain of sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def archive(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content", "length")


def _sections(content: bytes) -> list[tuple[str, int, str]]:
    """(title, level, text) of a docx: sections begin at heading styles, table rows are lines of cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out, title, level, lines = [], "Introduction", 1, []
    for node in body:
        text = "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
        style = node.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        if node.tag == f"{_W}tbl":
            lines += [" | ".join("".join(t.text or "" for t in c.iter(f"{_W}t")).strip() for c in row.findall(f"{_W}tc")) for row in node.findall(f"{_W}tr")]
        elif name.lower().startswith("heading"):
            if lines:
                out.append((title, level, "\n".join(lines)))
            digits = "".join(c for c in name if c.isdigit())
            title, level, lines = text, int(digits or 1), []
        elif text:
            lines.append(text)
    return out + ([(title, level, "\n".join(lines))] if lines else [])


def docx_sections(files: DataFrame) -> DataFrame:
    """(path, section_no, title, level, content, error) of docx files; a file that can't be read has one row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "section_no", "title", "level", "content", "error"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        for x in batches:
            rows = []
            for path, content in zip(x.column("path").to_pylist(), x.column("content").to_pylist(), strict=True):
                try:
                    rows += [(path, i, *s, None) for i, s in enumerate(_sections(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError, AttributeError) as e:
                    rows.append((path, 0, None, None, None, type(e).__name__))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, "path string, section_no int, title string, level int, content string, error string")


def plain_text(files: DataFrame) -> DataFrame:
    """(path, content): files as UTF-8, characters that aren't replaced, trimmed."""
    return files.select("path", F.trim(F.decode("content", "UTF-8")).alias("content"))


def first_good(*texts: Column, least: int = 20, otherwise: str = "[no text]") -> Column:
    """The first of several texts (cached, native, recognised, described) with at least so many characters, else a placeholder."""
    return F.coalesce(*[F.when(F.length(F.trim(t)) >= least, t) for t in texts], F.lit(otherwise))
