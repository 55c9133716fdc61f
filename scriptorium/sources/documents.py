"""Uploaded documents: the texts of text files and of word-processor files (DOCX), as rows."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.shipping import ship

# Extensions that are read, and the length of a text in UTF-16 units.
EXTENSIONS = (".txt", ".docx")
#: Files that are read at once.
AT_ONCE = 64
LENGTH = 20_000
#: Bytes that the text part of a word-processor file may have once unpacked.
MOST_UNPACKED = 256_000_000
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY = "word/document.xml"
LEFT_OUT = tuple(WORD + tag for tag in ("del", "moveFrom", "pPr", "rPr"))  # deleted text, and properties
#: White space that does not count at the ends of a text.
BLANK = "\t\n\x0b\x0c\r \xa0                　﻿"
FOUND = "path string, text string, chars int, truncated boolean, error string"


def word_text(content: bytes) -> str:
    """The text of a word-processor file: each paragraph followed by an empty line, tabs as tabs, deleted text left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if z.getinfo(BODY).file_size > MOST_UNPACKED:
            raise ValueError("too large")
        out: list[str] = []
        deleted = 0
        with z.open(BODY) as body:
            for event, e in ET.iterparse(body, ("start", "end")):
                if e.tag in LEFT_OUT:
                    deleted += 1 if event == "start" else -1
                elif event == "start" or deleted:
                    continue
                elif e.tag == WORD + "t":
                    out.append(e.text or "")
                elif e.tag == WORD + "tab":
                    out.append("\t")
                elif e.tag == WORD + "p":
                    out.append("\n\n")
                    e.clear()
    return "".join(out)


def cleaned(text: str, length: int = LENGTH) -> tuple[str, int, bool]:
    """The text with line ends and runs of empty lines made one, without outer white space, cut to length; its length, and whether it was cut."""
    text = re.sub("\n{3,}", "\n\n", text.replace("\r\n", "\n")).strip(BLANK)
    units = text.encode("utf-16-le", "surrogatepass")
    cut = units[: 2 * length]
    return cut.decode("utf-16-le", "replace"), len(cut) // 2, len(units) > len(cut)


def extracted(files: DataFrame, length: int = LENGTH) -> DataFrame:
    """path, text, chars, truncated and error of files (path, content).

    Of another extension than EXTENSIONS: error unsupported. A word-processor file that is damaged, protected, without a body or too large
    when unpacked: error unreadable. Both have no text. Bytes of a text file that are no UTF-8 become replacement characters; a null
    content is an empty file. Files are read where they lie, AT_ONCE at a time.
    """
    ship(files.sparkSession)

    def read(path: str | None, content: bytes | None) -> tuple:
        kind = (path or "").lower()
        kind = kind[kind.rfind(".") :] if "." in kind else kind
        if kind not in EXTENSIONS:
            return path, None, None, None, "unsupported"
        try:
            raw = word_text(content or b"") if kind == ".docx" else (content or b"").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, RuntimeError, NotImplementedError, OSError, EOFError, zipfile.zlib.error):
            return path, None, None, None, "unreadable"
        return path, *cleaned(raw, length), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
        for some in (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, batch.num_rows, AT_ONCE)):
            rows = [read(*row) for row in zip(*(c.to_pylist() for c in some.columns), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "text", "chars", "truncated", "error"])

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, FOUND)


def read_uploads(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """extracted() over all files below a folder; Spark's reader passes over files without a byte."""
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"), length)


def word_file(paragraphs: list[str]) -> bytes:
    """A word-processor file of plain paragraphs; characters that XML cannot hold are left out."""
    root = ET.Element(WORD + "document")
    body = ET.SubElement(root, WORD + "body")
    for p in paragraphs:
        run = ET.SubElement(ET.SubElement(body, WORD + "p"), WORD + "r")
        ET.SubElement(run, WORD + "t").text = re.sub("[^\t\n\r -퟿-�\U00010000-\U0010ffff]", "", p)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(BODY), ET.tostring(root, encoding="utf-8", xml_declaration=True))
    return out.getvalue()
