"""Document sources: files of several formats as (path, text, error)."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def text_of(data: bytes) -> str:
    return data.decode("utf-8")


def csv_text(data: bytes) -> str:
    """Fields of a record joined by a space, records by a line end; the head is a record."""
    return "\n".join(" ".join(row) for row in csv.reader(io.StringIO(data.decode("utf-8"), newline="")))


def json_text(data: bytes) -> str:
    """A string as it is, a list's items and a mapping's "key: value" as lines; nested values
    as Python writes them."""
    value = json.loads(data.decode("utf-8"))
    if isinstance(value, list):
        return "\n".join(map(str, value))
    if isinstance(value, dict):
        return "\n".join(f"{k}: {v}" for k, v in value.items())
    return str(value)


def docx_text(data: bytes) -> str:
    """Paragraphs that are not blank, then each table row's cells joined by " | "."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = [words(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        cells = ["\n".join(words(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
        out.append(" | ".join(c for c in cells if c))
    return "\n".join(line for line in out if line.strip())


def pdf_text(data: bytes, separator: str = "\n") -> str:
    """Pages joined by ``separator``; needs a parser library that is not part of this package."""
    try:
        import fitz
    except ImportError as e:
        raise NotImplementedError("no PDF parser is installed; register one with Loader.register") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        return separator.join(page.get_text() for page in doc)


def pdf_or_text(data: bytes) -> str:
    """Pages laid end to end; what no installed parser takes is read as UTF-8 without its errors."""
    try:
        return pdf_text(data, "")
    except Exception:  # noqa: BLE001  no parser, or no PDF
        return data.decode("utf-8", "ignore")


class Loader:
    """Readers by lower-cased suffix; others can be registered."""

    def __init__(self) -> None:
        self.readers: dict[str, Callable[[bytes], str]] = {".txt": text_of, ".md": text_of, ".csv": csv_text, ".json": json_text, ".pdf": pdf_text, ".docx": docx_text, ".doc": docx_text}

    def register(self, suffix: str, reader: Callable[[bytes], str]) -> None:
        self.readers[suffix.lower()] = reader

    def reader_of(self, path: str) -> Callable[[bytes], str]:
        dot = path.rfind(".")
        suffix = path[dot:].lower() if dot > path.rfind("/") else ""
        if suffix not in self.readers:
            raise ValueError(f"unsupported format {suffix or path!r}")
        return self.readers[suffix]

    def load(self, spark: SparkSession, path: str) -> str:
        """The text of one file. A missing file raises FileNotFoundError, a format without
        a reader ValueError."""
        reader = self.reader_of(path)
        try:
            rows = spark.read.format("binaryFile").load(path).select("content").head(1)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                raise FileNotFoundError(path) from e
            raise
        return reader(bytes(rows[0][0]))

    def read(self, spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
        """(path, text, error) of the files below ``path`` that a reader takes; a file that
        fails has no text and says why."""
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
        known = F.regexp_extract(F.lower("path"), r"\.[^./]+$", 0).isin(*self.readers)
        loader = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for path, content in zip(pdf["path"], pdf["content"], strict=True):
                    try:
                        out.append((path, loader.reader_of(path)(bytes(content)), None))
                    except Exception as e:  # one bad file must not end the load; its reason is kept
                        out.append((path, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["path", "text", "error"])

        return files.filter(known).select("path", "content").mapInPandas(run, "path string, text string, error string")

    def directory(self, spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
        """(path, text) of the files that could be read."""
        return self.read(spark, path, pattern, recursive).filter("error IS NULL").select("path", "text")


def flatten_results(spark: SparkSession, path: str) -> DataFrame:
    """(term, definition, field) of result files {results: [{terms: [{term, definition, metadata}]}]}."""
    schema = "results array<struct<terms: array<struct<term: string, definition: string, metadata: struct<field: string>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    term = rows.select(F.explode("results").alias("r")).select(F.explode("r.terms").alias("t"))
    return term.select("t.term", "t.definition", F.col("t.metadata.field").alias("field"))


def sentence_index(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_id, text): the sentences an index keeps."""
    return docs.select("doc_id", F.posexplode(T.index_sentences(F.col("text"))).alias("sentence_id", "text"))


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
