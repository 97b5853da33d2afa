"""Documents from files and web pages, and JSON and rows as text."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DROPPED = ("script", "style", "nav", "footer", "header", "aside", "advertisement")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
URL = re.compile(r"^https?://[^\s/$.?#][^\s]*$", re.I)


class _Page(HTMLParser):
    """Text pieces with the open containers that may be the main content."""

    def __init__(self, dropped: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.stack, self.pieces, self.title, self.description = dropped, [], [], None, None
        self.found: dict[str, int] = {}  # kind of container -> number of its first one
        self.opened = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or "").lower() == "description":
            self.description = a.get("content")
        if tag in VOID:
            return
        classes = (a.get("class") or "").split()
        kinds = [k for k, hit in (("main", tag == "main"), ("article", tag == "article"), ("content", tag == "div" and "content" in classes), ("post", tag == "div" and "post" in classes), ("body", tag == "body")) if hit]
        self.opened += 1
        for k in kinds:
            self.found.setdefault(k, self.opened)
        self.stack.append((tag, self.opened))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        tags = {t for t, _ in self.stack}
        if "title" in tags and self.title is None:
            self.title = data.strip() or None
        if not tags & set(self.dropped) and (text := data.strip()):
            self.pieces.append((text, [n for _, n in self.stack]))


def page_text(html: str | None, dropped: tuple[str, ...] = DROPPED, order: tuple[str, ...] = ("main", "article", "content", "post", "body")) -> tuple[str, str | None, str | None]:
    """(text, title, description) of a page: that of its main container, a piece a line."""
    page = _Page(dropped)
    page.feed(html or "")
    page.close()
    root = next((page.found[k] for k in order if k in page.found), None)
    text = "\n".join(t for t, open_ in page.pieces if root is None or root in open_)
    return re.sub(r"\n{3,}", "\n\n", text).strip(), page.title, page.description


def pages_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """(page_id, url, text, title, description) of web pages; null pages have an empty text."""
    own = pages.select(F.col(id_col).alias("page_id"), (F.col(url_col) if url_col else F.lit(None).cast("string")).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, title, about = zip(*map(page_text, b.column("html").to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *(pa.array(c, pa.string()) for c in (text, title, about))], ["page_id", "url", "text", "title", "description"])

    return own.mapInArrow(run, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string, title string, description string")


def valid_url(url: str | Column) -> bool | Column:
    return bool(URL.match(url)) if isinstance(url, str) else url.rlike("(?i)" + URL.pattern)


def json_text(value, depth: int = 0) -> str:
    """``key: value`` and ``[i]: value`` lines, two blanks deeper at each level."""
    if isinstance(value, dict):
        return "\n".join(f"{'  ' * depth}{k}: {json_text(v, depth + 1)}" for k, v in value.items())
    if isinstance(value, list):
        return "\n".join(f"{'  ' * depth}[{i}]: {json_text(v, depth + 1)}" for i, v in enumerate(value)) if value else "[]"
    return str(value)


def json_documents(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, text) of JSON documents; what isn't JSON is its own text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(json_col).alias("raw"))

    def flat(raw: str | None) -> str | None:
        if raw is None:
            return None
        try:
            return json_text(json.loads(raw))
        except ValueError:
            return raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(map(flat, b.column("raw").to_pylist())), pa.string())], ["id", "text"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, text string")


def flat_json(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, key, value) of the top-level keys of JSON objects, inside the JVM."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.from_json(json_col, "map<string,string>")).alias("key", "value"))


def row_text(columns: list[str], number: Column) -> Column:
    """``Row i: name: value, ...`` of a row; empty values are left out."""
    parts = [F.when(F.length(F.col(f"`{c}`").cast("string")) > 0, F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in columns]
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), F.concat_ws(", ", *parts))


def read_files(spark: SparkSession, path: str, modality: str = "text") -> DataFrame:
    """(doc_id, text, modality, metadata) of files, whole; the path is the id.

    All are decoded as UTF-8, as they stand; ``routed_files`` reads each by its kind.
    """
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return raw.select(F.col("path").alias("doc_id"), text.alias("text"), F.lit(modality).alias("modality"), F.create_map(F.lit("source_file"), F.col("path"), F.lit("source_type"), F.lit(modality)).alias("metadata"))


def read_with(files: DataFrame, reader: Callable[[bytes], str], id_col: str = "path") -> DataFrame:
    """(doc_id, text, error) of binary files (content) by a plug-in reader; a failure is a row, not the job's end."""
    own = files.select(F.col(id_col).alias("doc_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for data in b.column("content").to_pylist():
                try:
                    texts.append(reader(data))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["doc_id", "text", "error"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string, error string")


EXTENSIONS = {
    **dict.fromkeys(("md", "markdown"), "markdown"), **dict.fromkeys(("htm", "html"), "webpage"), "json": "json", "csv": "csv", "tsv": "csv", "pdf": "pdf",
    **dict.fromkeys(("png", "jpg", "jpeg", "gif", "webp"), "image"), **dict.fromkeys(("mp3", "wav", "m4a", "ogg"), "audio"),
    **dict.fromkeys("py js ts java go rs c cpp h rb php scala sql sh".split(), "code"),
}


def modality_of(path: str) -> str:
    """A file's kind by its extension; text where that says nothing."""
    return EXTENSIONS.get(path.rpartition(".")[2].lower(), "text")


def csv_text(text: str, delimiter: str = ",") -> str:
    """``Row i: name: value, ...`` lines of CSV with a header; empty values are left out."""
    rows = csv.DictReader(io.StringIO(text), delimiter=delimiter)
    return "\n".join(f"Row {i}: " + ", ".join(f"{k}: {v}" for k, v in r.items() if k is not None and v) for i, r in enumerate(rows, 1))


def as_text(data: bytes, kind: str, path: str = "") -> str:
    """What a file of a kind says; kinds without a reader are refused."""
    if kind in ("pdf", "image", "audio"):
        raise ValueError(f"{kind} files need a reader")
    text = data.decode("utf-8", "replace")
    if kind == "csv":
        return csv_text(text, "\t" if path.lower().endswith(".tsv") else ",")
    if kind == "json":
        try:
            return json_text(json.loads(text))
        except ValueError:
            return text
    return page_text(text)[0] if kind == "webpage" else text


def routed_files(spark: SparkSession, path: str, modality: str | None = None, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(doc_id, text, modality, error) of files, each by the reader of its kind; a failure is a row."""
    own = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")
    named = dict(readers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, data in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist()):
                kind = modality or modality_of(name)
                try:
                    out.append((name, named[kind](data) if kind in named else as_text(data, kind, name), kind, None))
                except Exception as e:
                    out.append((name, None, kind, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else ((),) * 4)], ["doc_id", "text", "modality", "error"])

    return own.mapInArrow(run, "doc_id string, text string, modality string, error string")
