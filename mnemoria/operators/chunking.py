"""Chunkers: text, Markdown, code and fixed windows, as expressions where they can be and Arrow batches else."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, HEADER = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+(?=[A-Z])"), re.compile(r"^(#{1,6})\s+", re.M)
SYMBOLS = {
    "python": re.compile(r"^(?:def|class|async def)\s+\w+", re.M),
    "javascript": re.compile(r"^(?:function|class|const|let|var)\s+\w+", re.M),
    "typescript": re.compile(r"^(?:function|class|const|let|interface|type)\s+\w+", re.M),
}
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript"}
Chunk = tuple[str, int, int, dict]  # content, start, end, metadata


def fixed(docs: DataFrame, size: int = 2000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, content): windows of ``size`` characters, ``size - overlap`` apart.  Null texts have none."""
    t = F.col(text_col)
    n = F.length(t)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    rows = docs.where(t.isNotNull()).select(F.col(id_col).alias("doc_id"), t.alias("text"), F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select("doc_id", "chunk_index", F.substring("text", F.col("start") + 1, F.lit(size)).alias("content"))


def pack_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Sentences packed greedily; blanks between don't count; trailing sentences under ``overlap`` begin the next chunk."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if total + len(s) > size:
            if held:
                out.append(" ".join(held))
            keep, kept = [], 0
            for x in reversed(held):
                if kept + len(x) >= overlap:
                    break
                keep.insert(0, x)
                kept += len(x)
            held, total = [*keep, s], kept + len(s)
        else:
            held.append(s)
            total += len(s)
    if held:
        out.append(" ".join(held))
    return out or [text]


def overlap_tail(text: str, overlap: int) -> str:
    """The last characters, from the first sentence or word that begins among them."""
    if len(text) <= overlap:
        return text
    tail = text[-overlap:] if overlap else ""
    if m := re.search(r"[.!?]\s+", tail):
        return tail[m.end() :]
    at = tail.find(" ")
    return tail[at + 1 :] if at > 0 else tail


def pack_units(units: list[str], size: int, overlap: int) -> Iterator[Chunk]:
    held, start = "", 0
    for unit in (u.strip() for u in units):
        if not unit:
            continue
        if held and len(held) + len(unit) + 1 > size:
            yield held.strip(), start, start + len(held), {}
            tail = overlap_tail(held, overlap)
            start += len(held) - len(tail)
            held = f"{tail} {unit}" if tail else unit
        else:
            held = f"{held} {unit}" if held else unit
    if held.strip():
        yield held.strip(), start, start + len(held), {}


def by_characters(text: str, size: int, overlap: int, least: int) -> Iterator[Chunk]:
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for i in range(end, max(start + least, end - 200), -1):
                if text[i - 1] in ".!?" and text[i].isspace():
                    end = i
                    break
        if part := text[start:end].strip():
            yield part, start, end, {}
        start = max(end - overlap, start + 1) if end < len(text) else end


def chunk_text(text: str | None, size: int = 1000, overlap: int = 200, least: int = 100) -> list[Chunk]:
    """Paragraphs if there are several, else sentences, else characters."""
    if not text or not text.strip():
        return []
    for pattern in (PARAGRAPH, SENTENCE):
        units = pattern.split(text)
        if len(units) > 1:
            return list(pack_units(units, size, overlap))
    return list(by_characters(text, size, overlap, least))


def chunk_markdown(text: str | None, size: int = 1000, overlap: int = 200, least: int = 100) -> list[Chunk]:
    """Sections by headers, with their level; long ones are chunked as text."""
    text = text or ""
    heads = list(HEADER.finditer(text))
    if not heads:
        return chunk_text(text, size, overlap, least)
    bounds = [(0, heads[0].start(), 0), *((h.end(), n.start() if n else len(text), len(h[1])) for h, n in zip(heads, [*heads[1:], None]))]
    out: list[Chunk] = []
    for a, b, depth in bounds:
        section, meta = text[a:b], {"header_level": str(depth)} if depth else {}
        if not section.strip():
            continue
        if len(section) > size:
            out += [(c, a + s, a + e, meta) for c, s, e, _ in chunk_text(section, size, overlap, least)]
        else:
            out.append((section.strip(), a, b, meta))
    return out


def chunk_code(code: str | None, language: str = "python", size: int = 1000, overlap: int = 200, least: int = 100) -> list[Chunk]:
    """Functions and classes with their symbol; what stands before the first is dropped, as is code without a symbol's pattern chunked as text."""
    code = code or ""
    found = list(SYMBOLS[language].finditer(code)) if language in SYMBOLS else []
    if not found:
        return chunk_text(code, size, overlap, least)
    ends = [m.start() for m in found[1:]] + [len(code)]
    return [(code[m.start() : e].strip(), m.start(), e, {"language": language, "symbol": m.group().strip()}) for m, e in zip(found, ends) if code[m.start() : e].strip()]


def language_of(path: str | None) -> str:
    return LANGUAGES.get((path or "").rpartition(".")[2].lower(), "python")


def chunked(docs: DataFrame, fn: Callable[[str | None], list[Chunk]], modality: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, content, start_char, end_char, modality, metadata) by a chunker, in Arrow batches."""
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *c[:3], modality, list(c[3].items())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, c in enumerate(fn(t))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "chunk_index", "content", "start_char", "end_char", "modality", "metadata"])

    from mnemoria.schema import CHUNKS

    return own.mapInArrow(run, CHUNKS)


def sentences(docs: DataFrame, size: int = 2048, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks for extraction: whole sentences, packed greedily."""

    def pack(text: str | None) -> list[Chunk]:
        return [(c, None, None, {}) for c in pack_sentences(text, size, overlap)] if text is not None else []

    return chunked(docs, pack, "text", id_col, text_col)


def split_numbered(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, content) of a text cut at a pattern (``Document \\d+:``, ``Dialogue \\d+:``, ``\\d+\\.``); blank parts are left out."""
    parts = F.filter(F.transform(F.split(F.col(text_col), pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("part", "content")).withColumn("part", F.col("part") + 1)


def facts_with_priority(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, priority, content) of numbered facts: the number is the priority."""
    lines = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?m)^\d+[.\s:]+.+$"), 0))
    rows = docs.select(F.col(id_col).alias("doc_id"), lines.alias("line"))
    return rows.select("doc_id", F.regexp_extract("line", r"^(\d+)", 1).cast("long").alias("priority"), F.trim(F.regexp_extract("line", r"^\d+[.\s:]+(.+)$", 1)).alias("content"))


def long_text(text: str | None, size: int = 5000) -> list[Chunk]:
    """Chapters if there are five or more, else paragraphs packed to ``size``, else windows."""
    text = text or ""
    heads = [m.start() for m in re.finditer(r"(?:Chapter|CHAPTER|Ch\.?)\s*\d+", text)]
    if len(heads) > 1:
        bounds = sorted({0, *heads, len(text)})
        parts = [(text[a:b].strip(), a, b, {}) for a, b in zip(bounds, bounds[1:]) if text[a:b].strip()]
        if len(parts) >= 5:
            return parts
    out: list[Chunk] = []
    for content, a, b, _ in pack_units(PARAGRAPH.split(text), size, 0):
        out += [(content[i : i + size], a + i, min(a + i + size, b), {}) for i in range(0, len(content), size)]
    return out
