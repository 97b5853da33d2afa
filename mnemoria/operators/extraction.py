"""From chunks to entities and relationships: the provider's call, and parsers of its text as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoria.functions import exprs as X
from mnemoria.functions import text as N
from mnemoria.functions.providers import Extractor, retrying

JSON = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,relation:string,description:string>>"


def call(chunks: DataFrame, extractor: Extractor, limit: int = 40, tries: int = 3) -> DataFrame:
    """Chunks with ``response`` and ``error``: a chunk that fails has an error and doesn't stop the job."""
    own = chunks.select("doc_id", "chunk_index", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = retrying(extractor.extract, tries)
        for b in batches:
            said, wrong = [], []
            for text in b.column("content").to_pylist():
                try:
                    said.append(ask(text or "", limit))
                    wrong.append(None)
                except Exception as e:
                    said.append(None)
                    wrong.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(wrong, pa.string())], [*b.schema.names, "response", "error"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, chunk_index int, content string, response string, error string")


def _fields(responses: DataFrame, keep: list[str], col: str) -> DataFrame:
    lines = responses.select(*keep, F.posexplode(F.split(col, "\n")).alias("line_no", "line")).where(F.col("line").contains("$$$$"))
    strip = lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), "^[\"'()]+|[\"'()]+$", ""), "", "")
    return lines.withColumn("f", F.transform(F.split(F.trim("line"), r"\$\$\$\$"), strip)).withColumn("kind", F.lower(F.get("f", F.lit(0))))


def parse_entities(responses: DataFrame, keep: list[str], col: str = "response") -> DataFrame:
    """(keep, line_no, name, entity_type, description, aliases) of entity lines with four fields or more."""
    f = _fields(responses, keep, col).where((F.col("kind") == "entity") & (F.size("f") >= 4) & (F.get("f", F.lit(1)) != ""))
    part = lambda i: F.get("f", F.lit(i))
    return f.select(*keep, "line_no", part(1).alias("name"), part(2).alias("entity_type"), part(3).alias("description"), N.aliases(part(4)).alias("aliases"))


def parse_relationships(responses: DataFrame, keep: list[str], col: str = "response") -> DataFrame:
    """(keep, line_no, source, target, relation_type, description, valid_from, valid_until): texts of the bounds."""
    part = lambda i: F.get("f", F.lit(i))
    whole = (part(1) != "") & (part(2) != "") & (part(3) != "")
    f = _fields(responses, keep, col).where((F.col("kind") == "relationship") & (F.size("f") >= 5) & whole)
    return f.select(*keep, "line_no", part(1).alias("source"), part(2).alias("target"), part(3).alias("relation_type"), part(4).alias("description"), N.temporal(part(5)).alias("valid_from"), N.temporal(part(6)).alias("valid_until"))


def parse_plain(responses: DataFrame, keep: list[str], col: str = "response") -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of ``ENTITY: a | b | c`` and ``RELATIONSHIP: s -> r -> t | d`` lines."""
    lines = responses.select(*keep, F.explode(F.split(col, "\n")).alias("line")).withColumn("line", F.trim("line"))
    rest = lambda head: F.expr(f"substring(line, {len(head) + 1})")
    e = lines.where(F.col("line").startswith("ENTITY:")).withColumn("f", F.transform(F.split(rest("ENTITY:"), r"\|"), lambda p: F.trim(p))).where(F.get("f", F.lit(0)) != "")
    entities = e.select(*keep, F.get("f", F.lit(0)).alias("name"), F.coalesce(F.get("f", F.lit(1)), F.lit("Entity")).alias("entity_type"), F.coalesce(F.get("f", F.lit(2)), F.lit("")).alias("description"))
    r = lines.where(F.col("line").startswith("RELATIONSHIP:")).withColumn("h", F.split(rest("RELATIONSHIP:"), r"\|", 2)).withColumn("f", F.transform(F.split(F.get("h", F.lit(0)), "->"), lambda p: F.trim(p))).where(F.size("f") == 3)
    relations = r.select(*keep, F.get("f", F.lit(0)).alias("source"), F.get("f", F.lit(1)).alias("relation_type"), F.get("f", F.lit(2)).alias("target"), F.coalesce(F.trim(F.get("h", F.lit(1))), F.lit("")).alias("description"))
    return entities, relations


def parsed(responses: DataFrame, keep: list[str], col: str = "response") -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of responses in any of three forms: marked lines; else JSON; else plain lines."""
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    marked = F.col(col).contains("$$$$")
    rest = responses.where(~marked).withColumn("__j", parse_json(col))
    json = rest.where("__j is not null")
    e = json.select(*keep, F.posexplode("__j.entities").alias("line_no", "x")).where("x.name <> ''").select(*keep, "line_no", F.col("x.name").alias("name"), F.coalesce("x.type", F.lit("Entity")).alias("entity_type"), F.coalesce("x.description", F.lit("")).alias("description"), none.alias("aliases"))
    r = json.select(*keep, F.posexplode("__j.relationships").alias("line_no", "x")).where("x.source <> '' and x.target <> ''").select(*keep, "line_no", F.col("x.source").alias("source"), F.col("x.target").alias("target"), F.coalesce("x.relation", F.lit("RELATED_TO")).alias("relation_type"), F.coalesce("x.description", F.lit("")).alias("description"), text.alias("valid_from"), text.alias("valid_until"))
    pe, pr = parse_plain(rest.where("__j is null"), keep, col)
    number = F.lit(0).alias("line_no")
    entities = parse_entities(responses.where(marked), keep, col).unionByName(e).unionByName(pe.select(*keep, F.pmod(F.xxhash64("name", "entity_type"), F.lit(1_000_000)).cast("int").alias("line_no"), "name", "entity_type", "description", none.alias("aliases")))
    relations = parse_relationships(responses.where(marked), keep, col).unionByName(r).unionByName(pr.select(*keep, number, "source", "target", "relation_type", "description", text.alias("valid_from"), text.alias("valid_until")))
    return entities, relations


def parse_json(response) -> Column:
    """Struct of the entities and relationships between the first { and the last }; null if that isn't JSON."""
    return F.from_json(F.regexp_extract(X.col(response), r"(?s)\{.*\}", 0), JSON)


def parse_coreferences(responses: DataFrame, keep: list[str], col: str = "response") -> DataFrame:
    """(keep, mention, canonical, confidence); a confidence that isn't a number is 0.5."""
    f = _fields(responses, keep, col).where((F.col("kind") == "coreference") & (F.size("f") >= 3))
    return f.select(*keep, F.get("f", F.lit(1)).alias("mention"), F.get("f", F.lit(2)).alias("canonical"), F.coalesce(F.get("f", F.lit(3)).try_cast("double"), F.lit(0.5)).alias("confidence"))


def fact_order(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, entity, priority): the greatest number of a numbered line that names an entity."""
    lines = docs.select(key, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?m)^\d+[.\s:]+.+$"), 0)).alias("line"))
    named = lines.select(key, F.regexp_extract("line", r"^(\d+)", 1).cast("long").alias("n"), F.explode(F.regexp_extract_all(F.regexp_extract("line", r"^\d+[.\s:]+(.+)$", 1), F.lit(N.CAPITALISED), 1)).alias("e"))
    own = named.where((F.length("e") > 2) & ~F.lower("e").isin("the", "and", "for"))
    return own.groupBy(key, F.lower("e").alias("entity")).agg(F.max("n").alias("priority"))


def fact_priority(edges: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Edges (key, source, target) with the priority of the facts that name their target, else their source, else 0.

    Names match if either holds the other; facts and edges meet on the document first, so the
    comparison stays within one.
    """
    side = lambda end: F.lower(end).contains(F.col("entity")) | F.col("entity").contains(F.lower(end))
    rows = edges.withColumn("__row", F.xxhash64(*[F.col(c) for c in edges.columns]))
    met = rows.join(order.withColumnRenamed("priority", "__p"), key).groupBy(key, "__row").agg(F.max(F.when(side("target"), F.col("__p"))).alias("__t"), F.max(F.when(side("source"), F.col("__p"))).alias("__s"))
    out = rows.join(met, [key, "__row"], "left")
    return out.withColumn("priority", F.coalesce(F.when(F.col("__t") > 0, F.col("__t")), F.col("__s"), F.lit(0))).drop("__row", "__t", "__s")
