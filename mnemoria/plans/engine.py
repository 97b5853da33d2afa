"""The memory engine: ingest, query, evolve and rehydrate over tenant tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoria.conf import EngineConfig
from mnemoria.errors import IngestionError, QueryError
from mnemoria.functions import exprs as X
from mnemoria.functions.providers import Answerer, Embedder, ExtractiveAnswerer, Extractor, HashingEmbedder, RuleExtractor
from mnemoria.operators import graph, retrieve, scoring
from mnemoria.operators.lineage import cut
from mnemoria.plans import evolve as evolution
from mnemoria.plans import ingest as ingestion
from mnemoria.sources import documents as sources
from mnemoria.sources.store import ParquetStore

MODES = ("semantic", "exact", "graph_traversal")


@dataclass
class Response:
    question: str
    answer: str
    confidence: float
    context: str
    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame
    truncated: bool = False
    sources: list[str] = field(default_factory=list)

    @property
    def has_results(self) -> bool:
        return not self.nodes.isEmpty()


class MemoryEngine:
    """One tenant's memory in a store that may hold many."""

    def __init__(self, spark: SparkSession, path: str, conf: EngineConfig | None = None, extractor: Extractor | None = None, embedder: Embedder | None = None, answerer: Answerer | None = None, coreferences: Extractor | None = None):
        self.spark, self.conf = spark, (conf or EngineConfig()).validate()
        self.store = ParquetStore(spark, path)
        self.extractor, self.embedder, self.answerer = extractor or RuleExtractor(), embedder or HashingEmbedder(), answerer or ExtractiveAnswerer()
        self.coreferences = coreferences

    @property
    def tenant(self) -> tuple[str, str]:
        return self.conf.user_id, self.conf.memory_id

    @staticmethod
    def _at(as_of: dt.datetime | None):
        return F.lit(as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp")

    def ingest(self, docs: DataFrame, as_of: dt.datetime | None = None, id_col: str = "doc_id", text_col: str = "text", communities: bool = True) -> dict[str, int]:
        """Documents of any number become part of the graph; counts of documents, chunks that failed, nodes and edges."""
        at = self._at(as_of)
        nodes, edges, failed = ingestion.graph_of(docs, self.extractor, self.embedder, self.conf, at, id_col, text_col, self.coreferences)
        self.store.upsert("nodes", ingestion.merge_known(nodes, self.store.load("nodes", *self.tenant)))
        self.store.upsert("edges", edges)
        if communities:
            self.detect_communities()
        return {"documents": docs.where(X.valid_text(text_col)).count(), "failed_chunks": failed.count(), "nodes": nodes.count(), "edges": edges.count()}

    def ingest_files(self, path: str, modality: str | None = None, as_of: dt.datetime | None = None, **readers) -> dict[str, int]:
        """Files under a path or pattern; each is read as its extension says, or as ``modality``.  readers: modality=function of bytes."""
        return self.ingest(sources.routed_files(self.spark, path, modality, readers), as_of)

    def ingest_url(self, url: str, fetch: Callable[[str], str], as_of: dt.datetime | None = None) -> dict[str, int]:
        """The main text of a web page; ``fetch`` gets its HTML."""
        if not sources.valid_url(url):
            raise IngestionError(f"not a web address: {url}", url=url)
        text, title, _ = sources.page_text(fetch(url))
        return self.ingest_text("\n".join(x for x in (title, text) if x), url, as_of)

    def nodes(self) -> DataFrame:
        """The tenant's nodes with the accesses logged since they were written."""
        log = scoring.fold_accesses(self.store.load("accesses", *self.tenant), ["id"]).select("id", F.col("access_count").alias("__n"), F.col("accessed_at").alias("__t"))
        out = self.store.load("nodes", *self.tenant).join(log, "id", "left")
        return out.withColumns({"access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)), "accessed_at": F.greatest("accessed_at", "__t")}).drop("__n", "__t")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes = self.nodes()
        return nodes, graph.within_nodes(self.store.load("edges", *self.tenant), nodes)

    def ingest_text(self, text: str, doc_id: str = "text", as_of: dt.datetime | None = None) -> dict[str, int]:
        return self.ingest(self.spark.createDataFrame([(doc_id, text)], "doc_id string, text string"), as_of)

    def detect_communities(self, live_only: bool = True) -> None:
        """All clusters of the tenant are replaced; archived and deleted nodes and edges are left out."""
        nodes, edges = self.store.load_graph(*self.tenant)
        if live_only:
            nodes, edges = nodes.where("state not in ('ARCHIVED', 'DELETED')"), edges.where(X.live_edge())
        c = self.conf
        members = cut(graph.communities(nodes, edges, c.community_algorithm, c.min_cluster_size, c.max_cluster_size))
        found = graph.clusters(members, nodes, edges, c.community_algorithm)
        self.store.replace("clusters", found.withColumns({"user_id": F.lit(c.user_id), "memory_id": F.lit(c.memory_id)}), self.tenant)

    def search(self, question: str, k: int | None = None, least: float | None = None, filters: dict | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """(id, similarity, boost, score) of the nodes that answer best."""
        nodes = self.nodes().withColumn("hours", 24 * X.days_between(self._at(as_of), F.col("accessed_at")))
        vector = self.embedder.embed([question])[0] or [0.0] * self.embedder.dimensions
        return retrieve.hybrid_search(nodes, question, vector, self.conf.top_k if k is None else k, self.conf.min_similarity if least is None else least, filters)

    def query(self, question: str, mode: str = "semantic", k: int | None = None, least: float | None = None, filters: dict | None = None, as_of: dt.datetime | None = None, hops: int | None = None, record: bool = True) -> Response:
        """Named and similar nodes, what they are linked with, and an answer from a context that fits.

        With ``as_of``, only edges that hold then count.  The nodes found are appended to the access log unless ``record``
        is off; no stored node is written by a query.
        """
        if mode not in MODES:
            raise QueryError(f"no query mode {mode!r}", mode=mode)
        nodes, edges = self.graph()
        if as_of is not None:
            edges = edges.where(X.valid_at(self._at(as_of)))
        asked = self.spark.createDataFrame([(0, question)], "question_id int, question string")
        exact = cut(retrieve.exact_matches(nodes, asked))
        named = not exact.isEmpty()
        semantic = self.search(question, k, least, filters, as_of) if mode == "semantic" else None
        fused = exact.withColumn("score", F.lit(1.0)) if semantic is None else retrieve.fuse(exact, semantic.select(F.lit(0).alias("question_id"), "id", "score"))
        fused = cut(fused)
        steps = (6 if named else 2) if hops is None else hops
        if mode != "exact":
            reached = graph.expand(fused.select("id"), edges, steps, nodes)
            touched = graph.expanded_edges(edges, reached, steps)
            more = reached.where("hop > 0").select(F.lit(0).alias("question_id"), "id", F.lit(0.5).alias("score"))
            fused = cut(fused.unionByName(more))
        else:
            touched = graph.within_nodes(edges.where(X.live_edge()), fused)
        found = cut(nodes.join(fused.select("id", "score"), "id"))
        touched = cut(touched)
        clusters = graph.relevant_clusters(self.store.load("clusters", *self.tenant), found)
        context, cut_off, sources = self.context(found, touched, clusters)
        if not context:
            return Response(question, "No relevant information found.", 0.0, "", found, touched, clusters)
        answer, sure = self.answerer.answer(question, context)
        if record and not found.isEmpty():
            self.store.append("accesses", found.select("user_id", "memory_id", "id", self._at(as_of).alias("ts")))
        return Response(question, answer, sure, context, found, touched, clusters, cut_off, sources)

    def query_communities(self, question: str, as_of: dt.datetime | None = None, k: int | None = None) -> tuple[str, float]:
        """An answer put together from those of the communities that hold the nodes found, each from its summary."""
        nodes, _ = self.graph()
        asked = self.spark.createDataFrame([(0, question)], "question_id int, question string")
        found = retrieve.fuse(retrieve.exact_matches(nodes, asked), self.search(question, k, as_of=as_of).select(F.lit(0).alias("question_id"), "id", "score"))
        clusters = graph.relevant_clusters(self.store.load("clusters", *self.tenant), nodes.join(found.select("id"), "id", "left_semi")).where("summary <> ''")
        answers = retrieve.community_answers(clusters, question, self.answerer)
        row = retrieve.aggregate_answers(answers).first()
        return (row["answer"], row["confidence"]) if row else ("No relevant information found.", 0.0)

    def context(self, nodes: DataFrame, edges: DataFrame, clusters: DataFrame, priority: str = "balanced") -> tuple[str, bool, list[str]]:
        """(text, whether an item was left out, node names): sections within the token budget, in their order of weight."""
        name = nodes.select("id", "name")
        a, b = name.select(F.col("id").alias("source_id"), F.col("name").alias("__a")), name.select(F.col("id").alias("target_id"), F.col("name").alias("__b"))
        rel = edges.join(a, "source_id", "left").join(b, "target_id", "left").withColumns({"source_id": F.coalesce("__a", "source_id"), "target_id": F.coalesce("__b", "target_id")})
        kinds = {
            "communities": clusters.select(F.concat(F.lit("• "), "summary").alias("line"), F.col("importance").alias("o"), F.col("cluster_id").cast("string").alias("k")),
            "entities": nodes.select(retrieve.entity_line().alias("line"), F.col("importance").alias("o"), F.col("id").alias("k")),
            "relationships": rel.select(F.concat(retrieve.relation_line(), retrieve.validity()).alias("line"), (F.col("weight") * F.col("confidence")).alias("o"), F.col("id").alias("k")),
            "documents": nodes.select(F.explode("source_chunks").alias("c"), "importance").groupBy("c").agg(F.max("importance").alias("o")).select(F.substring("c", 1, 500).alias("line"), "o", F.col("c").alias("k")),
        }
        counts = {s: d.count() for s, d in kinds.items()}
        shares = retrieve.budgets(self.conf.context_tokens, counts, priority)
        parts, left_out = [], False
        for s, share in shares.items():
            if not share:
                continue
            rows = retrieve.pack(kinds[s].withColumn("__all", F.lit(0)), share, ["__all"], [F.desc("o"), "k"], ending=2 if s == "documents" else 1).orderBy("tokens", F.desc("o"), "k").collect()
            left_out |= len(rows) < counts[s]
            if rows:
                parts.append(f"## {s.title()}\n" + "\n".join(r["line"] for r in rows))
        names = [r[0] for r in nodes.orderBy(F.desc("score"), "id").select("name").limit(10).collect()] if "score" in nodes.columns else []
        return "\n\n".join(parts), left_out, names

    def evolve(self, as_of: dt.datetime | None = None, force: bool = False, **switches) -> DataFrame | None:
        """Events of one evolution; None if the last was less than the least interval ago."""
        at = self._at(as_of)
        if not force:
            last = self.store.load("events", *self.tenant).agg(F.max("ts").alias("t")).select((24 * X.days_between(at, F.col("t"))).alias("h")).first()[0]
            if last is not None and last < self.conf.min_evolve_hours:
                return None
        log = cut(self.store.load("accesses", *self.tenant))
        out = evolution.evolve(*self.graph(), at, self.conf, **switches)
        events = cut(out.events.withColumns({"user_id": F.lit(self.conf.user_id), "memory_id": F.lit(self.conf.memory_id)}))
        nodes, edges = cut(out.nodes), cut(out.edges)  # both read what is replaced
        self.store.replace("nodes", nodes, self.tenant)
        self.store.replace("edges", edges, self.tenant)
        since = self.store.load("accesses", *self.tenant).join(log.select("id", "ts").distinct(), ["id", "ts"], "left_anti")
        self.store.replace("accesses", since, self.tenant)  # what the new nodes count already goes
        self.store.append("events", events)
        return events

    def rehydrate(self, question: str, most: int | None = None, as_of: dt.datetime | None = None) -> int:
        """Archived nodes near a question come back, with their edges; how many did."""
        nodes, edges = self.store.load_graph(*self.tenant)
        vector = self.embedder.embed([question])[0] or [0.0] * self.embedder.dimensions
        back = cut(scoring.rehydrate(nodes, vector, self.conf.rehydrate_similarity, most or self.conf.rehydrate_max))
        if back.isEmpty():
            return 0
        at = self._at(as_of)
        links = cut(scoring.rehydrate_edges(edges, back).withColumn("updated_at", at))  # before the nodes it reads are replaced
        self.store.upsert("nodes", back.drop("score", "restored").withColumn("updated_at", at))
        if not links.isEmpty():
            self.store.upsert("edges", links)
        return back.where("restored").count()

    def stats(self) -> dict[str, int]:
        return self.store.stats(*self.tenant)

    def clear(self) -> None:
        self.store.clear(*self.tenant)

    def export(self) -> DataFrame:
        """(kind, json) of every node and edge."""
        nodes, edges = self.store.load_graph(*self.tenant)
        row = lambda d, kind: d.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("json"))
        return row(nodes, "node").unionByName(row(edges, "edge"))
