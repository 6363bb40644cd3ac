"""A project's index behind one object: a method for each data operation of the tools."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import embed_text, mentioned_path
from .functions.vectors import EmbeddingBackend, LocalBackend, VectorBackend
from .operators import feedback, graph, imports, indexing, memory, packing, postings, scoring
from .plans.materialize import counted, materialized, temporary
from .schemas import CONTEXT_STATE
from .sources.embedding_service import Service, new_vectors, with_vectors
from .sources.files import listed_files, path_aliases, read_files, source_files
from .sources.store import Store

MOST_LINES = 10_000


class Project:
    """The index of a source tree. Indexing and rebuilding the graph are separate steps; without edges no file has dependents."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, clock=lambda: int(time.time()), service: Service | None = None, ranked: bool = False):
        """service embeds chunks, notes and queries; without one embeddings are local. ranked: indexing keeps postings too, for rank."""
        self.spark, self.root, self.clock, self.service, self.ranked = spark, root.rstrip("/"), clock, service, ranked
        self.store = Store(spark, store or f"{self.root}/.marlstone")

    # indexing

    def index(self, git_times: DataFrame | None = None, prune_deleted: bool = False) -> dict:
        """Chunks of new and changed files replace the old; only these are read and written. git_times: path, git_updated_at."""
        with temporary(self.spark):
            listed = materialized(listed_files(self.spark, self.root))
            meta = self.store.read("file_meta")
            gone = meta.select("path").join(listed, "path", "left_anti") if prune_deleted else None
            made = self._replace(read_files(self.spark, self.root, indexing.changed_files(listed, meta)), git_times, gone)
            return {"files": listed.count(), "chunks": made}

    def index_file(self, path: str) -> int:
        """One file again, changed or not; its git time is forgotten."""
        self.store.read("file_meta")
        return self._replace(read_files(self.spark, self.root, self.spark.createDataFrame([(path,)], "path string")), None)

    def _replace(self, changed: DataFrame, git_times: DataFrame | None, gone: DataFrame | None = None) -> int:
        """Chunks and times of changed files (path, mtime, content) take the place of those of changed and gone files (path), in one change; how many chunks.

        Nothing is written if there are no such files. The store must not have changed since its file_meta was read.
        """
        for name in ("postings", "lengths") if self.ranked else ():
            self.store.read(name)
        with temporary(self.spark):
            changed, n = counted(changed)
            keys = changed.select("path")
            if gone is not None:
                gone, more = counted(gone)
                keys, n = keys.union(gone), n + more
            if not n:
                return 0
            rows, made = counted(self._embedded(indexing.chunk_rows(changed, self.clock(), self.store.next_seq("chunks"))))
            files = keys.select(F.col("path").alias("file_path"))
            parts = {"chunks": (rows, files), "file_meta": (indexing.file_rows(changed, git_times), keys)}
            if self.ranked:
                parts |= {"postings": (postings.postings(rows, "file_path", "id"), files), "lengths": (postings.with_lengths(rows), files)}
            self.store.replace(parts)
            return made

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        """chunks with embeddings of the service, if there is one: of texts that it has had from what is kept. What it fails to embed is null."""
        if not self.service:
            return chunks
        text = embed_text(F.col("name"), F.col("kind"), F.col("content"))
        chunks = materialized(chunks.drop("embedding"))
        new = new_vectors(chunks.select(text.alias("text")), self.store.read("vectors"), self.service)
        if not new.where("embedding is not null").isEmpty():
            self.store.append("vectors", new.where("embedding is not null"))
        return with_vectors(chunks, text, self.store.read("vectors"), self.service).withColumn("sign", F.lit(None).cast("int"))

    def _backend(self, query: str) -> EmbeddingBackend:
        """Compares notes with a query."""
        return VectorBackend(self.service.embed([query])[0]) if self.service else LocalBackend(query)

    def rebuild_graph(self, js_to_ts: bool = False) -> int:
        """Edges between the indexed files; how many files there are."""
        paths = self.store.keys("chunks").select(F.col("file_path").alias("path"))
        with temporary(self.spark):
            files = materialized(source_files(self.spark, self.root).join(paths, "path", "left_semi"))
            self.store.overwrite("graph_edges", imports.build_edges(files, self.root, path_aliases(self.spark, self.root), js_to_ts))
        return paths.count()

    # retrieval

    def context_file(self) -> str | None:
        row = self.store.read("context_state").first()
        return row["file"] if row else None

    def set_context(self, file: str) -> str:
        self.store.overwrite("context_state", self.spark.createDataFrame([(file,)], CONTEXT_STATE))
        return f"Context set to: {file}"

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        """Of local embeddings reads the sign, not the 256 numbers."""
        chunks = self.store.read("chunks")
        backend = self._backend(query) if self.service else LocalBackend(query, sign="sign")
        return scoring.search_context(chunks if self.service else chunks.drop("embedding"), query, self.clock(), top_k, meta=self.store.read("file_meta"), log=self.store.read("query_log"), edges=self.store.read("graph_edges"), context_file=self.context_file(), backend=backend)

    def rank(self, query: str, top_k: int = 10) -> DataFrame:
        """The top_k of all chunks by BM25, ties by id; reads postings of the query's terms, lengths, and the chunks that it gives. Of a ranked project."""
        found = postings.bm25_scores(self.store.read("postings"), self.store.read("lengths"), query).orderBy(F.desc("bm25"), "id").limit(top_k).collect()  # top_k rows
        chunks = self.store.read("chunks").where(F.col("id").isin([r["id"] for r in found]))
        scores = self.spark.createDataFrame(found, "id string, bm25 double")
        return chunks.join(F.broadcast(scores), "id").select("id", "file_path", "kind", "name", "start_line", "end_line", "content", "bm25")

    def search_context(self, query: str, top_k: int = 10, density: str = "balanced", exclude: list[str] | None = None, token_budget: int | None = None) -> str:
        """The rendered context. A path that the query mentions becomes the context file if there is none."""
        named = self.spark.range(1).select(mentioned_path(F.lit(query)).alias("x")).first()["x"]
        if named and not self.context_file():
            self.set_context(named)
        with temporary(self.spark):
            packed = packing.compressed(self.search(query, top_k), density, exclude, token_budget)
            return packing.search_report(packed, query, len(exclude or [])).first()["text"]

    def start_task(self, task: str, density: str = "balanced", token_budget: int | None = None) -> str:
        with temporary(self.spark):
            notes = self._recalled(task, 3)
            packed = packing.compressed(self.search(task, 8), density, None, token_budget)
            return packing.task_report(notes, packed, task).first()["text"]

    def expand_chunk(self, chunk_id: str, query: str | None = None) -> str:
        row = feedback.expand_report(self.store.read("chunks"), chunk_id).first()
        if row is None:
            return f"Chunk not found: {chunk_id}"
        digest = self.spark.range(1).select(F.substring(F.sha2(F.lit(query if query is not None else chunk_id), 256), 1, 16).alias("x")).first()["x"]
        self.store.append("query_log", feedback.expand_event(self.spark, digest, chunk_id, self.clock()))
        return row["text"]

    # memory

    def save_learning(self, content: str, tags: list[str] | None = None) -> str:
        own = str(uuid.uuid4())
        row = memory.new_memory(self.spark, own, content, tags or [], self.clock(), self.store.next_seq("memories"))
        if self.service:
            row = row.withColumn("embedding", F.array(*map(F.lit, self.service.embed([content])[0])).cast("array<double>"))
        self.store.append("memories", row)
        return own

    def _recalled(self, topic: str, top_k: int) -> DataFrame:
        """The memories that a topic recalls, which are marked as seen."""
        memories = self.store.read("memories")
        found = materialized(memory.recall(memories, self._backend(topic), top_k).drop("embedding"))
        if not found.isEmpty():
            self.store.write("memories", memory.touched(memories, found.select("id"), self.clock()))
        return found

    def recall(self, topic: str, top_k: int = 5) -> str:
        with temporary(self.spark):
            return memory.recall_report(self._recalled(topic, top_k)).first()["text"]

    def list_memories(self) -> DataFrame:
        return memory.newest_first(self.store.read("memories"))

    def delete_memory(self, memory_id: str) -> bool:
        memories = self.store.read("memories")
        found = not memories.where(F.col("id") == memory_id).isEmpty()
        if found:
            self.store.write("memories", memory.deleted(memories, memory_id))
        return found

    def audit_memories(self) -> str:
        memories = self.store.read("memories")
        with temporary(self.spark):
            audited = materialized(memory.audit(memories, self.store.read("chunks")))
            if not audited.where("marked").isEmpty():
                self.store.write("memories", memory.after_audit(memories, audited))
            return memory.audit_report(audited).first()["text"]

    def save_checkpoint(self, summary: str, open_tasks: list[str] | None = None) -> str:
        own = str(uuid.uuid4())
        self.store.append("checkpoints", memory.new_checkpoint(self.spark, own, summary, open_tasks or [], self.clock(), self.store.next_seq("checkpoints")))
        return own

    def latest_checkpoint(self):
        return memory.latest_checkpoint(self.store.read("checkpoints")).first()

    def list_checkpoints(self) -> DataFrame:
        return memory.checkpoint_list(self.store.read("checkpoints"))

    def get_checkpoint(self) -> str:
        row = memory.checkpoint_report(memory.latest_checkpoint(self.store.read("checkpoints"))).first()
        return row["text"] if row else "No checkpoints saved yet."

    # graph

    def impact_lines(self, file: str, max_depth: int = 5, heading: str = "Impact of") -> DataFrame:
        """part, depth, line of the report, for any number of dependents."""
        return graph.impact_report(self.store.read("graph_edges"), file, max_depth, heading)

    def analyze_impact(self, file: str, max_depth: int = 5, heading: str = "Impact of") -> str:
        """The report as a text, of MOST_LINES lines at most."""
        with temporary(self.spark):
            lines = self.impact_lines(file, max_depth, heading).orderBy("part", "depth", "line").limit(MOST_LINES + 1).collect()
        more = ["(more lines: see impact_lines)"] if len(lines) > MOST_LINES else []
        return "\n".join([r["line"] for r in lines[:MOST_LINES]] + more)

    def safe_to_change(self, file: str) -> str:
        with temporary(self.spark):
            return graph.change_report(self.store.read("graph_edges"), file).first()["report"]

    def status(self) -> dict:
        t = self.store.read
        known = {"chunks": self.store.keys("chunks"), "files": self.store.keys("file_meta")}
        rows = indexing.stats(t("chunks"), t("memories"), t("file_meta"), t("graph_edges"), t("checkpoints"), t("query_log"), known).collect()
        return {r["name"]: r["n"] for r in rows} | {"current_file": self.context_file()}

