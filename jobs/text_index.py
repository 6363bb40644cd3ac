"""Keeps a search index of texts up to date: chunks, and the postings of their terms, of the documents that have arrived.

    python -m jobs.text_index --documents FOLDER --out FOLDER [--config FILE]

Documents (doc_id, text, source) are Parquet files; each run takes the files that no run has taken. The high-water mark is the stream's
checkpoint (OUT/checkpoint). A batch of files writes its own partitions of OUT/chunks (by batch) and OUT/postings (by slot, a digit of
a hash of the term, and batch) and nothing else, so what a run costs grows with what is new, and a batch that is repeated after a failure writes the same partitions
again. A document that comes again replaces what it was in earlier batches: `index` gives what holds now.

Of rows of one batch with one doc_id the longest text stays (of texts of equal length the greatest). Rows without a doc_id can't be replaced and are left out; a null text is
empty. A text is cut into chunks like a file whose name ends in the setting `suffix`.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import embed_text
from marlstone.functions.vectors import local_sign
from marlstone.operators import chunking, indexing, postings

CONFIG = Path(__file__).with_suffix(".json")
DOCUMENTS = "doc_id long, text string, source string"
CHUNKS = "chunk_id string, doc_id long, source string, kind string, name string, start_line int, end_line int, content string, sign int, tokens int, length int, batch long"
POSTINGS = "chunk_id string, doc_id long, term string, frequency long, slot string, batch long"
#: Documents that came again, up to which they are sent to all tasks.
MOST_BROADCAST = 1_000_000
log = logging.getLogger("marlstone.jobs.text_index")


def arriving(spark: SparkSession, documents: str, files_per_batch: int) -> DataFrame:
    """A stream of the documents of a folder, a glob, or one file (as a glob, since a stream doesn't take a file)."""
    path = documents.rstrip("/")
    path = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(DOCUMENTS).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def one_of_each(batch: DataFrame) -> DataFrame:
    """A row a doc_id; texts are shuffled only if a doc_id is repeated."""
    rows = batch.where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    rows = rows.withColumn("order", F.struct(F.length("text"), "text", F.coalesce("source", F.lit(""))))
    return indexing.last_by_key(rows, "doc_id", "order").drop("order")


def chunks_of(docs: DataFrame, suffix: str) -> DataFrame:
    """chunk_id (doc_id:line) and the columns of CHUNKS but batch; no shuffle."""
    path = F.concat(F.coalesce(F.concat("source", F.lit("/")), F.lit("")), F.col("doc_id").cast("string"), F.lit(suffix))
    made = chunking.chunk_files(docs.select(path.alias("path"), F.col("text").alias("content")))
    own = F.substring_index(F.col("file_path"), "/", -1)
    doc_id = F.substring(own, F.lit(1), F.length(own) - len(suffix))
    source = F.when(F.contains("file_path", F.lit("/")), F.substring(F.col("file_path"), F.lit(1), F.length("file_path") - F.length(own) - 1))
    sign = local_sign(embed_text(F.col("name"), F.col("kind"), F.col("content")))
    cut = postings.with_lengths(made.select(F.concat(doc_id, F.lit(":"), F.col("start_line").cast("string")).alias("chunk_id"), doc_id.cast("long").alias("doc_id"), source.alias("source"), "kind", "name", "start_line", "end_line", "content"))
    return cut.withColumn("sign", sign)


def slot(term: Column) -> Column:
    """One of 16."""
    return F.substring(F.md5(term), 1, 1)


def _write(df: DataFrame, path: str, by: list[str]) -> int:
    """The partitions that df has rows of, and only these, anew; how many rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["n"]


def take(batch: DataFrame, number: int, out: str, settings: dict) -> dict:
    """Writes the postings and chunks of a batch, chunks last: a batch counts when its chunks are there. What it read and wrote."""
    mark = F.lit(number).cast("long")
    n = batch.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    made = chunks_of(one_of_each(batch), settings["suffix"])
    terms = postings.postings(made.select("chunk_id", "doc_id", "name", "content"), "chunk_id", "doc_id").withColumn("slot", slot(F.col("term"))).withColumn("batch", mark)
    done = {"batch": number, "documents": n["rows"], "without_id": n["rows"] - n["ids"]}
    done["postings"] = _write(terms.hint("rebalance", "slot"), f"{out}/postings", ["slot", "batch"])
    done["chunks"] = _write(made.withColumn("batch", mark), f"{out}/chunks", ["batch"])
    log.info("batch %(batch)d: read %(documents)d documents (%(without_id)d without an id), wrote %(chunks)d chunks and %(postings)d postings", done)
    return done


def run(spark: SparkSession, documents: str, out: str, settings: dict) -> list[dict]:
    """Takes the files that are new; for each batch what it read and wrote."""
    done: list[dict] = []
    log.info("reading what is new in %s", documents)
    stream = arriving(spark, documents, settings["files_per_batch"])
    writer = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").foreachBatch(lambda batch, number: done.append(take(batch, number, out, settings)))
    writer.trigger(availableNow=True).start().awaitTermination()
    log.info("%d batches, %d documents; the index is in %s", len(done), sum(x["documents"] for x in done), out)
    return done


def index(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The chunks and postings that hold now: of each document, those of the last batch that had it.

    Postings of batches that don't count are left out. Rows are compared only with documents that came again, and shuffled only if these are many.
    """
    chunks, terms = spark.read.schema(CHUNKS).parquet(f"{out}/chunks"), spark.read.schema(POSTINGS).parquet(f"{out}/postings")
    terms = terms.join(F.broadcast(chunks.select("batch").distinct()), "batch", "left_semi")
    again = chunks.groupBy("doc_id").agg(F.min("batch").alias("first"), F.max("batch").alias("last")).where("first < last").select(F.col("doc_id").alias("_doc_id"), F.col("last").alias("_last"))
    n = again.count()
    if not n:
        return chunks, terms
    again = F.broadcast(again) if n <= MOST_BROADCAST else again
    old = (F.col("doc_id") == F.col("_doc_id")) & (F.col("batch") < F.col("_last"))
    return chunks.join(again, old, "left_anti"), terms.join(again, old, "left_anti")


def search(spark: SparkSession, out: str, query: str, top_k: int = 10) -> DataFrame:
    """The top_k chunks by BM25; reads the slots of the query's terms, and of chunks the lengths, and texts only of what it gives."""
    chunks, terms = index(spark, out)
    words = postings.query_terms(spark, query)
    asked = terms.where(F.col("slot").isin(sorted({hashlib.md5(w.encode()).hexdigest()[0] for w in words})))
    found = postings.bm25_scores(asked, chunks, query, "chunk_id").orderBy(F.desc("bm25"), "chunk_id").limit(top_k)
    return chunks.join(F.broadcast(found), "chunk_id").select("chunk_id", "doc_id", "source", "bm25", "content")  # top_k rows


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.text_index", description=__doc__.splitlines()[0])
    p.add_argument("--documents", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName("text index").getOrCreate()
    try:
        print(json.dumps(run(spark, a.documents, a.out, json.loads(Path(a.config).read_text()))))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
