"""Packs the context of saved tasks: for each the best texts, cut down to a density or a token budget, and the notes that it recalls.

    python -m jobs.context_packs --documents PATH --events PATH --conversations PATH --out FOLDER [--config FILE]

For teams that open the same tasks again and again, over all texts at once instead of a search a task. Texts (doc_id, text, source) are chunks, clicks of events
(props: {"k": doc_id}) are the log of what was expanded, user turns of conversations are notes. Two reads of the texts serve all tasks: the first
leaves a narrow row for each, which every task ranks; the second fetches the texts of the best, 3 * top_k a task. Writes OUT/packs (what of
each text is shown) and OUT/reports (the whole report), both by task; a run replaces what the last one wrote, so it can be repeated.

The tasks, and how many notes each recalls, are in the settings. Null texts are left out; a null source is an empty path.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import token_estimate
from marlstone.functions.vectors import LocalBackend, local_sign
from marlstone.operators import memory, packing, rerank, scoring
from marlstone.plans.materialize import materialized, temporary

CONFIG = Path(__file__).with_suffix(".json")
log = logging.getLogger("marlstone.jobs.context_packs")


def chunks_of(documents: DataFrame) -> DataFrame:
    path = F.coalesce("source", F.lit(""))
    return documents.where("text is not null").select(F.col("doc_id").cast("string").alias("id"), path.alias("file_path"), F.lit("section").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n", -1)).alias("end_line"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))


def clicks_of(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'click'").select(F.get_json_object("props", "$.k").alias("chunk_id"), F.lit("expand").alias("action"))


def notes_of(conversations: DataFrame) -> DataFrame:
    order = F.col("conv_id") * 1000 + F.col("turn")
    return conversations.where("role = 'user' and text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.array("role").alias("tags"), F.lit(False).alias("stale"), F.col("conv_id").alias("created_at"), order.alias("seq"))


def candidates(chunks: DataFrame, clicks: DataFrame, tasks: list[dict]) -> DataFrame:
    """task, rank, score and the chunk of the best 3 * top_k of each task."""
    narrow = materialized(chunks.select("id", "file_path", "seq", local_sign(F.col("content")).alias("sign")))
    best = None
    for t in tasks:
        backend = LocalBackend(t["query"], sign="sign")
        own = scoring.top_candidates(scoring.scored_chunks(narrow, t["query"], 0, log=clicks, backend=backend), 3 * t["top_k"])
        own = own.select(F.lit(t["name"]).alias("task"), "id", "rank", "score")
        best = own if best is None else best.union(own)
    best = materialized(best)
    return materialized(chunks.join(F.broadcast(best), "id"))  # 3 * top_k rows a task


def packed(found: DataFrame, task: dict) -> DataFrame:
    """The packed chunks of a task, by BM25 and the signals."""
    own = rerank.rerank(found.where(F.col("task") == task["name"]).drop("task"), task["query"], task["top_k"])
    return packing.compressed(own, task.get("density", "balanced"), None, task.get("token_budget"))


def _write(df: DataFrame, path: str) -> int:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").partitionBy("task").parquet(path)  # some rows a task
    return seen.get["n"]


def run(spark: SparkSession, documents: str, events: str, conversations: str, out: str, settings: dict) -> dict:
    """Writes packs and reports; what it read and wrote."""
    tasks = settings["tasks"]
    if not tasks or len({t["name"] for t in tasks}) < len(tasks):
        raise ValueError("tasks must have names, each another")
    read = Observation()
    source = spark.read.parquet(documents).select("doc_id", "text", "source").observe(read, F.count(F.lit(1)).alias("n"))
    with temporary(spark):
        clicks = materialized(clicks_of(spark.read.parquet(events)))
        notes = notes_of(spark.read.parquet(conversations))
        found = candidates(chunks_of(source), clicks, tasks)
        packs, reports = None, None
        for t in tasks:
            own = materialized(packed(found, t))
            recalled = memory.recall(notes, LocalBackend(t["query"]), settings["notes"])
            shown = own.where("tier <> 'dropped'").select(F.lit(t["name"]).alias("task"), F.col("rank").cast("long").alias("rank"), "id", "file_path", "tier", "score", token_estimate(F.col("content")).cast("long").alias("tokens"), "content")
            report = packing.task_report(recalled, own, t["query"]).select(F.lit(t["name"]).alias("task"), "text")
            packs, reports = (shown, report) if packs is None else (packs.union(shown), reports.union(report))
        done = {"documents": read.get["n"], "tasks": len(tasks), "packs": _write(packs, f"{out}/packs"), "reports": _write(reports, f"{out}/reports")}
    log.info("read %(documents)d documents for %(tasks)d tasks, wrote %(packs)d packed texts and %(reports)d reports", done)
    return done


def output(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    packs = "rank long, id string, file_path string, tier string, score double, tokens long, content string, task string"
    return spark.read.schema(packs).parquet(f"{out}/packs"), spark.read.schema("text string, task string").parquet(f"{out}/reports")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m jobs.context_packs", description=__doc__.splitlines()[0])
    for x in ("documents", "events", "conversations", "out"):
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = SparkSession.builder.appName("context packs").getOrCreate()
    try:
        print(json.dumps(run(spark, a.documents, a.events, a.conversations, a.out, json.loads(Path(a.config).read_text()))))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
