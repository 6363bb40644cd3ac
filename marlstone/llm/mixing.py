"""Mixing sources to target weights by systematic sampling.

Targets: sources in code point order, null last, take the weights in turn and share all words; a source's
target stops at MOST_COPIES times its words, and the excess goes to the others by weight. Sorted by how
soon they stop, the level at which the rest share follows from running sums over ranges of sources.

Sampling: each document expects target / source words copies. Within a source, documents are ordered by
size, so that the draw is even over sizes; the prefix sum of expected copies plus one random offset
of the source crosses integers, and each crossing emits the document once. What a source takes is then within twice its
longest document of its target. Places come from ranges of the order and counts of each source in them: no task holds a source.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, free_names, map_batches, running, shuffle_partitions, temporary, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, source, size in words, and the column row of whole numbers; without it, a number for each row."""

    def count(batch):
        out = {"doc_id": batch.column(0), "source": batch.column(1), "size": pa.array(count_words(batch.column(2)))}
        return out | ({"row": batch.column(3)} if row else {})

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", *([F.col(row).alias("row")] if row else []))
    held = map_batches(held, count, "doc_id long, source string, size long" + ", row long" * bool(row))
    return held if row else held.withColumn("row", F.monotonically_increasing_id())


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    per, _ = running(per, [by_name], {"name_place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("name_place", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).drop("name_place").withColumn("cap", F.col("source_size") * MOST_COPIES).withColumn("soon", F.col("cap") / F.col("w"))
    per, total = running(per, [F.col("soon"), by_name], {"cap_before": F.col("cap"), "w_before": F.col("w"), "size_before": F.col("source_size")})
    level = (F.lit(total["size_before"]) - F.col("cap_before")).cast("double") / (F.lit(total["w_before"]) - F.col("w_before"))
    per = written(per.withColumn("level", level).withColumn("stops", F.col("level") * F.col("w") >= F.col("cap")))
    final = per.where("not stops").agg(F.min(F.struct("soon", (-F.col("level")).alias("less"))).alias("x")).first()["x"]  # the level of the first source that does not stop is everyone's
    shared = F.lit(-final["less"] if final else 0.0) * F.col("w")
    return per.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, seed: int = SEED, row: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, copies, taken, and with row that column as row.

    A null text has size 0, and a very long one is counted in slices; a null source is a source of its own. A source without words
    has target 0 and its documents get no copies. Ties in size go by a hash of doc_id, doc_id and the row; rows without
    a doc_id and repeated rows are sampled each for itself. Extra columns are ignored, whatever their names; an empty
    table gives an empty result. Reruns agree.
    """
    slot = F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), F.lit(""))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    order = ["key", "size", "slot", "doc_id", "row"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    with temporary(docs.sparkSession) as keep:
        sizes = written(sized(docs, row).withColumn("slot", slot).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))))
        goals = targets(sizes, weights).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
        goals = written(goals.select("key", "source_size", "target", offset.alias("u")))
        dealt = keep(written(sizes.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id())))
        counts = dealt.groupBy("key", "part").agg(F.count("*").alias("n"))  # for a source, a row a partition
        starts = keep(written(counts.select("key", "part", before.alias("start")).join(goals, "key")))
    place = F.col("start") + F.row_number().over(Window.partitionBy("key", "part").orderBy("size", "slot", "doc_id", "row"))
    rows = dealt.join(starts, ["key", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.select("doc_id", "row", "size", "source_size", "target", "u", rate.alias("rate"), place.alias("place"))
    copies = F.least(F.floor(F.col("place") * F.col("rate") + F.col("u")) - F.floor((F.col("place") - 1) * F.col("rate") + F.col("u")), F.lit(MOST_COPIES).cast("long"))
    out = rows.withColumn("copies", copies)
    return out.select("doc_id", *(["row"] if row else []), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns of docs.

    Each row goes for itself: rows without a doc_id and repeated rows are sampled like others. Null and very long texts, null
    sources, ties and empty tables as in mixed; any columns of docs are kept, whatever their names.
    """
    row, own, copies, copy = free_names(docs, "row", "own_row", "copies", "copy")
    with temporary(docs.sparkSession) as keep:
        rows = keep(written(docs.withColumn(row, F.monotonically_increasing_id())))
        plan = mixed(rows, weights, seed, row).where("copies > 0").select(F.col("row").alias(own), F.col("copies").alias(copies))
        plan = keep(written(plan))
    out = rows.join(plan.hint("merge"), F.col(row) == F.col(own))  # plan has a row a document: alike at every size, never broadcast
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(docs.columns)
