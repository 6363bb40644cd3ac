"""Analytics on dependency edges (from_file depends on to_file): breadth-first levels as joins.

Every level takes the edges of its frontier and drops what was seen; levels are written tables, so plans don't grow. A frontier of few
files is pushed to the edges as a filter, so that of stored edges, which lie by their ends, a level reads the parts that have them; a larger one
is joined. Edges are not copied. The number of levels is bounded by the caller's depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import counted, materialized

MOST_HOPS = 4
MOST_PUSHED = 1000  # files of a frontier that are pushed as a filter


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("from_file", "to_file").dropDuplicates()


def direct_dependents(edges: DataFrame, file: str) -> DataFrame:
    return edges.where(F.col("to_file") == file).select(F.col("from_file").alias("file"))


def dependencies(edges: DataFrame, file: str) -> DataFrame:
    return edges.where(F.col("from_file") == file).select(F.col("to_file").alias("file"))


def levels(steps: DataFrame, root: str, most: int, root_seen: bool) -> DataFrame:
    """file, depth of what is reached from root over steps (a, b); root itself only if reached again and not root_seen."""
    spark = steps.sparkSession
    steps = steps.select("a", "b")
    names, frontier = [root], None
    seen = spark.range(1).select(F.lit(root).alias("file"), F.lit(0).alias("depth")) if root_seen else spark.range(0).select(F.lit("").alias("file"), F.lit(0).alias("depth"))
    for depth in range(1, most + 1):
        near = steps.join(frontier, steps.a == frontier.file) if names is None else steps.where(F.col("a").isin(names))
        reached = near.select(F.col("b").alias("file")).distinct().join(seen.select("file"), "file", "left_anti")
        level, n = counted(reached.withColumn("depth", F.lit(depth)))
        if not n:
            break
        seen = seen.unionByName(level)
        frontier = level.select("file")
        names = [r["file"] for r in frontier.where("file is not null").collect()] if n <= MOST_PUSHED else None
    return seen


def is_test(file: Column) -> Column:
    return file.rlike(r"\.(test|spec)\.[jt]sx?$") | file.rlike("/__tests__/")


def impact(edges: DataFrame, file: str, max_depth: int = 5) -> DataFrame:
    """file, depth, is_test of all that depends on file, directly or not; file itself if it is in a cycle."""
    back = edges.select(F.col("to_file").alias("a"), F.col("from_file").alias("b"))
    return levels(back, file, max_depth, False).select("file", "depth", is_test(F.col("file")).alias("is_test"))


def distances(edges: DataFrame, file: str, max_hops: int = MOST_HOPS) -> DataFrame:
    """file, distance over edges in both directions, up to max_hops."""
    both = edges.select(F.col("from_file").alias("a"), F.col("to_file").alias("b")).union(edges.select(F.col("to_file").alias("a"), F.col("from_file").alias("b")))
    return levels(both, file, max_hops, True).select("file", F.col("depth").alias("distance"))


def with_distance(files: DataFrame, edges: DataFrame, file: str, max_hops: int = MOST_HOPS) -> DataFrame:
    """files (file) with distance; max_hops + 1 if further or not connected."""
    return files.join(distances(edges, file, max_hops), "file", "left").withColumn("distance", F.coalesce("distance", F.lit(max_hops + 1)))


def risk_score(direct: Column, transitive: Column) -> Column:
    return F.least(F.lit(100).cast("long"), direct * 10 + transitive * 2)


def risk_label(score: Column) -> Column:
    return F.when(score >= 60, "critical").when(score >= 30, "high").when(score >= 10, "medium").otherwise("low")


def risk(impacts: DataFrame) -> DataFrame:
    """One row: direct, transitive, score, label."""
    counts = impacts.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    return counts.withColumn("score", risk_score(F.col("direct"), F.col("transitive"))).withColumn("label", risk_label(F.col("score")))


def impacts(edges: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """root, file, depth for every root (file) at once; as impact of each. A row a root and file that it reaches: for some roots, not for all files of a dense graph."""
    back = materialized(edges.select(F.col("to_file").alias("a"), F.col("from_file").alias("b")))
    frontier = roots.select(F.col("file").alias("root"), "file").distinct()
    seen = frontier.withColumn("depth", F.lit(0)).limit(0)
    for depth in range(1, max_depth + 1):
        reached = back.join(frontier, back.a == frontier.file).select("root", F.col("b").alias("file")).distinct().join(seen.select("root", "file"), ["root", "file"], "left_anti")
        level, n = counted(reached.withColumn("depth", F.lit(depth)))
        if not n:
            break
        seen = seen.unionByName(level)
        frontier = level.select("root", "file")
    return seen


def risks(edges: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """file, direct, transitive, score, label of every root; those without dependents too."""
    counts = impacts(edges, roots, max_depth).groupBy(F.col("root").alias("file")).agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    zero = F.lit(0).cast("long")
    out = roots.select("file").distinct().join(counts, "file", "left").select("file", F.coalesce("direct", zero).alias("direct"), F.coalesce("transitive", zero).alias("transitive"))
    return out.withColumn("score", risk_score(F.col("direct"), F.col("transitive"))).withColumn("label", risk_label(F.col("score")))


def impact_report(edges: DataFrame, file: str, max_depth: int = 5, heading: str = "Impact of") -> DataFrame:
    """part, depth, line: the lines of the report about a change of file, in this order; a line for each dependent, at any number of them."""
    found = impact(edges, file, max_depth)
    found = materialized(found.select("file", F.col("depth").cast("int").alias("depth"), "is_test"))
    tick = lambda x: F.concat(F.lit("- `"), x, F.lit("`"))
    sums = risk(found).withColumn("tests", found.agg(F.count_if("is_test")).scalar())
    n = lambda c: F.col(c).cast("string")
    none = F.col("direct") + F.col("transitive") == 0
    say = lambda part, line, cond=F.lit(True): F.struct(F.lit(part).alias("part"), F.when(cond, line).alias("line"))
    lines = [
        say(0, F.when(none, F.lit(f"No dependents found for `{file}`. Safe to change.")).otherwise(F.lit(f"## {heading} `{file}`"))),
        say(1, F.concat(F.lit("**Risk: "), F.upper("label"), F.lit(" ("), n("score"), F.lit("/100)**")), ~none),
        say(2, F.concat(F.lit("**Direct dependents ("), n("direct"), F.lit("):**")), ~none),
        say(4, F.concat(F.lit("**Transitive dependents ("), n("transitive"), F.lit("):**")), F.col("transitive") > 0),
        say(6, F.when(F.col("tests") > 0, F.concat(F.lit("**Test files affected ("), n("tests"), F.lit("):**"))).otherwise("No test files affected."), ~none),
    ]
    heads = sums.select(F.inline(F.array(*lines))).where("line is not null").select("part", F.lit(0).alias("depth"), "line")
    direct = found.where("depth = 1").select(F.lit(3).alias("part"), "depth", tick(F.col("file")).alias("line"))
    further = found.where("depth > 1").select(F.lit(5).alias("part"), "depth", F.concat(tick(F.col("file")), F.lit(" (depth "), n("depth"), F.lit(")")).alias("line"))
    tests = found.where("is_test").select(F.lit(7).alias("part"), "depth", tick(F.col("file")).alias("line"))
    return heads.union(direct).union(further).union(tests)


def change_report(edges: DataFrame, file: str) -> DataFrame:
    """One row: report, JSON that says how safe a change of file is."""
    r = risk(impact(edges, file))
    fields = F.struct(F.lit(file).alias("file"), F.col("label").alias("risk"), "score", (F.col("direct") + F.col("transitive")).alias("affected"), "direct")
    return r.select(F.to_json(fields).alias("report"))
