"""Packing ranked chunks into a context: tiers by score or by token budget, and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (full, summary) thresholds by density.
DENSITIES = {"minimal": (0.85, 0.6), "sparse": (0.75, 0.5), "balanced": (0.65, 0.4), "detailed": (0.5, 0.25), "thorough": (0.3, 0.1)}
LEAST_STUB = 0.15
HIGH, MEDIUM = 0.65, 0.35


def _lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def header(file_path: Column, start_line: Column, name: Column) -> Column:
    return F.concat(F.lit("### "), file_path, F.lit(":"), start_line.cast("string"), F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(" `"), name, F.lit("`"))).otherwise(""))


def stub(content: Column, chunk_id: Column) -> Column:
    return F.concat(F.get(_lines(content), F.lit(0)), F.lit("\n  // … (chunk_id: "), chunk_id, F.lit(")"))


def summary(content: Column, chunk_id: Column) -> Column:
    """The first line, up to three later comment lines, and a note."""
    lines = _lines(content)
    comments = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"^\s+", "").rlike(r"^(//|\*|#)"))
    note = F.concat(F.lit("  // … "), F.size(lines).cast("string"), F.lit(" lines  (chunk_id: "), chunk_id, F.lit(")"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.slice(comments, 1, 3), F.array(note)), "\n")


def without(chunks: DataFrame, exclude: list[str]) -> DataFrame:
    return chunks.where(~F.col("id").isin(exclude)) if exclude else chunks


def tier_by_score(score: Column, density: str = "balanced") -> Column:
    full, short = DENSITIES[density]
    return F.when(score >= full, "full").when(score >= short, "summary").when(score >= LEAST_STUB, "stub").otherwise("dropped")


def tier_by_budget(chunks: DataFrame, token_budget: int) -> DataFrame:
    """chunks (rank, ...) with tier: in the order of rank, the first of full, summary and stub that still fits.

    chunks are the few results of a search: the fold runs over one array of their rows, with their lengths.
    """
    fixed = F.length(header(F.col("file_path"), F.col("start_line"), F.col("name"))) + 10
    of = lambda x: (F.length(x) + fixed).cast("long")
    sizes = chunks.select(F.col("rank").cast("long").alias("at"), of(F.col("content")).alias("a"), of(summary(F.col("content"), F.col("id"))).alias("b"), of(stub(F.col("content"), F.col("id"))).alias("c"), F.struct(*chunks.columns).alias("row"))
    rows = sizes.agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "c", "row")), lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)).alias("x"))

    def fit(state: Column, x: Column) -> Column:
        left = state["left"]
        tier = F.when(x["a"] <= left, "full").when(x["b"] <= left, "summary").when(x["c"] <= left, "stub").otherwise("dropped")
        used = F.when(x["a"] <= left, x["a"]).when(x["b"] <= left, x["b"]).when(x["c"] <= left, x["c"]).otherwise(F.lit(0).cast("long"))
        return F.struct((left - used).alias("left"), F.array_append(state["out"], tier).alias("out"))

    start = F.struct(F.lit(token_budget * 4 - 200).cast("long").alias("left"), F.array().cast("array<string>").alias("out"))
    tiers = F.aggregate("x", start, fit)["out"]
    return rows.select(F.explode(F.arrays_zip(F.col("x.row").alias("row"), tiers.alias("tier"))).alias("z")).select("z.row.*", "z.tier")


def compressed(chunks: DataFrame, density: str = "balanced", exclude: list[str] | None = None, token_budget: int | None = None) -> DataFrame:
    """chunks with tier, and content cut down to it; dropped ones are kept with tier 'dropped'."""
    kept = without(chunks, exclude or [])
    tiered = tier_by_budget(kept, token_budget) if token_budget and token_budget > 0 else kept.withColumn("tier", tier_by_score(F.col("score"), density))
    content = F.when(F.col("tier") == "summary", summary(F.col("content"), F.col("id"))).when(F.col("tier") == "stub", stub(F.col("content"), F.col("id"))).otherwise(F.col("content"))
    return tiered.withColumn("content", content)


def dropped_count(packed: DataFrame) -> DataFrame:
    return packed.agg(F.count_if(F.col("tier") == "dropped").alias("dropped"))


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "High").when(score >= MEDIUM, "Medium").otherwise("Low")


def rendered(packed: DataFrame, task: str) -> DataFrame:
    """One row: context (markdown), shown, dropped, ids. packed are the few results of a search."""
    own = F.concat(header(F.col("file_path"), F.col("start_line"), F.col("name")), F.lit("\n```\n"), F.col("content"), F.lit("\n```\n"))
    rows = packed.select("rank", "id", "tier", band(F.col("score")).alias("band"), own.alias("text"))
    all_ = rows.agg(F.array_sort(F.collect_list(F.when(F.col("tier") != "dropped", F.struct("rank", "id", "band", "text")))).alias("x"), F.count_if(F.col("tier") == "dropped").alias("dropped"))

    def section(name: str) -> Column:
        texts = F.transform(F.filter("x", lambda x: x["band"] == name), lambda x: x["text"])
        return F.when(F.size(texts) > 0, F.concat(F.array(F.lit(f"## {name}\n")), texts)).otherwise(F.array().cast("array<string>"))

    note = F.when(F.col("dropped") > 0, F.array(F.concat(F.lit("\n*"), F.col("dropped").cast("string"), F.lit(" lower-scoring chunk(s) omitted — narrow query or increase token_budget to see them.*\n")))).otherwise(F.array().cast("array<string>"))
    context = F.array_join(F.concat(F.array(F.lit(f"# Context: {task}\n")), section("High"), section("Medium"), section("Low"), note), "\n")
    return all_.select(context.alias("context"), F.size("x").alias("shown"), "dropped", F.transform("x", lambda x: x["id"]).alias("ids"))


def search_report(packed: DataFrame, task: str, excluded: int = 0) -> DataFrame:
    """One row: text, the rendered context with a footer of its size and its chunks."""
    r = rendered(packed, task)
    n = lambda c: c.cast("string")
    notes = [n(F.col("shown")), F.lit(" chunks shown"), F.when(F.col("dropped") > 0, F.concat(F.lit(" | "), n(F.col("dropped")), F.lit(" dropped"))).otherwise("")]
    notes.append(F.lit(f" | {excluded} excluded" if excluded else ""))
    head = F.concat(F.lit("*~"), n(F.ceil(F.length("context") / 4)), F.lit(" tokens | "), *notes, F.lit("*"))
    return r.select(F.concat_ws("\n", "context", F.lit("---"), head, F.concat(F.lit("*chunk_ids: "), F.array_join("ids", ", "), F.lit("*"))).alias("text"))


def task_report(notes: DataFrame, packed: DataFrame, task: str) -> DataFrame:
    """One row: text, the notes (content, tags, stale, score) of past sessions in their order and the context. notes are few."""
    from .memory import lines_of, newest_best

    own = notes.agg(F.array_sort(F.collect_list(newest_best())).alias("notes"))
    both = own.withColumn("r", rendered(packed, task).select(F.struct("context", "shown", "dropped")).scalar()).select("notes", "r.*")
    lines = F.transform("notes", lines_of)
    warning = F.when(F.exists("notes", lambda m: m["stale"]), "\n> Some memories are flagged stale — verify before relying on them.").otherwise("")
    title = F.lit("## Memories from past sessions")
    head = F.when(F.size("notes") > 0, F.concat(F.array(F.concat(title, warning, F.lit("\n"))), lines)).otherwise(F.array(F.concat(title, F.lit("\n*(none found for this topic)*"))))
    body = F.array_join(F.concat(head, F.array(F.lit(""), F.col("context"))), "\n")
    out = both.select(body.alias("body"), F.size("notes").alias("n"), "shown", "dropped")
    end = F.concat(F.lit("\n\n---\n*~"), F.ceil(F.length("body") / 4).cast("string"), F.lit(" tokens | "), F.col("n").cast("string"), F.lit(" memories | "), F.col("shown").cast("string"), F.lit(" chunks"), F.when(F.col("dropped") > 0, F.concat(F.lit(" | "), F.col("dropped").cast("string"), F.lit(" dropped"))).otherwise(""), F.lit("*"))
    return out.select(F.concat("body", end).alias("text"))
