"""Chunking of files by line rules: one row a chunk, without a shuffle and without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern, kind, group of the name), first match wins.
PYTHON_RULES = ((r"^(async\s+)?def\s+(\w+)", "function", 2), (r"^class\s+(\w+)", "class", 1))
SCRIPT_RULES = (
    (r"^(export\s+)?(async\s+)?function\s+(\w+)", "function", 3),
    (r"^(export\s+)?(abstract\s+)?class\s+(\w+)", "class", 3),
    (r"^(export\s+)?const\s+(\w+)\s*=\s*(async\s+)?\(", "function", 2),
    (r"^(export\s+)?const\s+(\w+)\s*=\s*(async\s+)?function", "function", 2),
)
MARKDOWN_RULES = ((r"^#{1,3}\s+(.+)", "section", 1),)

_CHUNK = ["id", "file_path", "kind", "name", "start_line", "end_line", "content", "ordinal"]


def _module(path: Column, content: Column) -> Column:
    return F.struct(F.concat(path, F.lit("::module")).alias("id"), F.lit("module").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"), F.size(F.split(content, "\n", -1)).alias("end_line"), content.alias("content"), F.lit(1).alias("ordinal"))


def chunks_as_module(files: DataFrame) -> DataFrame:
    """files (path, content): each as one chunk."""
    return files.select(F.col("path").alias("file_path"), _module(F.col("path"), F.col("content")).alias("x")).select("file_path", "x.*").select(_CHUNK)


def chunks_by_rules(files: DataFrame, rules) -> DataFrame:
    """files (path, content): a chunk from each line that a rule matches to the line before the next.

    What stands before the first match is in no chunk; a file without matches is one module. Ids can repeat. Lines and
    matches are generated columns, so that lambdas read them and don't compute them again.
    """
    split = files.select("path", "content", F.explode(F.array(F.split("content", "\n", -1))).alias("lines"))

    def match(line: Column, i: Column) -> Column:
        kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
        for pattern, k, group in reversed(rules):
            kind = F.when(line.rlike(pattern), F.lit(k)).otherwise(kind)
            name = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group)).otherwise(name)
        return F.struct(i.alias("at"), kind.alias("kind"), name.alias("name"))

    found = split.withColumn("hits", F.explode(F.array(F.filter(F.transform("lines", match), lambda h: h["kind"].isNotNull()))))

    def chunk(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get("hits", k + 1)["at"], F.size("lines"))
        mark = F.when(h["kind"] == "section", F.regexp_replace(h["name"], r"\s+", "_")).otherwise(h["name"])
        return F.struct(F.concat("path", F.lit("::"), mark).alias("id"), h["kind"].alias("kind"), h["name"].alias("name"), (h["at"] + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", h["at"] + 1, end - h["at"]), "\n").alias("content"), (k + 1).alias("ordinal"))

    made = F.when(F.size("hits") > 0, F.transform("hits", chunk)).otherwise(F.array(_module(F.col("path"), F.col("content"))))
    return found.select(F.col("path").alias("file_path"), F.explode(made).alias("x")).select("file_path", "x.*").select(_CHUNK)


def chunk_files(files: DataFrame) -> DataFrame:
    """files (path, content) by extension: scripts by their syntax, Python and Markdown by rules, others as modules."""
    from .syntax import chunks_by_syntax

    kind = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))
    script, python, markdown = kind.isin(".ts", ".tsx", ".js", ".jsx"), kind == ".py", kind == ".md"
    out = chunks_by_syntax(files.where(script))
    for part in (chunks_by_rules(files.where(python), PYTHON_RULES), chunks_by_rules(files.where(markdown), MARKDOWN_RULES), chunks_as_module(files.where(~(script | python | markdown)))):
        out = out.unionByName(part)
    return out
