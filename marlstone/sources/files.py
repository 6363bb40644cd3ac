"""Source trees as tables, and the tsconfig of a project."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.imports import PathAliases

#: Fixed values.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".md", ".go", ".rs")
IGNORED = ("node_modules", ".git", "dist", ".marlstone", ".next", "__pycache__")


def wanted(path: Column, root: str) -> Column:
    """Whether a file below root has a known extension and is in no ignored folder."""
    below = F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path))
    ignored = "|".join(x.replace(".", r"\.") for x in IGNORED)
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)).isin(*EXTENSIONS) & ~below.rlike(f"/({ignored})/")


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, content of the wanted files below root. Listing and reading are distributed; unreadable files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    path = plain_path(F.col("path"))
    return raw.where(wanted(path, root)).select(path.alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime of the wanted files below root; no file is read."""
    return source_files(spark, root).select("path", "mtime")


MOST_NAMED = 5000
_GLOB = str.maketrans({c: "\\" + c for c in "\\*?[]{}"})


def read_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path, mtime, content of the files of root in paths (path). Some are read by name; of more than MOST_NAMED, by a pass over the tree."""
    few = [r["path"] for r in paths.select("path").limit(MOST_NAMED + 1).collect()]  # MOST_NAMED names
    if not few:
        return source_files(spark, root).limit(0)
    if len(few) > MOST_NAMED:
        return source_files(spark, root).join(paths.select("path").distinct(), "path", "left_semi")
    scheme = root[: root.index("/")] if ":" in root.split("/")[0] and not root.startswith("file:") else ""
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load([("" if scheme and p.startswith(scheme) else scheme) + p.translate(_GLOB) for p in few])
    return raw.select(plain_path(F.col("path")).alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def aliases_of(tsconfig: str, root: str) -> PathAliases | None:
    """Of the text of a tsconfig that is strict JSON."""
    try:
        options = json.loads(tsconfig)["compilerOptions"]
        base = options.get("baseUrl")
        base = root if not base else base if base.startswith("/") else f"{root.rstrip('/')}/{base}"
        return PathAliases(base.rstrip("/") or "/", [(k, list(v)) for k, v in (options.get("paths") or {}).items()])
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def path_aliases(spark: SparkSession, root: str) -> PathAliases:
    """From the first of tsconfig.json and tsconfig.base.json that is strict JSON; else no aliases."""
    for name in ("tsconfig.json", "tsconfig.base.json"):
        found = spark.read.format("binaryFile").option("pathGlobFilter", name).load(root).where(F.col("path").endswith("/" + name)).select("content").take(1)
        aliases = aliases_of(bytes(found[0]["content"]).decode(errors="replace"), root) if found else None
        if aliases:
            return aliases
    return PathAliases(root)
