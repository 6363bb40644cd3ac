"""Dependency edges from sources: imports are extracted by pattern and resolved against the known files.

Resolution makes candidate paths with a priority and keeps the best that is a known file, by one join; the
file system isn't probed. A file that exists but wasn't scanned is therefore not found.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import distinct_edges

#: What an import, a re-export and a Python import look like, and the endings that are tried in order.
IMPORT = r"""(?:from|import|require)\s*(?:\(?\s*)?['"]([^'"]+)['"]"""
RE_EXPORT = r"""(?:export\s+(?:\*|\{[^}]*\})\s+from|export\s+\*\s+from)\s*['"]([^'"]+)['"]"""
PYTHON_IMPORT = r"(?m)^(?:from\s+(\S+)\s+import|import\s+(\S+))"
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


@dataclass
class PathAliases:
    """baseUrl and paths of a tsconfig, in their order."""

    base: str
    paths: list[tuple[str, list[str]]] = field(default_factory=list)


def normal_path(path: Column) -> Column:
    """path without . and .. segments."""
    step = lambda out, s: F.when(s.isin("", "."), out).when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, s))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _under(base: Column, path: Column) -> Column:
    return normal_path(F.when(path.startswith("/"), path).when(base == "", path).otherwise(F.concat(base, F.lit("/"), path)))


def found_imports(files: DataFrame) -> DataFrame:
    """from_file, spec for each import in files (path, content); Python modules as relative paths."""
    kind = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))
    script = files.where(kind.isin(".ts", ".tsx", ".js", ".jsx")).select(F.col("path").alias("from_file"), F.explode(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))).alias("spec"))
    python = files.where(kind == ".py").select(F.col("path").alias("from_file"), F.explode(F.regexp_extract_all("content", F.lit(PYTHON_IMPORT), F.lit(0))).alias("line"))
    module = F.regexp_extract("line", r"^(?:from|import)\s+(\S+)", 1)
    return script.union(python.select("from_file", F.concat(F.lit("./"), F.regexp_replace(module, r"\.", "/")).alias("spec")))


def found_re_exports(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("from_file"), F.explode(F.regexp_extract_all("content", F.lit(RE_EXPORT), F.lit(1))).alias("spec"))


def candidates(root: str, aliases: PathAliases, js_to_ts: bool = False) -> Column:
    """Of from_file and spec: possible targets in order of preference."""
    spec, here = F.col("spec"), directory(F.col("from_file"))
    tried = lambda base: [F.concat(base, F.lit(e)) for e in ENDINGS]
    near = _under(here, spec)
    relative = tried(near)
    if js_to_ts:
        relative.append(F.regexp_replace(near, r"\.js(x?)$", ".ts$1"))
    other = []
    for pattern, targets in aliases.paths:
        star = pattern.endswith("/*")
        prefix = pattern[:-2] if star else pattern
        fits = spec.startswith(prefix + "/") if star else spec == pattern
        for target in targets:
            head, mark, tail = target.partition("*")
            rest = F.substring(spec, F.lit(len(prefix) + 2), F.length(spec)) if star else F.lit(mark)
            path = F.concat(F.lit(head), rest, F.lit(tail)) if mark else F.lit(target)
            other += [F.when(fits, c) for c in tried(_under(F.lit(aliases.base), path))]
    parts = F.split(spec, "/")
    package = F.when(spec.startswith("@"), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    other.append(F.concat(F.lit(f"{root.rstrip('/')}/packages/" if root else "packages/"), package, F.lit("/src/index.ts")))
    return F.when(spec.startswith("."), F.array(*relative)).otherwise(F.array(*other))


def resolved(imports: DataFrame, files: DataFrame, root: str, aliases: PathAliases, js_to_ts: bool = False) -> DataFrame:
    """from_file, to_file for the imports (from_file, spec) that name a known file."""
    tried = imports.distinct().select("from_file", "spec", F.posexplode(candidates(root, aliases, js_to_ts)).alias("place", "to_file")).where("to_file is not null")
    known = tried.join(files.select(F.col("path").alias("to_file")).distinct(), "to_file", "left_semi")
    return known.groupBy("from_file", "spec").agg(F.min_by("to_file", "place").alias("to_file")).select("from_file", "to_file")


def build_edges(files: DataFrame, root: str = "", aliases: PathAliases | None = None, js_to_ts: bool = False) -> DataFrame:
    """Distinct from_file, to_file of files (path, content); index files are followed one level through their re-exports."""
    aliases = aliases or PathAliases(root)
    direct = resolved(found_imports(files), files, root, aliases, js_to_ts).distinct()
    onward = resolved(found_re_exports(files), files, root, aliases, js_to_ts).select(F.col("from_file").alias("barrel"), F.col("to_file").alias("next"))
    script = F.lower(F.regexp_extract("from_file", r"\.[^./]*$", 0)).isin(".ts", ".tsx", ".js", ".jsx")
    barrels = direct.where(F.col("to_file").rlike(r"index\.(ts|js)$") & (F.col("to_file") != F.col("from_file")) & script)
    through = barrels.join(onward, barrels.to_file == onward.barrel).select("from_file", F.col("next").alias("to_file"))
    return distinct_edges(direct.union(through))
