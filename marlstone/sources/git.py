"""When files were last committed, from the history of a repository.

The history is a Python data source, whose partitions are ranges of commits read where the repository is: all executors must see its folder. The newest
commit of each file follows by an aggregation that merges before the shuffle, so the driver holds nothing of it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMITS_A_PART = 5000


def commits_of(lines: Iterable[str], root: str, place: int = 0) -> Iterator[tuple[str, int, int]]:
    """path, place, time: lines are, for each commit, newest first, @ and its time, then a line for each file."""
    place -= 1
    at = 0
    for line in lines:
        line = line.rstrip("\n")
        if line.startswith("@") and line[1:].isdigit():
            at, place = int(line[1:]), place + 1
        elif line:
            yield f"{root.rstrip('/')}/{line}", place, at


def parsed_times(lines: Iterable[str], root: str, wanted: set[str] | None = None) -> list[tuple[str, int]]:
    """The newest time of each file of such lines; ends when all that are wanted have one."""
    found: dict[str, int] = {}
    for path, _, at in commits_of(lines, root):
        if wanted is None or path in wanted:
            found.setdefault(path, at)
            if wanted is not None and len(found) == len(wanted):
                break
    return sorted(found.items())


def _git(root: str, *args: str) -> Iterator[str]:
    """Lines of what git says; none where there is no repository, or no git."""
    try:
        with subprocess.Popen(["git", "-C", root, "-c", "core.quotepath=off", *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as said:
            yield from said.stdout
    except OSError:
        return


class _History(DataSourceReader):
    def __init__(self, root: str, size: int):
        self.root, self.size = root, size

    def partitions(self) -> list[InputPartition]:
        count = next(_git(self.root, "rev-list", "--count", "HEAD"), "0").strip()
        return [InputPartition(i) for i in range(0, int(count or 0), self.size)] or [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first = partition.value
        yield from commits_of(_git(self.root, "log", "--pretty=format:@%ct", "--name-only", "--relative", f"--skip={first}", f"--max-count={self.size}"), self.root, first)


class GitHistory(DataSource):
    """spark.read.format("git_history").load(root): a row for each file of each commit; place 0 is the newest commit."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "path string, place long, at long"

    def reader(self, schema) -> DataSourceReader:
        return _History(self.options["path"], int(self.options.get("commits", COMMITS_A_PART)))


def history(spark: SparkSession, root: str, commits: int = COMMITS_A_PART) -> DataFrame:
    """path, place, at of the repository at root; so many commits a partition."""
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").option("commits", commits).load(root)


def newest_times(history: DataFrame) -> DataFrame:
    """path, git_updated_at: of each file, the time of the commit that comes first."""
    return history.groupBy("path").agg(F.min_by("at", "place").alias("git_updated_at"))


def git_times(spark: SparkSession, root: str) -> DataFrame:
    """path, git_updated_at; no rows if root is no repository."""
    return newest_times(history(spark, root))
