"""A run in stages, each a table: what is there already is not made again, and one stage's failure need not stop the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Run:
    """The tables made so far, by stage, and how each stage went: made, there already, skipped or failed with its error."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)


def wanted(names: list[str], text: str) -> list[str]:
    """The stages that a list with commas asks for, in their own order; ``all`` for all. An unknown name is an error."""
    asked = [x.strip() for x in text.split(",") if x.strip()]
    unknown = [x for x in asked if x not in names and x != "all"]
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(unknown)}; known: {', '.join(names)}")
    return list(names) if "all" in asked else [n for n in names if n in asked]


def run(spark: SparkSession, stages: dict[str, tuple[Stage, tuple[str, ...]]], folder: str, only: str = "all", resume: bool = True, keep_going: bool = False, key: str | None = None) -> Run:
    """Makes the tables of the stages (function, names of those that it needs) below a folder, in order.

    With ``resume`` a table that is complete is read, not made; with a ``key`` only rows of keys that it lacks are added. A stage that
    needs one that failed is skipped. Without ``keep_going`` a failure ends the run.
    """
    out, todo = Run(), set(wanted(list(stages), only))
    for name, (make, needs) in stages.items():
        path = f"{folder}/{name}"
        there = complete(spark, path)
        if there and (resume or name not in todo) and key is None:
            out.tables[name], out.status[name] = spark.read.parquet(path), "there already"
            continue
        if name not in todo or any(n not in out.tables for n in needs):
            out.status[name] = "skipped"
            continue
        try:
            made = make(out.tables)
            if there and resume and key is not None:
                made = made.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
            made.write.mode("append" if there and resume else "overwrite").parquet(path)
            out.tables[name], out.status[name] = spark.read.parquet(path), "made"
        except Exception as e:
            out.status[name] = f"failed: {str(e).splitlines()[0][:200]}"
            if not keep_going:
                break
    return out


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end, by Spark's success mark, wherever it is."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def report(spark: SparkSession, done: Run) -> DataFrame:
    """How each stage went (stage, status, rows), rows of those that have a table."""
    rows = [(name, status, done.tables[name].count() if name in done.tables else None) for name, status in done.status.items()]
    return spark.createDataFrame(rows, "stage string, status string, rows long").orderBy(F.col("stage"))
