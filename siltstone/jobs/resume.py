"""Jobs that run in stages and take up where they stopped, and comparisons of snapshots."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_stages(items: DataFrame, done: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """(key, stage) still to run: all stages of all items but those recorded with return code 0."""
    todo = items.select(key, F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    return todo.join(done.filter("rc = 0").select(key, "stage").distinct(), [key, "stage"], "left_anti")


def job_plan(items: DataFrame, records: DataFrame, key: str, stages: list[str], at_most_once: str) -> DataFrame:
    """What a resumed job does for each stage: skip (done), run, or uncertain (``at_most_once`` was started without a recorded success, and is never repeated).

    ``records`` has (key, stage, started, rc).
    """
    todo = items.select(key, F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    seen = records.groupBy(key, "stage").agg(F.bool_or("started").alias("started"), F.bool_or(F.coalesce(F.col("rc") == 0, F.lit(False))).alias("finished"))
    joined = todo.join(seen, [key, "stage"], "left")
    action = F.when(F.col("finished"), "skip").when((F.col("stage") == at_most_once) & F.col("started"), "uncertain").otherwise("run")
    return joined.select(key, "stage", action.alias("action"))


def same_inputs(recorded: dict, current: dict) -> bool:
    """Whether a report may be resumed: schema, profile, manifest and hashes must all agree."""
    return all(recorded.get(k) == current.get(k) for k in ("schema", "profile", "manifest", "hashes"))


def space_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two valid snapshots of the same root and device; a side that wasn't measured gives null, never 0."""
    keys = ["root", "device"]
    b, a = before.filter("status = 'ok'").alias("b"), after.filter("status = 'ok'").alias("a")
    both = b.join(a, keys)
    measure = lambda x: (F.col(f"b.extent_measurement.{x}") - F.col(f"a.extent_measurement.{x}")).alias(f"{x}_saved")
    return both.select(*keys, (F.col("a.filesystem_space.available") - F.col("b.filesystem_space.available")).alias("available_gain"), measure("disk"), measure("raw"), measure("referenced"))


def report_totals(rows: DataFrame, value: str, status: str = "status") -> DataFrame:
    """One row: rows by outcome and the sum over rows that are ok; null where none is."""
    ok = F.col(status) == "ok"
    return rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("errors"), F.sum(F.when(ok, F.col(value))).alias("saving"))


def write_whole(path: str, text: str) -> None:
    """Write a report so that a reader sees the old one or the new one, never a part."""
    temp = f"{path}.{os.getpid()}.tmp"
    with open(temp, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temp, path)


def markdown(df: DataFrame, title: str) -> str:
    """A small result as a Markdown table, pipes escaped."""
    rows = df.collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |", *body, ""])
