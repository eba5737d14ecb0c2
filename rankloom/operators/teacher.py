"""Labels from an outside teacher, asked in batches by the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

#: How often a failed batch may be halved.
DEEPEST = 8


def label_batches(rows: DataFrame, teacher: Callable[[pd.DataFrame], list], label: T.DataType | str, size: int = 20, name: str = "label") -> DataFrame:
    """Adds the teacher's labels, asked for size rows at a time. A batch that fails, or whose answer has not one label
    for each row, is asked again in halves; a single row that fails, or any after eight halvings, ends the job. Batches
    of a partition follow each other and partitions run side by side, so the teacher sees one call a core."""
    columns = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T._parse_datatype_string(label) if isinstance(label, str) else label)])

    def answered(batch: pd.DataFrame) -> list:
        waiting, labels = [(batch, 0)], []
        while waiting:
            part, depth = waiting.pop()
            try:
                got = list(teacher(part))
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} labels for {len(part)} rows")
                labels += got
            except Exception:
                if len(part) < 2 or depth >= DEEPEST:
                    raise
                middle = len(part) // 2
                waiting += [(part.iloc[middle:], depth + 1), (part.iloc[:middle], depth + 1)]
        return labels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size]
                yield part.assign(**{name: answered(part)})[[*columns, name]]

    return rows.mapInPandas(run, schema)


class Retry(Exception):
    """Raised by a teacher whose call may succeed when it is made again: a timeout, or too many requests."""


@dataclass
class Answer:
    """Labels of a batch, and what the call used."""

    labels: list
    model: str = ""
    input_tokens: int = 0
    output_tokens: int = 0
    cost_usd: float = 0.0


#: What each call leaves: the batch that it belongs to (its place in its partition), the try, how deep the batch was halved, its rows,
#: and `answered`, `again` (tried again after a wait) or `failed` (halved, or the end of the job).
CALL = "batch string, try int, depth int, n_rows int, outcome string, model string, input_tokens bigint, output_tokens bigint, total_tokens bigint, cost_usd double, seconds double"


def label_with_log(rows: DataFrame, key: str, teacher: Callable[[pd.DataFrame, int], Answer], label: T.DataType | str, size: int = 20, name: str = "label", tries: int = 3, wait: tuple[float, float] = (1.0, 8.0)) -> tuple[DataFrame, DataFrame]:
    """rows with the teacher's labels, and the log of all calls (CALL). teacher(batch, try) gets up to size rows.

    A call that raises Retry is made again after a wait that doubles from wait[0] to wait[1], tries times in all; a batch that fails
    then, or otherwise, or whose answer has not one label for each row, is halved as in label_batches, and a single
    row that fails ends the job. Labels and log are written once, side by side, by the same tasks: the log of a task
    that was lost goes with its labels, so each label stands with just the calls that made it. Rows are dealt by a hash of key
    and all columns, so a hot key is spread, and a repeated task meets the same batches."""
    columns = rows.columns
    kind = T._parse_datatype_string(label) if isinstance(label, str) else label
    call = T._parse_datatype_string(CALL)
    fields = [T.StructField("__row", T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])), T.StructField("__label", kind), T.StructField("__call", call)]

    def answered(batch: pd.DataFrame, named: str) -> tuple[list, list[dict]]:
        waiting, labels, calls = [(batch, 0)], [], []
        while waiting:
            part, depth = waiting.pop()
            for n in range(1, tries + 1):
                began = time.monotonic()
                made = {"batch": named, "try": n, "depth": depth, "n_rows": len(part), "outcome": "failed", "model": None, "input_tokens": 0, "output_tokens": 0, "total_tokens": 0, "cost_usd": 0.0}
                try:
                    got = teacher(part, n)
                    if len(got.labels) != len(part):
                        raise ValueError(f"{len(got.labels)} labels for {len(part)} rows")
                    made |= {"outcome": "answered", "model": got.model, "input_tokens": got.input_tokens, "output_tokens": got.output_tokens, "total_tokens": got.input_tokens + got.output_tokens, "cost_usd": got.cost_usd}
                    labels += got.labels
                except Exception as e:
                    if isinstance(e, Retry) and n < tries:
                        made["outcome"] = "again"
                    elif len(part) < 2 or depth >= DEEPEST:
                        raise
                    else:
                        middle = len(part) // 2
                        waiting += [(part.iloc[middle:], depth + 1), (part.iloc[:middle], depth + 1)]
                calls.append(made | {"seconds": time.monotonic() - began})
                if made["outcome"] != "again":
                    break
                time.sleep(min(wait[1], wait[0] * 2 ** (n - 1)))
        return labels, calls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            # one frame of what a batch of rows gives: frames of a call each cost more than the calls
            records = [{k: None if pd.isna(v) else v for k, v in r.items()} for r in batch.to_dict("records")]
            labels, calls = [], []
            for start in range(0, len(batch), size):
                got, made = answered(batch.iloc[start : start + size], f"{part}-{place}")
                labels += got
                calls += made
                place += 1
            yield pd.DataFrame({"__row": records + [None] * len(calls), "__label": pd.Series([*labels, *[None] * len(calls)], dtype=object), "__call": [None] * len(records) + calls})

    dealt = rows.repartition(key, F.xxhash64(*columns)).sortWithinPartitions(key, F.xxhash64(*columns))
    staged = stage(dealt.mapInPandas(run, T.StructType(fields)), "taught")
    labelled = staged.filter("__call IS NULL").select("__row.*", F.col("__label").alias(name))
    return labelled, staged.filter("__call IS NOT NULL").select("__call.*")


def cost_totals(log: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and cost of a log."""
    return log.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("n_rows").alias("n_rows"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"))
