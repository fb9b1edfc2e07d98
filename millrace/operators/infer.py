"""Batched calls of a text-to-text model inside a plan.

The model is a factory that each worker calls once. Texts come length-sorted and packed by cost, so that a
batch's longest text sets its size; a batch that fails is halved down to single rows, and a row that
fails alone keeps its place with an error, so that nothing is lost and the job goes on.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

Model = Callable[[list[str]], list[str]]
# Attempts and pauses (seconds) for errors that may pass.
ATTEMPTS, FIRST_PAUSE, LONGEST_PAUSE = 5, 2.0, 60.0


class Transient(Exception):
    """An error that may pass: the call is tried again."""


class Exhausted(Exception):
    """The budget is used up: the job stops."""


def call(model: Model, texts: list[str], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """One call, tried again after transient errors with doubling pauses."""
    pause = FIRST_PAUSE
    for k in range(attempts):
        try:
            return model(texts)
        except Transient:
            if k == attempts - 1:
                raise
            sleep(min(pause, LONGEST_PAUSE))
            pause *= 2
    raise AssertionError


def robust(model: Model, texts: list[str], **kw) -> list[tuple[str | None, str | None]]:
    """(output, error) of each text; a failing batch is halved."""
    try:
        out = call(model, texts, **kw)
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} outputs for {len(texts)} texts")
        return [(o, None) for o in out]
    except Exhausted:
        raise
    except Exception as e:  # noqa: BLE001 - any failure of a model is kept with its row
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:200])]
        half = len(texts) // 2
        return robust(model, texts[:half], **kw) + robust(model, texts[half:], **kw)


def generate(df: DataFrame, id_col: str, text: str, factory: Callable[[], Model], *, budget: float = 8000.0, overhead: float = 400.0, per_token: float = 4.0, most: int = 16,
             parts: int | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """(id, output, error, seconds): one row for each row of `df`; a null text isn't sent and has neither output nor error."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            rows: list[tuple] = []
            pending: list[tuple] = []

            def flush() -> None:
                if pending:
                    began = time.time()
                    out = robust(model, [t for _, t in pending], attempts=attempts)
                    each = (time.time() - began) / len(pending)
                    rows.extend((i, o, e, each) for (i, _), (o, e) in zip(pending, out))
                    pending.clear()

            for i, t in zip(pdf["id"], pdf["text"]):
                if t is None:
                    rows.append((i, None, None, 0.0))
                    continue
                if pending and (len(pending) >= most or (len(pending) + 1) * (len(t) / per_token + overhead) > budget):
                    flush()
                pending.append((i, t))
            flush()
            yield pd.DataFrame(rows, columns=["id", "output", "error", "seconds"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[0].dataType.simpleString()
    sized = rows.withColumn("_n", F.length("text")).repartitionByRange(n, "_n", "id").sortWithinPartitions("_n", "id").drop("_n")
    return sized.mapInPandas(run, f"id {kind}, output string, error string, seconds double")


def verdict(finish: Column, error_kind: Column, structured: Column | bool = True) -> Column:
    """ok, permanent or transient, by why a completion ended and how it parsed.

    One that ended otherwise than by itself (out of its budget, filtered) would end so again: permanent. A
    whole one that breaks the schema too. One without readable JSON was cut on its way and may be better
    next time. An unstated finish is judged by the content; where no structure was asked for, anything is ok.
    """
    asked = F.lit(structured) if isinstance(structured, bool) else structured
    stopped = F.coalesce(finish, F.lit("")).isin("", "stop", "STOP")
    return (F.when(~asked, "ok").when(~stopped, "permanent").when(error_kind.isNull(), "ok").when(error_kind == "schema_error", "permanent").otherwise("transient"))


def sampled(df: DataFrame, id_col: str, text: str, factory: Callable[[float, int], Model], k: int, temperature: float, **kw) -> DataFrame:
    """(id, sample_idx, output, error, seconds): k outputs for each row, sample 0 at temperature 0 and the others at `temperature`.

    `factory(temperature, sample_idx)` gives the model of a sample, so that draws at one temperature differ.
    """
    out = None
    for i in range(k):
        one = generate(df, id_col, text, lambda i=i: factory(temperature if i else 0.0, i), **kw).withColumn("sample_idx", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.select("id", "sample_idx", "output", "error", "seconds")


def empty_and_instant(output: Column, seconds: Column, under: float = 0.05) -> Column:
    """Completions that look as if nothing had run; to be held against a share with stats.guard_share."""
    return (F.coalesce(F.trim(output), F.lit("")) == "") & (seconds < under)
