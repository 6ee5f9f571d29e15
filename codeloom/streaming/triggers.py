"""Index triggers: trailing debounce and a lock per repository (T1-T3), batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEBOUNCE_MICROS = 5_000_000


def debounce(triggers: DataFrame, key: str, ts: str, gap_micros: int = DEBOUNCE_MICROS) -> DataFrame:
    """One row per run of triggers that are less than the gap apart: key, first, last, fires_at, triggers.

    The same plan serves tables and streams (a stream needs a watermark on ``ts``). A trigger exactly
    one gap after the last starts a new run; a session window would take it in, so the window is one
    microsecond shorter. Null keys and times take no part.
    """
    window = F.session_window(F.col(ts), f"{gap_micros - 1} microseconds")
    return (
        triggers.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(key), window.alias("w"))
        .agg(F.count(F.lit(1)).alias("triggers"), F.min(ts).alias("first_trigger"), F.max(ts).alias("last_trigger"))
        .select(key, "first_trigger", "last_trigger", (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("fires_at"), "triggers")
    )


def drop_while_running(fires: DataFrame, key: str, at: str, run_micros: int) -> DataFrame:
    """Input plus ``runs``: false for fires while a run of the key is going on.

    The state is one number per key, carried over its ordered fires in sorted batches, so a hot key
    is streamed through its task, never held as a whole.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    ordered = (
        fires.withColumn("_cl_at", micros).repartition(F.col(key)).sortWithinPartitions(key, "_cl_at")
    )
    schema = fires.withColumn("runs", F.lit(True)).schema

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, busy = object(), None
        for batch in batches:
            out = []
            for value, moment in zip(batch[key], batch["_cl_at"], strict=True):
                if value != current:
                    current, busy = value, None
                starts = busy is None or moment >= busy
                if starts:
                    busy = moment + run_micros
                out.append(starts)
            yield batch.drop(columns="_cl_at").assign(runs=out)

    return ordered.mapInPandas(walk, schema)


def lock_stream(fires: DataFrame, key: str, at: str, run_micros: int) -> DataFrame:
    """Streaming form of ``drop_while_running``: keyed state holds the end of the current run."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        busy = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at)
        out = []
        for moment in rows[at]:
            micros = pd.Timestamp(moment).value // 1000
            starts = busy is None or micros >= busy
            if starts:
                busy = micros + run_micros
            out.append((group[0], moment, starts))
        state.update((busy,))
        yield pd.DataFrame(out, columns=[key, at, "runs"])

    schema = fires.select(key, at).withColumn("runs", F.lit(True)).schema
    return fires.groupBy(key).applyInPandasWithState(step, schema, "busy long", "append", "NoTimeout")


def fold_locked(starts: Column, run_micros: int) -> Column:
    """Native form over the ordered start times of one key (array of micros): those that run."""
    state = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(None).cast("bigint").alias("busy"))

    def step(acc: Column, t: Column) -> Column:
        free = acc["busy"].isNull() | (t >= acc["busy"])
        return F.struct(
            F.when(free, F.array_append(acc["kept"], t)).otherwise(acc["kept"]).alias("kept"),
            F.when(free, t + run_micros).otherwise(acc["busy"]).alias("busy"),
        )

    return F.aggregate(starts, state, step, lambda acc: acc["kept"])
