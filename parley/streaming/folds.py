"""Per-key folds over a stream of turns (an extension: experiments themselves are batch)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def flow_counts(turns: DataFrame, key: str, stage: str, at: str) -> DataFrame:
    """Running stage changes and self-loops per key; a row per key and batch."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, moves, loops = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(at)
        for s in rows[stage]:
            if last is not None:
                moves, loops = moves + (s != last), loops + (s == last)
            last = s
        state.update((last, int(moves), int(loops)))
        yield pd.DataFrame({key: [k[0]], "last_stage": [last], "n_stage_transitions": [int(moves)], "n_self_loops": [int(loops)]})

    kind = turns.schema[key].dataType.simpleString()
    return turns.select(key, stage, at).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_stage string, n_stage_transitions long, n_self_loops long", "last string, moves long, loops long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and tumbling window, with a watermark for late rows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
