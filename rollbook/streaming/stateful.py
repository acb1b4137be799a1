"""The fold as a stateful streaming operator: one state per asset in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollbook.operators import fold

OUTPUT_SQL = f"name string, batch_rows long, {fold.state_sql('')}"


def _step(key, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one asset in one batch. Late rows are judged by the fold itself, so
    there is no watermark that could drop them."""
    state = fold.State(*store.get) if store.exists else None
    # a batch is bounded by the source's trigger limit; order within it is by arrival
    rows = pd.concat(list(frames), ignore_index=True).sort_values("seq")
    for row in zip(*(rows[f].astype(object).where(rows[f].notna(), None) for f in fold.Event._fields)):
        event = fold.Event._make(row)._replace(op=int(row[0]), slot=int(row[1]), seq=int(row[2]), valid=int(row[7]))
        state, _, _ = fold.advance(state, event)
    if state is None:
        if store.exists:
            store.remove()
    else:
        store.update(tuple(None if v is None else (str(v) if isinstance(v, str) else int(v)) for v in state))
    values = (None,) * len(fold.State._fields) if state is None else state
    out = dict(zip(fold.State._fields, values)) | {"name": key[0], "batch_rows": len(rows)}
    yield pd.DataFrame({c.split()[0]: pd.Series([out[c.split()[0]]], dtype=object) for c in OUTPUT_SQL.split(", ")})


def state_stream(events: DataFrame) -> DataFrame:
    """One output row per touched asset and batch: its state after the batch."""
    coded = fold.coded(events)
    return (
        coded.select("name", *fold.Event._fields)
        .groupBy("name")
        .applyInPandasWithState(
            _step, OUTPUT_SQL, fold.state_sql(""), "update", GroupStateTimeout.NoTimeout
        )
    )
