"""The rate limiter over a stream of events, with its state in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievewall.operators.limits import DECISION, LimiterConfig, LimiterState, step

STATE = "tokens double, updated double, open_until double, failures int, cause string, tripped double"


def restored(row: tuple, now: float, config: LimiterConfig) -> LimiterState:
    """A stored state, with times that lie too far ahead pulled back to where they can be."""
    tokens, updated, open_until, failures, cause, tripped = row
    return LimiterState(min(max(tokens, 0.0), config.burst), updated, min(open_until, now + config.longest), max(failures, 0), cause, min(tripped, now), config)


def limiter_stream(events: DataFrame, config: LimiterConfig | None = None) -> DataFrame:
    """vendor, ord, decision, wait for a streaming frame of the same columns as the batch operator's.

    Events are taken batch by batch in the order in which they come, in order
    of time within a batch, so that a trigger's rows are never held together;
    the state carries to the next. A success that began before the breaker's last trip is late and
    does not close it.
    """
    own = config or LimiterConfig()
    names = [x.split()[0] for x in STATE.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limiter = None
        for rows in parts:
            rows, out = rows.sort_values(["ts", "ord"], kind="stable"), []
            if limiter is None:
                limiter = restored(state.get, float(rows["ts"].iloc[0]), own) if state.exists else LimiterState(own.burst, config=own)
            for row in rows.itertuples(index=False):
                after = None if pd.isna(row.retry_after) else float(row.retry_after)
                out.append((key[0], row.ord, *step(limiter, row.kind, row.ts, row.started_at, row.cause, after)))
            yield pd.DataFrame(out, columns=["vendor", "ord", "decision", "wait"])
        if limiter is not None:
            kept = asdict(limiter)
            state.update(tuple(kept[x] for x in names))

    return events.groupBy("vendor").applyInPandasWithState(run, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)
