"""The monthly budget over a stream of reservations, with its ledger in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

DECISION = "vendor string, ord long, decision string, granted boolean, used long"
#: The state store that a processor with several kinds of state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_month(month: str) -> int:
    """Milliseconds at which the month after a `yyyy-MM` begins (UTC)."""
    year, number = int(month[:4]), int(month[5:])
    return int(datetime(year + number // 12, number % 12 + 1, 1, tzinfo=UTC).timestamp() * 1000)


class BudgetProcessor(StatefulProcessor):
    """A vendor's ledger: its month, what of it is used, and the amounts of reservations that may be given back.

    Rows are taken batch by batch in the order in which they come, and sorted
    by time within a batch; neither a trigger's rows nor the reservations are
    held together. A later month's first reservation forgets those of the month
    before; where none comes, a timer does so `grace_days` after the month's
    end by the watermark, and a release after that keeps its charge.
    """

    def __init__(self, limit: int, grace_days: int = 31):
        self.limit, self.grace = limit, grace_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ledger = handle.getValueState("ledger", StructType([StructField("month", StringType()), StructField("used", LongType())]))
        self.held = handle.getMapState("held", StructType([StructField("reservation", StringType())]), StructType([StructField("amount", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        month, used = self.ledger.get() if self.ledger.exists() else ("", 0)
        for batch in rows:
            out = []
            for row in batch.sort_values(["ts", "ord"], kind="stable").itertuples(index=False):
                decision = "ignored" if row.kind == "release" else "error"
                named = isinstance(row.reservation, str)
                if row.kind == "release":
                    if named and self.held.exists() and self.held.containsKey((row.reservation,)):
                        used, decision = max(0, used - self.held.getValue((row.reservation,))[0]), "released"
                        self.held.removeKey((row.reservation,))
                elif not pd.isna(row.amount) and row.amount >= 0:
                    if row.month > month:
                        month, used = row.month, 0
                        self.held.clear()
                        for old in list(self.handle.listTimers()):
                            self.handle.deleteTimer(old)
                        self.handle.registerTimer(next_month(month) + self.grace)
                    decision = "allowed" if used + row.amount <= self.limit else "throttled"
                    if decision == "allowed":
                        used += int(row.amount)
                        if named:
                            self.held.updateValue((row.reservation,), (int(row.amount),))
                out.append((key[0], row.ord, decision, decision == "allowed", used))
            yield pd.DataFrame(out, columns=["vendor", "ord", "decision", "granted", "used"])
        self.ledger.update((month, used))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield pd.DataFrame({"vendor": pd.Series([], dtype=str), "ord": pd.Series([], dtype="int64"), "decision": pd.Series([], dtype=str), "granted": pd.Series([], dtype=bool), "used": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def budget_stream(events: DataFrame, limit: int, late: str = "1 day") -> DataFrame:
    """vendor, ord, decision, granted, used for a streaming frame of events(vendor, ord, ts, amount, kind, reservation), as of the batch operator.

    Needs the session's state store to be RocksDB (`STATE_STORE`). A vendor's
    events are decided in the order in which they arrive, `late` or not; an
    event of an earlier month than the ledger's finds the later month's count.
    """
    from pyspark.sql import functions as F

    rows = events.withWatermark("ts", late).select("vendor", "ord", "ts", F.date_format("ts", "yyyy-MM").alias("month"), F.col("amount").cast("long").alias("amount"), F.coalesce("kind", F.lit("reserve")).alias("kind"), F.col("reservation").cast("string").alias("reservation"))
    return rows.groupBy("vendor").transformWithStateInPandas(BudgetProcessor(limit), DECISION, "Append", "EventTime")
