"""Rate limits and budgets as keyed folds over events."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far a token count may fall short of one and still count as one.
EPSILON = 1e-9
DECISION = "vendor string, ord long, decision string, wait double"


@dataclass
class LimiterConfig:
    """Seconds per token, tokens at most, and the breaker's first and longest pause."""

    interval: float = 300.0
    burst: float = 10.0
    backoff: float = 300.0
    longest: float = 3600.0


@dataclass
class LimiterState:
    """A token bucket behind a breaker, for one vendor."""

    tokens: float
    updated: float = 0.0
    open_until: float = 0.0
    failures: int = 0
    cause: str | None = None
    tripped: float = 0.0
    config: LimiterConfig = field(default_factory=LimiterConfig)

    def acquire(self, now: float) -> tuple[str, float]:
        """Refill since the last look or the breaker's end, then spend a token if there is one."""
        since = max(self.updated, self.open_until)
        gained = max(0.0, now - since) / self.config.interval if self.config.interval > 0 else self.config.burst
        self.tokens = min(self.config.burst, self.tokens + gained)
        self.updated = now
        if now < self.open_until:
            return ("service_unavailable" if self.cause == "service" else "throttled"), self.open_until - now
        if self.tokens >= 1 - EPSILON:
            self.tokens -= 1
            return "allowed", 0.0
        return "throttled", (1 - self.tokens) * self.config.interval

    def refused(self, now: float, cause: str, retry_after: float | None) -> None:
        """The vendor said no: open the breaker for longer each time, and let one probe through afterwards."""
        self.failures += 1
        pause = retry_after if retry_after is not None else self.config.backoff * 2.0 ** min(self.failures - 1, 32)
        still_open = now < self.open_until
        self.open_until = max(self.open_until, now + min(max(pause, 0.0), self.config.longest))
        if not (still_open and self.cause == "service"):
            self.cause = cause
        self.tripped = now
        self.tokens = min(self.tokens, 1.0)

    def succeeded(self, started: float) -> None:
        """A success closes the breaker unless its call began before the last trip."""
        if started >= self.tripped:
            self.failures, self.open_until, self.tripped, self.cause = 0, 0.0, 0.0, None


def step(state: LimiterState, kind: str, now: float, started: float, cause: str, retry_after: float | None) -> tuple[str, float]:
    """One event of a vendor; only `acquire` asks for a decision."""
    if kind == "acquire":
        return state.acquire(now)
    if kind == "throttled":
        state.refused(now, cause, retry_after)
    elif kind == "success":
        state.succeeded(started)
    return "recorded", 0.0


def limiter_decisions(events: DataFrame, config: LimiterConfig | None = None) -> DataFrame:
    """vendor, ord, decision, wait of events(vendor, ord, ts, kind, started_at, cause, retry_after), in order of ts and ord.

    The bucket and breaker carry from event to event of a vendor, so a vendor
    is one sequence; its rows stream through a task in order, whatever their
    number, and only the state is held.
    """
    own = config or LimiterConfig()
    order = ["vendor", "ts", "ord"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vendor, state = None, LimiterState(own.burst, config=own)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.vendor != vendor:
                    vendor, state = row.vendor, LimiterState(own.burst, config=own)
                after = None if pd.isna(row.retry_after) else float(row.retry_after)
                out.append((row.vendor, row.ord, *step(state, row.kind, row.ts, row.started_at, row.cause, after)))
            yield pd.DataFrame(out, columns=["vendor", "ord", "decision", "wait"])

    return events.select("vendor", "ord", "ts", "kind", "started_at", "cause", "retry_after").repartition("vendor").sortWithinPartitions(*order).mapInPandas(run, DECISION)


def budget_decisions(events: DataFrame, limit: int) -> DataFrame:
    """vendor, ord, decision, granted, used of events(vendor, ord, ts, amount) and, where they have them, kind and reservation.

    `reserve` (the kind where there is none) takes all of its amount or
    nothing, within a calendar month (UTC): allowed, throttled, or error for
    an amount that is null or negative. `release` gives a reservation's amount
    back once, if it was granted and the ledger is still on its month; the
    decision is released or ignored. An event of an earlier month than the
    ledger's finds the later month's count: a clock that steps back mints no
    budget. A refused amount is not spent, so this is a fold and no prefix
    sum. A vendor is one sequence and streams through a task in order; what
    is held are the amounts that the present month granted.
    """
    has = set(events.columns)
    kind = F.coalesce("kind", F.lit("reserve")) if "kind" in has else F.lit("reserve")
    reservation = F.col("reservation").cast("string") if "reservation" in has else F.lit(None).cast("string")
    months = events.select("vendor", "ord", "ts", F.date_format("ts", "yyyy-MM").alias("month"), F.col("amount").cast("long").alias("amount"), kind.alias("kind"), reservation.alias("reservation"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vendor, month, used, held = None, "", 0, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.vendor != vendor:
                    vendor, month, used, held = row.vendor, "", 0, {}
                decision = "ignored" if row.kind == "release" else "error"
                if row.kind == "release":
                    amount = held.pop(row.reservation, None)
                    if amount is not None:
                        decision, used = "released", max(0, used - amount)
                elif not pd.isna(row.amount) and row.amount >= 0:
                    if row.month > month:
                        month, used, held = row.month, 0, {}
                    decision = "allowed" if used + row.amount <= limit else "throttled"
                    if decision == "allowed":
                        used += int(row.amount)
                        if row.reservation is not None:
                            held[row.reservation] = int(row.amount)
                out.append((row.vendor, row.ord, decision, decision == "allowed", used))
            yield pd.DataFrame(out, columns=["vendor", "ord", "decision", "granted", "used"])

    return months.repartition("vendor").sortWithinPartitions("vendor", "ts", "ord").drop("ts").mapInPandas(run, "vendor string, ord long, decision string, granted boolean, used long")
