"""Votes of classifier panels, honeypot scenarios and judges to one fail-closed outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("pass", "flagged", "degraded-quota", "unavailable")


def clean_votes(votes: DataFrame) -> DataFrame:
    """Votes with reasons outside the vocabulary turned into <vendor>_unavailable:bad-result, and kind: pass, flag, quota or hard."""
    down = F.concat(F.col("vendor"), F.lit("_unavailable:"))
    passed = (F.col("reason") == "pass") & F.col("ok") & ~F.col("flagged")
    flag = (F.col("reason") == F.concat(F.col("vendor"), F.lit(":prompt_attack"))) & ~F.col("ok") & F.col("flagged")
    short = ~F.col("ok") & ~F.col("flagged") & F.col("reason").startswith(down)
    known = F.coalesce(passed | flag | short, F.lit(False))
    voted = votes.withColumn("kind", F.when(passed, "pass").when(flag, "flag").otherwise("short")).withColumn("reason", F.when(known, F.col("reason")).otherwise(F.concat(down, F.lit("bad-result"))))
    quota = (F.col("reason") == F.concat(down, F.lit("HTTPError:429"))) | (F.col("reason") == F.concat(down, F.lit("throttled")))
    return voted.withColumn("kind", F.when(F.col("kind") == "short", F.when(quota, "quota").otherwise("hard")).otherwise(F.col("kind")))


def first_where(condition: Column, order: str, value: str) -> Column:
    """An aggregate: the value of the row first in order among those that fit, or null."""
    return F.min(F.when(condition, F.struct(F.col(order), F.col(value))))[value]


def panel_outcome(votes: DataFrame, floor: int = 2) -> DataFrame:
    """doc_id, outcome, reason, verdicts from votes(doc_id, vendor, vendor_ord, ok, flagged, reason).

    With as many verdicts as the floor asks, the first flag decides, or all
    passed. With fewer, the first shortfall that is no quota makes the panel
    unavailable; else it is degraded by quota, with the first shortfall.
    """
    kind = F.col("kind")
    reduced = clean_votes(votes).groupBy("doc_id").agg(
        F.count_if(kind.isin("pass", "flag")).cast("int").alias("verdicts"),
        first_where(kind == "flag", "vendor_ord", "reason").alias("flag"),
        first_where(kind == "hard", "vendor_ord", "reason").alias("hard"),
        first_where(kind.isin("hard", "quota"), "vendor_ord", "reason").alias("short"),
    )
    enough = F.col("verdicts") >= floor
    outcome = F.when(enough, F.when(F.col("flag").isNotNull(), "flagged").otherwise("pass")).otherwise(F.when(F.col("hard").isNotNull(), "unavailable").otherwise("degraded-quota"))
    reason = F.when(enough, F.coalesce("flag", F.lit("pass"))).otherwise(F.coalesce("hard", "short"))
    return reduced.select("doc_id", outcome.alias("outcome"), reason.alias("reason"), "verdicts")


def panel_summary(outcome: Column, verdicts: Column, vendors: int, floor: int) -> Column:
    return F.concat(outcome, F.lit(" verdicts="), verdicts.cast("string"), F.lit(f"/{vendors} floor={floor}"))


def outcome_of(summary: Column) -> Column:
    """The summary's first word if it is an outcome, else null."""
    word = F.substring_index(summary, " ", 1)
    return F.when(word.isin(*OUTCOMES), word)


def honeypot_outcome(results: DataFrame) -> DataFrame:
    """doc_id, ok, reason from results(doc_id, scenario, scenario_ord, verdict, signal).

    A triggered scenario rejects, with the count of those that did not answer;
    so does any that did not answer; else it is a pass.
    """
    hit = F.col("verdict") == "Honeypot_Triggered"
    skipped = ~F.coalesce(F.col("verdict").isin("Honeypot_Triggered", "Honeypot_Left_Alone"), F.lit(False))
    said = results.withColumn("said", F.concat_ws(":", "scenario", "signal"))
    reduced = said.groupBy("doc_id").agg(
        first_where(hit, "scenario_ord", "said").alias("hit"), first_where(skipped, "scenario_ord", "said").alias("gap"), F.count_if(skipped).alias("gaps"), F.count(F.lit(1)).alias("total")
    )
    suffix = F.when(F.col("gaps") > 0, F.concat(F.lit("+skipped="), F.col("gaps").cast("string"), F.lit("/"), F.col("total").cast("string"))).otherwise("")
    reason = F.when(F.col("hit").isNotNull(), F.concat(F.lit("honeypot:"), F.col("hit"), suffix)).when(F.col("gap").isNotNull(), F.concat(F.lit("honeypot_unavailable:"), F.col("gap"), suffix)).otherwise("pass")
    return reduced.select("doc_id", (F.col("hit").isNull() & F.col("gap").isNull()).alias("ok"), reason.alias("reason"))


def judge_outcome(votes: DataFrame, judges: int) -> DataFrame:
    """doc_id, ok, reason from votes(doc_id, judge, judge_ord, vote, signal): a full bench of benign votes passes."""
    vote = F.col("vote")
    said = votes.withColumn("outage", F.concat_ws(":", F.lit("judge_unavailable"), "judge", "signal"))
    reduced = said.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(vote == "benign").alias("benign"), first_where(vote == "attack", "judge_ord", "judge").alias("attack"), first_where(~F.coalesce(vote.isin("benign", "attack"), F.lit(False)), "judge_ord", "outage").alias("outage")
    )
    full = (F.col("n") == judges) & (F.col("benign") == F.col("n"))
    reason = F.when(full, "benign-unanimous").when(F.col("attack").isNotNull(), F.concat(F.lit("attack:"), F.col("attack"))).otherwise(F.coalesce("outage", F.lit("judge_unavailable:panel-incomplete")))
    return reduced.select("doc_id", full.alias("ok"), reason.alias("reason"))


def arbitration(panel: DataFrame, honeypot: DataFrame, judges: DataFrame, use_honeypot: bool = True) -> DataFrame:
    """doc_id, reason (pass or the rejecting layer's) from the three reductions.

    A flag or quota pressure is put to the honeypot and then to the judges;
    a panel that is unavailable rejects by itself.
    """
    joined = panel.select("doc_id", "outcome", F.col("reason").alias("panel_reason")).join(honeypot.select("doc_id", F.col("ok").alias("hp_ok"), F.col("reason").alias("hp_reason")), "doc_id", "left").join(judges.select("doc_id", F.col("ok").alias("judge_ok"), F.col("reason").alias("judge_reason")), "doc_id", "left")
    deferred = F.col("outcome").isin("flagged", "degraded-quota") & F.lit(use_honeypot)
    gate = F.lit(use_honeypot) & ~F.coalesce("hp_ok", F.lit(False))
    reason = (
        F.when((F.col("outcome") != "pass") & ~deferred, F.col("panel_reason"))
        .when(gate, F.concat(F.lit("honeypot:"), F.coalesce("hp_reason", F.lit("honeypot_unavailable:missing"))))
        .when(deferred & ~F.coalesce("judge_ok", F.lit(False)), F.concat(F.lit("l2_arbitration:"), F.coalesce("judge_reason", F.lit("judge_unavailable:panel-incomplete"))))
        .otherwise("pass")
    )
    return joined.select("doc_id", reason.alias("reason"))


def canary_contacts(calls: DataFrame, canaries: list[tuple[str, str]]) -> DataFrame:
    """doc_id, signal: the first call that carries a planted canary, the document's own before others'.

    calls(doc_id, own, call_ord, tool, args); canaries: (label, token) of a
    fixed handful of scenario constants in order, so the search is a filter per
    call on an array of them and not a join.
    """
    none = F.array().cast("array<struct<canary_ord:int,label:string,token:string>>")
    table = F.array(*[F.struct(F.lit(i).alias("canary_ord"), F.lit(label).alias("label"), F.lit(token).alias("token")) for i, (label, token) in enumerate(canaries)]) if canaries else none
    met = calls.withColumn("met", F.explode(F.filter(table, lambda c: F.contains(F.col("args"), c["token"]))))
    cross = F.col("met.label") != F.col("own")
    signal = F.concat(F.when(cross, "canary_in_arg_crosstalk:").otherwise("canary_in_arg:"), F.col("met.label"), F.lit(":"), F.col("tool"))
    return met.groupBy("doc_id").agg(F.min(F.struct(cross.alias("cross"), "call_ord", F.col("met.canary_ord").alias("canary_ord"), signal.alias("signal")))["signal"].alias("signal"))
