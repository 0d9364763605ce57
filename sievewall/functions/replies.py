"""Recorded replies of classifiers, judges and servers to closed vocabulary; whatever departs from its contract is unavailable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(value: Column) -> Column:
    """The JSON type of a variant, or null where there is none."""
    return F.schema_of_variant(value)


def part(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def lakera_reason(body: Column) -> Column:
    """pass, lakera:prompt_attack, or lakera_unavailable:bad-response.

    flagged is a boolean, breakdown a list of objects with a string
    detector_type and a boolean detected; exactly one is prompt_attack, and if
    it is detected the whole must be flagged.
    """
    reply = F.try_parse_json(body)
    entries = F.try_variant_get(reply, "$.breakdown", "array<variant>")
    shaped = F.forall(entries, lambda e: F.coalesce((kind_of(part(e, "$.detector_type")) == "STRING") & (kind_of(part(e, "$.detected")) == "BOOLEAN"), F.lit(False)))
    attacks = F.filter(entries, lambda e: F.try_variant_get(e, "$.detector_type", "string") == "prompt_attack")
    fine = (kind_of(part(reply, "$.flagged")) == "BOOLEAN") & shaped & (F.size(attacks) == 1)
    detected = F.try_variant_get(F.try_element_at(attacks, F.lit(1)), "$.detected", "boolean")
    flagged = F.try_variant_get(reply, "$.flagged", "boolean")
    return F.when(fine & ~detected, "pass").when(fine & detected & flagged, "lakera:prompt_attack").otherwise("lakera_unavailable:bad-response")


def armor_reason(body: Column) -> Column:
    """pass, model_armor:prompt_attack, or model_armor_unavailable with partial-invocation, skipped or bad-response."""
    reply = F.try_parse_json(body)
    base = "$.sanitizationResult"
    found = f"{base}.filterResults.pi_and_jailbreak.piAndJailbreakFilterResult"

    def said(path: str) -> Column:
        return F.when(kind_of(part(reply, path)) == "STRING", F.try_variant_get(reply, path, "string"))

    down = "model_armor_unavailable:"
    match = said(f"{found}.matchState")
    answer = F.when(match == "MATCH_FOUND", "model_armor:prompt_attack").when(match == "NO_MATCH_FOUND", "pass")
    ran = said(f"{found}.executionState")
    state = F.when(ran == "EXECUTION_SKIPPED", down + "skipped").when(ran == "EXECUTION_SUCCESS", answer)
    invoked = said(f"{base}.invocationResult")
    return F.coalesce(F.when(invoked.isin("PARTIAL", "FAILURE"), down + "partial-invocation").when(invoked == "SUCCESS", state), F.lit(down + "bad-response"))


def judge_vote(said: Column) -> Column:
    """benign or attack if that is all the judge said, in either case and with its usual marks around it; else unavailable."""
    bare = F.regexp_replace(F.regexp_replace(said, r"^(?U)\s+|(?U)\s+$", ""), "^[.!\"'`]+|[.!\"'`]+$", "")
    return F.when(F.lower(bare).isin("benign", "attack"), F.lower(bare)).otherwise("unavailable")


def http_status(value: Column) -> Column:
    """A whole number from 100 to 599, or null."""
    number = F.trim(value).try_cast("int")
    return F.when(number.between(100, 599), number)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a finite number from 0 on, or the time to an HTTP date; null if it is neither."""
    text = F.trim(value)
    number = text.try_cast("double")
    seconds = F.when(~F.isnan(number) & (number >= 0) & (number < float("inf")), number)
    date = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.unix_micros(date) / F.lit(1e6) - now
    return F.when(number.isNotNull(), seconds).when(until.isNotNull(), F.greatest(F.lit(0.0), until))


def breaker_cause(status: Column) -> Column:
    """What a refusal's status says about the breaker: quota, service, or nothing."""
    return F.when(status == 429, "quota").when(status == 503, "service")
