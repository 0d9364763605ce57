"""The review of a change from its event to an outcome: guards, carried-over passes, overrides, full reviews, what is posted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewall.functions.reasons import is_config_error
from sievewall.functions.rendering import neutralised
from sievewall.operators.gate import SEVERITIES, severity_rank
from sievewall.tables import by_key, written

# Rules in the order of their checks, the reviewers' passes, and what their replies may hold.
RULES = ("hidden-unicode", "lockfile-host", "binary", "text-binary", "submodule", "sensitive-path", "too-large")
PASSES, STATUSES = ("monitor_a", "monitor_b", "review"), ("ok", "incomplete", "infra")
CATEGORIES = ("malicious", "obscure", "security", "bug")
MODEL_CAP, HIT_CAP, BODY_CAP, MARKER_ROOM = 400_000, 40, 60_000, 256
ACTIONS = ("auto_merge_enabled", "synchronize", "reopened")


def all_hits(*checks: tuple[str, bool, DataFrame], always_on: bool = False) -> DataFrame:
    """change_id, ord, rule, path, detail, overridable of all checks end to end, or of those alone that nothing clears.

    checks: rule, whether the owner may clear it, and its rows (change_id,
    path, detail; rule and overridable too, where a check decides on them).
    """
    frames = []
    for place, (rule, overridable, rows) in enumerate(checks):
        own = F.col("rule") if "rule" in rows.columns else F.lit(rule)
        clear = F.col("overridable") if "overridable" in rows.columns else F.lit(overridable)
        frames.append(rows.select("change_id", F.lit(place).alias("ord"), own.alias("rule"), "path", "detail", clear.alias("overridable")))
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole.where(~F.col("overridable")) if always_on else whole


def too_large(diffs: DataFrame) -> DataFrame:
    """change_id, path, detail of diffs beyond what the reviewers read. diffs(change_id, n_bytes)."""
    said = F.format_string(f"diff is too large for the AI gate (%d bytes, limit {MODEL_CAP}); human review", F.col("n_bytes").cast("long"))
    return diffs.where(F.col("n_bytes") > MODEL_CAP).select("change_id", F.lit("(whole diff)").alias("path"), said.alias("detail"))


def complete_passes(passes: DataFrame, names: tuple[str, ...] = PASSES) -> DataFrame:
    """change_id, complete: whether exactly the named passes came back, each with a known status."""
    reduced = passes.groupBy("change_id").agg(F.array_sort(F.collect_list("name")).alias("names"), F.min(F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).alias("known"))
    return reduced.select("change_id", ((F.col("names") == F.array(*[F.lit(x) for x in sorted(names)])) & F.col("known")).alias("complete"))


def kinds(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def keys_of(json: Column) -> Column:
    return F.array_sort(F.json_object_keys(json))


def valid_reply(kind: Column, reply: Column) -> Column:
    """Whether a reviewer's reply has exactly the keys, types and words that it may have; kind is monitor or review."""
    doc = F.try_parse_json(reply)
    items = F.transform(F.try_variant_get(doc, "$.findings", "array<variant>"), lambda x: F.to_json(x))
    monitor = kind == "monitor"

    def fine(item: Column) -> Column:
        value = F.try_parse_json(item)
        texts = [kinds(value, f"$.{k}") == "STRING" for k in ("file", "category", "severity", "explanation")]
        category, severity = F.get_json_object(item, "$.category"), F.get_json_object(item, "$.severity")
        shaped = keys_of(item) == F.array(*[F.lit(x) for x in ("category", "explanation", "file", "severity")])
        return F.coalesce(shaped & texts[0] & texts[1] & texts[2] & texts[3] & severity.isin(*SEVERITIES) & F.when(monitor, category.isin(*CATEGORIES)).otherwise(category.isin("security", "bug")), F.lit(False))

    suspicion = F.get_json_object(reply, "$.suspicion").try_cast("int")
    scored = (keys_of(reply) == F.array(F.lit("analysis"), F.lit("findings"), F.lit("suspicion"))) & (kinds(doc, "$.suspicion") == "BIGINT") & suspicion.between(0, 100) & (kinds(doc, "$.analysis") == "STRING")
    plain = keys_of(reply) == F.array(F.lit("findings"))
    return F.coalesce(F.when(monitor, scored).otherwise(plain) & items.isNotNull() & F.forall(items, fine), F.lit(False))


def guard(owner: str) -> Column:
    """The message of the first procedural guard that a pull's state fails, or null.

    Columns: auto_merge, enabled_by, head_sha, event_head, base_ref, default_branch.
    """
    c = F.col
    return (
        F.when(~F.coalesce(c("auto_merge"), F.lit(False)), "enable auto-merge to request the AI gate")
        .when(F.lower(F.coalesce("enabled_by", F.lit(""))) != owner.lower(), f"auto-merge must be enabled by {owner}")
        .when(~c("head_sha").eqNullSafe(c("event_head")), "stale: the PR head moved since this event")
        .when((F.coalesce("default_branch", F.lit("")) == "") | ~c("base_ref").eqNullSafe(c("default_branch")), F.concat(F.lit("the AI gate only reviews PRs into "), F.coalesce("default_branch", F.lit(""))))
    )


def marks(markers: DataFrame, events: DataFrame) -> DataFrame:
    """What verified markers say of each event: change_id, carried, blocked (of this head and change), blocked_head, states.

    markers(change_id, review_id, verdict, head, own_hash, state), events(change_id, event_head, own_hash). A pass carries
    over if the newest marker is one, of the very same change. The markers are
    dealt in tasks that no compression merges, and so is all that is joined by
    the change after.
    """
    joined = events.select("change_id", "event_head", F.col("own_hash").alias("_hash")).join(by_key(markers, "change_id"), "change_id")
    on_head = (F.col("verdict") == "block") & (F.col("head") == F.col("event_head"))
    here = on_head & F.col("own_hash").eqNullSafe(F.col("_hash"))
    newest = F.max_by(F.struct("verdict", "own_hash", "_hash"), "review_id")
    reduced = joined.groupBy("change_id").agg(newest.alias("n"), F.array_sort(F.collect_list(F.when(here, F.col("review_id")))).alias("blocked"), F.count_if(on_head).alias("on_head"), F.array_sort(F.collect_set(F.when(here, F.col("state")))).alias("states"))
    return reduced.select("change_id", ((F.col("n.verdict") == "pass") & F.col("n.own_hash").eqNullSafe(F.col("n._hash"))).alias("carried"), "blocked", (F.col("on_head") > 0).alias("blocked_head"), "states")


def outcomes(events: DataFrame, marked: DataFrame, overridden: DataFrame, always_on: DataFrame, full: DataFrame, owner: str) -> DataFrame:
    """change_id, mode, exit_code, message: what becomes of each event; mode is null where nothing is decided anew.

    events: the columns of `guard` and change_id, action, run_attempt, keyed,
    mergeable (MERGEABLE, CONFLICTING or else), merged_here. marked: as of
    `marks`. overridden(change_id, overridden). always_on and full(change_id,
    block, reasons, infra, infra_reasons): the two ways to decide. The first
    rule that fits ends it.
    """
    joined = events.join(marked, "change_id", "left").join(overridden, "change_id", "left")
    for name, frame in (("on", always_on), ("full", full)):
        joined = joined.join(frame.select("change_id", *[F.col(x).alias(f"{name}_{x}") for x in ("block", "reasons")]), "change_id", "left")
    joined = joined.join(full.select("change_id", "infra", "infra_reasons"), "change_id", "left")
    c = F.col
    pushed, carried = c("action").isin("synchronize", "reopened"), F.coalesce("carried", F.lit(False))
    blocked, cleared = F.coalesce(F.size("blocked") > 0, F.lit(False)), F.coalesce("overridden", F.lit(False))
    retry = "re-run this check or toggle auto-merge"
    config = F.exists("infra_reasons", is_config_error)
    stop = F.coalesce(
        F.when(~c("action").isin(*ACTIONS), "unsupported pull_request_target action"),
        F.when(~F.coalesce(c("event_head").rlike("^[0-9a-f]{40}$"), F.lit(False)), "event has no valid head SHA"),
        F.when(~c("keyed"), "config: the marker key is empty"),
        guard(owner),
        F.when(c("mergeable") == "CONFLICTING", "the PR has conflicts with its base"),
        F.when(~F.coalesce((c("mergeable") == "MERGEABLE") & c("merged_here"), F.lit(False)), f"infra: the test merge is not computed; {retry}"),
        F.when(pushed & ~carried, "the PR was pushed to or reopened after auto-merge was enabled; disable and re-enable auto-merge to re-request review"),
        F.when(~pushed & blocked & ~cleared & F.array_contains("states", "CHANGES_REQUESTED"), f"the gate blocked this commit; {owner} must dismiss its review to override, then re-run this check"),
        F.when(~pushed & blocked & ~cleared & ~F.array_contains("states", "DISMISSED"), "the gate blocked this commit; a comment cannot be dismissed"),
        F.when(~pushed & blocked & ~cleared, "the gate blocked this commit and its dismissal does not count"),
        F.when(~pushed & ~blocked & (c("run_attempt") > 1) & F.coalesce("blocked_head", F.lit(False)), "a verified block of this head is of another base"),
        F.when(~pushed & ~blocked & (c("run_attempt") > 1), "a re-run never asks the model again"),
        F.when(~pushed & ~blocked & (F.coalesce("infra", F.lit("")) != "") & config, F.concat(F.lit("config: the model API rejected the request ("), c("infra"), F.lit(")"))),
        F.when(~pushed & ~blocked & (F.coalesce("infra", F.lit("")) != ""), F.concat(F.lit("infra: model call failed ("), c("infra"), F.lit(f"); {retry}"))),
    )
    mode = F.when(stop.isNull(), F.when(pushed, "carry-over").when(blocked, "owner-override").otherwise("full"))
    block = F.coalesce(F.when(mode == "full", c("full_block")).otherwise(c("on_block")), F.lit(True))
    reasons = F.coalesce(F.when(mode == "full", c("full_reasons")).otherwise(c("on_reasons")), F.lit("not decided"))
    message = F.coalesce(stop, F.when(block, F.concat(F.lit("blocked: "), reasons)).otherwise(F.concat(F.lit("passed ("), mode, F.lit(")"))))
    return joined.select("change_id", mode.alias("mode"), F.when(stop.isNotNull() | block, 1).otherwise(0).alias("exit_code"), message.alias("message"))


def full_decisions(decided: DataFrame, passes: DataFrame, diffs: DataFrame) -> DataFrame:
    """change_id, block, suspicion, reasons, infra, infra_reasons: decisions that also block where a set of passes that was asked for is not whole.

    decided: as of `gate.decided`; diffs(change_id, n_bytes): one that is too large asks no reviewer.
    """
    failed = passes.where("status = 'infra'").groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("name", "reason"))).alias("f"))
    failed = failed.select("change_id", F.array_join(F.transform("f", lambda x: F.concat(x["name"], F.lit(": "), x["reason"])), ", ").alias("infra"), F.transform("f", lambda x: x["reason"]).alias("infra_reasons"))
    joined = diffs.select("change_id", (F.col("n_bytes") <= MODEL_CAP).alias("asked")).join(decided, "change_id", "left").join(complete_passes(passes), "change_id", "left").join(failed, "change_id", "left")
    missing = F.col("asked") & ~F.coalesce("complete", F.lit(False))
    said = F.concat_ws("; ", F.when(F.coalesce("reasons", F.lit("")) != "", F.col("reasons")), F.when(missing, "reviewer passes missing or malformed"))
    return joined.select("change_id", (F.coalesce("block", F.lit(False)) | missing).alias("block"), "suspicion", said.alias("reasons"), F.coalesce("infra", F.lit("")).alias("infra"), F.coalesce("infra_reasons", F.array().cast("array<string>")).alias("infra_reasons"))


def review_bodies(decisions: DataFrame, hits: DataFrame, findings: DataFrame, scrutiny: DataFrame) -> DataFrame:
    """change_id, body: the text that is posted, bounded, with everything of the change's own made plain.

    decisions(change_id, block, reasons array), hits(change_id, ord, rule,
    path, detail, overridable), findings(change_id, ord, category, severity,
    file, source, explanation), scrutiny(change_id, ord, path, reason). Of
    each list HIT_CAP rows are shown; only these are put together.
    """
    none = F.array().cast("array<string>")

    def listed(rows: DataFrame, order: list[Column], line: Column, name: str) -> DataFrame:
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("change_id").orderBy(*order))
        sizes = rows.groupBy("change_id").agg(F.count(F.lit(1)).alias("n"))
        shown = rows.withColumn("place", place).where(F.col("place") <= HIT_CAP).select("change_id", "place", line.alias("line"))
        said = shown.groupBy("change_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines")).join(sizes, "change_id")
        more = F.when(F.col("n") > HIT_CAP, F.array(F.concat(F.lit("- … and "), (F.col("n") - HIT_CAP).cast("string"), F.lit(" more")))).otherwise(none)
        return said.select("change_id", (F.concat("lines", more) if name != "scrutiny" else F.col("lines")).alias(name))

    note = F.when(F.col("overridable"), "").otherwise(" (not clearable by override)")
    hit_line = F.concat(F.lit("- "), F.col("rule"), note, F.lit(": "), neutralised(F.col("path"), 200), F.lit(": "), neutralised(F.col("detail"), 200))
    finding_line = F.concat(F.lit("- "), F.col("severity"), F.lit(" · "), F.col("category"), F.lit(" · "), neutralised(F.col("file"), 200), F.lit(" ("), F.col("source"), F.lit("): "), neutralised(F.col("explanation")))
    scrutiny_line = F.concat(F.lit("- "), neutralised(F.col("path"), 200), F.lit(": "), F.col("reason"))
    joined = decisions
    for rows, order, line, name in (
        (hits, [F.col("ord"), F.col("path"), F.col("detail")], hit_line, "hits"),
        (findings, [severity_rank(F.col("severity")), F.col("ord")], finding_line, "findings"),
        (scrutiny, [F.col("path"), F.col("ord")], scrutiny_line, "scrutiny"),
    ):
        joined = joined.join(listed(rows, order, line, name), "change_id", "left")

    def block(title: str, lines: Column) -> Column:
        return F.when(F.size(F.coalesce(lines, none)) > 0, F.concat(F.array(F.lit(title)), lines)).otherwise(none)

    head = F.array(F.when(F.col("block"), "### AI gate: BLOCKED").otherwise("### AI gate: passed"))
    reasons = F.transform("reasons", lambda x: F.concat(F.lit("- "), x))
    clear = F.when(F.col("block"), F.array(F.lit("**To clear a false alarm:** the owner dismisses this review, then re-runs the failed ai-gate check. Hidden-Unicode, lockfile-host and text-binary hits cannot be cleared that way: fix the change instead."))).otherwise(none)
    parts = F.concat(head, block("**Why it blocks**", reasons), block("**Deterministic checks**", F.col("hits")), block("**Findings** (model-written, untrusted plain text)", F.col("findings")), block("**Extra scrutiny** (not blocking)", F.col("scrutiny")), clear)
    body = F.array_join(parts, "\n\n")
    room = BODY_CAP - MARKER_ROOM - 2
    return joined.select("change_id", F.when(F.length(body) > room, F.concat(F.substring(body, 1, room - 20), F.lit("\n\n… (truncated)"))).otherwise(body).alias("body"))


def review_actions(decided: DataFrame, markers: DataFrame) -> DataFrame:
    """change_id, review_id, action: what is posted for each decision (request-changes or comment), and, of a pass, which earlier blocks are dismissed.

    decided(change_id, mode, exit_code), markers(change_id, review_id, verdict, state). What was decided is worked out once.
    """
    made = written(decided.where("mode is not null").select("change_id", "exit_code"), "decided")
    posts = made.select("change_id", F.lit(None).cast("long").alias("review_id"), F.when(F.col("exit_code") == 1, "request-changes").otherwise("comment").alias("action"))
    old = by_key(markers.where("verdict = 'block' and state = 'CHANGES_REQUESTED'").select("change_id", "review_id"), "change_id").join(made.where("exit_code = 0").select("change_id"), "change_id").select("change_id", "review_id", F.lit("dismiss").alias("action"))
    return posts.unionByName(old)
