"""The review of changes from their diffs to an outcome: files, contents, all checks, the change's hash, decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewall.operators import flow, gate, lockfiles, markers
from sievewall.sources import diffs
from sievewall.tables import written

# Beyond so many bytes a diff is not read at all; what is said then, and of one that does not parse.
READ_CAP = 20_000_000
TOO_LARGE, UNPARSED = "the diff is too large for the gate to read; split the PR", "could not parse the diff; human review needed"
UNREAD = "renamed or copied file too large to read; its content was not checked; human review"


@dataclass
class Gathered:
    """What is known of each change: its files, their added lines, contents at the head and the base, its own hash, its diff's size, why it cannot be read."""

    files: DataFrame
    added: DataFrame
    heads: DataFrame
    bases: DataFrame
    sizes: DataFrame
    failed: DataFrame


def scoped(frame: DataFrame, *columns: str) -> DataFrame:
    """The paths with their change's number as a folder above them, so that equal paths of several changes are told apart."""
    return frame.withColumns({c: F.concat(F.col("change_id").cast("string"), F.lit("/"), c) for c in columns})


def unscoped(hits: DataFrame) -> DataFrame:
    """change_id and path again."""
    cut = F.locate("/", F.col("path"))
    return hits.withColumns({"change_id": F.substring(F.col("path"), F.lit(1), cut - 1).cast("long"), "path": F.substring(F.col("path"), cut + 1, F.length("path"))})


def gathered(changes: DataFrame, contents: DataFrame) -> Gathered:
    """changes(change_id, diff), contents(change_id, side, path, content), side `head` or `base`, with null for what is over the cap.

    A rename without a body is binary if its content has a zero byte early on.
    A diff that is too large or does not parse gives no files.
    """
    sized = changes.select("change_id", F.coalesce(F.octet_length("diff"), F.lit(0)).cast("long").alias("n_bytes"), "diff")
    read = written(diffs.parsed_diffs(sized.where(F.col("n_bytes") <= READ_CAP)), "diffs")
    failed = read.where("error is not null").select("change_id", F.lit(UNPARSED).alias("failure")).unionByName(sized.where(F.col("n_bytes") > READ_CAP).select("change_id", F.lit(TOO_LARGE).alias("failure")))
    heads = contents.where("side = 'head'").select("change_id", "path", "content")
    listed = diffs.changed_files(read)
    joined = listed.join(heads.withColumn("_fetched", F.lit(True)), ["change_id", "path"], "left")
    pure = (F.col("status") == "renamed") & (F.size("body") == 0) & ~F.col("gitlink")
    binary = gate.found_binary(F.col("status"), F.col("binary"), F.col("body"), F.col("gitlink"), F.col("content"))
    digest = F.when((F.col("status") != "deleted") & (binary | pure), F.sha2("content", 256))
    unread = pure & F.col("_fetched") & F.col("content").isNull()
    files = joined.select(*[c for c in listed.columns if c != "binary"], binary.alias("binary"), digest.alias("content_sha256"), F.coalesce(unread, F.lit(False)).alias("unread"))
    files = written(files, "changed-files")
    return Gathered(files, diffs.added_lines(listed), heads, contents.where("side = 'base'").select("change_id", "path", "content"), sized.drop("diff"), failed)


def named_paths(g: Gathered, exceptions: list[str]) -> DataFrame:
    """change_id, path, reason, outcome of paths, old ones too, that change CI or instruct agents."""
    named = g.files.select("change_id", F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path")))).alias("path"))
    return named.join(gate.sensitive_paths(g.files, exceptions).distinct(), "path")


def checked(g: Gathered, exceptions: list[str], extra_hosts: tuple[str, ...] = ()) -> DataFrame:
    """The hits of all seven checks: change_id, ord, rule, path, detail, overridable."""
    files, added = scoped(g.files, "path", "old_path"), scoped(g.added, "path")
    heads, bases = scoped(g.heads, "path"), scoped(g.bases, "path")
    large = flow.too_large(g.sizes).unionByName(g.files.where("unread").select("change_id", "path", F.lit(UNREAD).alias("detail")))
    return flow.all_hits(
        ("hidden-unicode", False, unscoped(gate.hidden_hits(files, added))),
        ("lockfile-host", False, unscoped(lockfiles.lockfile_hits(files, heads, bases, added, extra_hosts))),
        ("binary", True, unscoped(gate.binary_hits(files, heads))),
        ("submodule", True, unscoped(gate.submodule_hits(files))),
        ("sensitive-path", True, named_paths(g, exceptions).where("outcome = 'hit'").select("change_id", "path", F.col("reason").alias("detail"))),
        ("too-large", True, large),
    )


def looked_at(g: Gathered, exceptions: list[str]) -> DataFrame:
    """What wants a closer look and does not block: change_id, path, ord, reason; -1 for a path that an exception covers."""
    longest = g.added.groupBy("change_id", "path").agg(F.max(F.length("text")).alias("longest_line"))
    files = scoped(g.files.join(longest, ["change_id", "path"], "left"), "path")
    covered = named_paths(g, exceptions).where("outcome = 'scrutiny'").select("change_id", "path", F.lit(-1).alias("ord"), "reason")
    return unscoped(gate.scrutiny(files)).select("change_id", "path", "ord", "reason").unionByName(covered)


def decisions(hits: DataFrame, changes: DataFrame) -> DataFrame:
    """change_id, block, reasons of changes by hits alone."""
    rules = hits.groupBy("change_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("deterministic check: "), F.col("rule")))), "; ").alias("reasons"))
    return changes.select("change_id").join(rules, "change_id", "left").select("change_id", F.col("reasons").isNotNull().alias("block"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def reviewed(g: Gathered, events: DataFrame, reviews: DataFrame, timeline: DataFrame, passes: DataFrame, findings: DataFrame, owner: str, key: bytes, exceptions: list[str], threshold: int = 70) -> DataFrame:
    """change_id, mode, exit_code, message: what becomes of each event, from what was gathered of its change.

    events: the columns that `flow.outcomes` asks for but own_hash; reviews
    (change_id, repo, number, review_id, body, state): markers in them count
    if they verify; timeline: as of `gate.owner_overrides`; passes and
    findings: as of `gate.decided`. A change that cannot be read ends there,
    unless its event fails a guard before.
    """
    hits = written(checked(g, exceptions), "hits")
    signed = markers.verified_markers(reviews, key).join(reviews.select("change_id", "review_id", "state"), ["change_id", "review_id"])
    hashed = events.join(markers.changes_hash(g.files), "change_id", "left")
    marked = flow.marks(signed, hashed)
    full = flow.full_decisions(gate.decided(hits, passes, findings, threshold), passes, g.sizes)
    always_on = decisions(hits.where(~F.col("overridable")), events)
    found = flow.outcomes(hashed, marked, gate.owner_overrides(timeline, owner), always_on, full, owner)
    stopped = found.join(g.failed, "change_id", "left").join(events.select("change_id", early_stop(owner).alias("early")), "change_id")
    unread = F.col("failure").isNotNull() & F.col("early").isNull()
    return stopped.select("change_id", F.when(~unread, F.col("mode")).alias("mode"), F.when(unread, 1).otherwise(F.col("exit_code")).alias("exit_code"), F.when(unread, F.col("failure")).otherwise(F.col("message")).alias("message"))


def early_stop(owner: str) -> Column:
    """Not null for an event that ends before its diff is looked at."""
    c = F.col
    ready = F.coalesce((c("mergeable") == "MERGEABLE") & c("merged_here"), F.lit(False))
    wrong = ~c("action").isin(*flow.ACTIONS) | ~F.coalesce(c("event_head").rlike("^[0-9a-f]{40}$"), F.lit(False)) | ~c("keyed") | ~ready
    return F.when(wrong, "not ready").otherwise(flow.guard(owner))
