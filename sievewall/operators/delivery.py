"""All layers to one verdict, what leaves of it and what is kept apart, and the self test before anything is let through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewall.functions.rendering import wrapped
from sievewall.operators.panels import arbitration, clean_votes, panel_outcome, panel_summary
from sievewall.operators.verdicts import layer_map, screened, without_wrap_tags

LAYERS = "map<string,string>"


def chained_verdicts(docs: DataFrame, panel: DataFrame, honeypot: DataFrame, judges: DataFrame, vendors: int = 2, floor: int = 2) -> DataFrame:
    """doc_id, ok, reason, layers, clean, text: the deterministic layers first, then panel, honeypot and judges, each asked only while none rejects.

    docs(doc_id, text); the rest as of the reductions in `panels`, one row an
    id. A row gives a row: rows that repeat an id share its reductions and keep
    their own text; a row without an id, or whose id a reduction has no row
    for, is rejected by that layer if the layers before let it through. layers
    has what each layer said up to the one that rejects.

    The reductions are joined with each other first, so that texts go through
    one join.
    """
    votes = panel.select("doc_id", F.col("outcome").alias("_outcome"), panel_summary(F.col("outcome"), F.col("verdicts"), vendors, floor).alias("_l2"))
    traps = honeypot.select("doc_id", F.col("reason").alias("_honeypot"))
    bench = judges.select("doc_id", F.col("reason").alias("_judge"))
    route = arbitration(panel, honeypot, judges).select("doc_id", F.col("reason").alias("_route"))
    reductions = votes.join(traps, "doc_id", "full").join(bench, "doc_id", "full").join(route, "doc_id", "full")
    joined = screened(docs.select("doc_id", "text")).join(reductions, "doc_id", "left")
    later = F.coalesce("_route", F.lit("l2_unavailable:missing"))
    reason = F.coalesce("reason", F.when(later != "pass", later), F.lit("pass"))
    asked = F.col("reason").isNull()
    deferred = F.col("_outcome").isin("flagged", "degraded-quota")
    trapped = asked & (deferred | (F.col("_outcome") == "pass"))
    judged = trapped & deferred & ~F.coalesce(F.col("_route").startswith("honeypot:"), F.lit(False))
    said = F.map_from_arrays(F.array(F.lit("l2"), F.lit("honeypot"), F.lit("judge")), F.array(F.when(asked, F.col("_l2")), F.when(trapped, F.col("_honeypot")), F.when(judged, F.col("_judge"))))
    layers = F.map_concat(layer_map(F.col("unicode_reason"), F.col("encoded_reason"), F.col("secret_reason"), F.col("blobs")), F.map_filter(said, lambda _, v: v.isNotNull()))
    return joined.select("doc_id", (reason == "pass").alias("ok"), reason.alias("reason"), layers.alias("layers"), "clean", "text")


def delivered(verdicts: DataFrame, source: str = "scanner") -> DataFrame:
    """doc_id, content of what passed, wrapped; a row without an id has an empty one in its wrap. verdicts: as of `chained_verdicts`."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return verdicts.where("ok").select("doc_id", wrapped(own, without_wrap_tags(F.col("clean")), F.lit(source)).alias("content"))


def quarantined(verdicts: DataFrame, ts: Column | None = None) -> DataFrame:
    """ts, report_id, prompt, verdict, report_text of what was rejected: the only frame that holds its text, for the quarantine sink alone.

    Each rejected row is one row with its own text, whether its id is null or
    repeats: nothing is joined. verdicts: as of `chained_verdicts`.
    """
    when = F.date_format(F.current_timestamp() if ts is None else ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    text = F.coalesce("text", F.lit(""))
    verdict = F.to_json(F.struct("ok", "reason", "layers", F.length("clean").alias("sanitized_text_len")))
    return verdicts.where(~F.col("ok")).select(when.alias("ts"), F.col("doc_id").cast("string").alias("report_id"), F.substring(text, 1, 300).alias("prompt"), verdict.alias("verdict"), text.alias("report_text"))


def append_quarantine(rows: DataFrame, path: str) -> None:
    """Appends rejections to the quarantine folder as lines of JSON."""
    rows.write.mode("append").json(path)


def write_new(rows: DataFrame, path: str) -> None:
    """Writes rows as lines of JSON where nothing is yet; an existing folder is an error."""
    rows.write.mode("errorifexists").json(path)


def error_verdicts(failures: DataFrame) -> DataFrame:
    """doc_id, ok, reason, layers, clean, text for documents whose scan itself failed: rejected, and only the error's type is told. failures(doc_id, error)."""
    kind = F.when(F.col("error").rlike("^[A-Za-z_][A-Za-z0-9_]{0,63}$"), F.col("error")).otherwise("other")
    return failures.select("doc_id", F.lit(False).alias("ok"), F.concat(F.lit("scanner_error:"), kind).alias("reason"), F.create_map(F.lit("scanner_error"), kind).alias("layers"), F.lit("").alias("clean"), F.lit(None).cast("string").alias("text"))


def self_test(canaries: DataFrame, scan: Callable[[DataFrame], DataFrame] = screened) -> DataFrame:
    """label, failure of every canary that is not blocked, or not by the detector that should. canaries(label, text, expected).

    scan: from a frame with text to one with reason, null or `pass` for what passes.
    """
    judged = scan(canaries).select("label", "expected", F.coalesce("reason", F.lit("pass")).alias("reason"))
    failure = F.when(F.col("reason") == "pass", "payload passed (expected block)").when(~F.contains("reason", F.col("expected")), F.concat(F.lit("blocked but wrong layer ("), F.col("reason"), F.lit(")")))
    return judged.select("label", failure.alias("failure")).where("failure is not null")


def first_unready(readiness: DataFrame, floor: int) -> DataFrame:
    """layer, reason of each layer that is not ready: for the panel if fewer vendors than the floor are, for others if any member is not.

    readiness(layer, member, ord, reason), with a null reason for what is
    ready; the first member in order that is not gives the reason.
    """
    reduced = readiness.groupBy("layer").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("ord", "reason")))["reason"].alias("reason"), F.count_if(F.col("reason").isNull()).alias("ready"), F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(1), F.least(F.lit(floor), F.col("n")))
    return reduced.where(F.col("reason").isNotNull() & ((F.col("layer") != "l2") | (F.col("ready") < least))).select("layer", "reason")


#: A vendor: from documents (doc_id, text) to its votes (doc_id, ok, flagged, reason).
Vendor = Callable[[DataFrame], DataFrame]


class VendorPanel:
    """A registry of vendors by name, in the order in which they were added, and the panel that they make."""

    def __init__(self, floor: int = 2):
        self.vendors: dict[str, Vendor] = {}
        self.probes: dict[str, Vendor | None] = {}
        self.wanted = floor

    def add(self, name: str, votes: Vendor, ready: Vendor | None = None) -> VendorPanel:
        """ready: from probes to the vendor's votes on them, which a ready vendor passes; without it the vendor votes on the probes itself."""
        if name in self.vendors:
            raise ValueError(f"vendor {name!r} is there already")
        self.vendors[name], self.probes[name] = votes, ready
        return self

    def readiness(self, probes: DataFrame) -> DataFrame:
        """layer, member, ord, reason of every vendor, as `first_unready` takes them: why a benign probe did not pass, or null. probes(doc_id, text)."""
        asked = VendorPanel(self.wanted)
        for name, votes in self.vendors.items():
            asked.add(name, self.probes[name] or votes)
        votes = clean_votes(asked.votes(probes))
        failed = F.min(F.when(F.col("kind") != "pass", F.struct("doc_id", "reason")))["reason"]
        return votes.groupBy("vendor", "vendor_ord").agg(failed.alias("reason")).select(F.lit("l2").alias("layer"), F.col("vendor").alias("member"), F.col("vendor_ord").alias("ord"), "reason")

    @property
    def floor(self) -> int:
        """The floor between one and as many vendors as there are."""
        return max(1, min(self.wanted, len(self.vendors)))

    def votes(self, docs: DataFrame) -> DataFrame:
        """doc_id, vendor, vendor_ord, ok, flagged, reason of every vendor for every document; a vendor without a row for one gave a bad result."""
        whole = None
        for place, (name, vendor) in enumerate(self.vendors.items()):
            own = docs.select("doc_id").join(vendor(docs).select("doc_id", "ok", "flagged", "reason"), "doc_id", "left")
            own = own.select("doc_id", F.lit(name).alias("vendor"), F.lit(place).alias("vendor_ord"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("reason", F.lit(f"{name}_unavailable:bad-result")).alias("reason"))
            whole = own if whole is None else whole.unionByName(own)
        if whole is None:
            raise ValueError("a panel needs a vendor")
        return whole

    def outcome(self, docs: DataFrame) -> DataFrame:
        return panel_outcome(self.votes(docs), self.floor)


def scorecard_text(card: DataFrame) -> DataFrame:
    """line of a report on one row of `evaluation.scorecard`."""
    rates = F.format_string("cases=%d  precision=%.3f  recall=%.3f  F1=%.3f  accuracy=%.3f  FP-rate=%.3f", F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"), "precision", "recall", "f1", "accuracy", "fp_rate")
    counts = F.format_string("confusion: TP=%d FN=%d FP=%d TN=%d  (positive class = 'block')", "tp", "fn", "fp", "tn")
    return card.select(F.explode(F.array(F.lit("SCANNER EVALUATION SCORECARD"), rates, counts)).alias("line"))
