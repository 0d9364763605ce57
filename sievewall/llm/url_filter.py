"""URL verdicts: fixed host and path rules first, mined association rules for the rest."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Fixed rules: verdict, host, path prefix.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a parent of it and the path's start, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        best = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels with their place from the right, path segments with their place, query keys, fragment."""
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    labels = F.transform(F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != ""), lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    fragment = F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("scheme="), scheme)), labels, segments, keys, fragment))


def alike_tokens(labelled: DataFrame, least: int) -> list[list[str]]:
    """Frequent tokens, those that occur in the very same rows together, by how much they tell about the verdict.

    Rows are told apart by two 64-bit sums of hashes. There are at most as
    many frequent tokens as a URL has on average, over the support.
    """
    rows = labelled.select(F.explode("tokens").alias("token"), F.shiftright(F.xxhash64("tokens", "verdict"), 24).alias("a"), F.shiftright(F.xxhash64("verdict", "tokens", F.lit(1)), 24).alias("b"), (F.col("verdict") == "block").cast("int").alias("block"))
    tokens = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("block").alias("block")).where(F.col("n") >= least)
    share = labelled.agg(F.avg((F.col("verdict") == "block").cast("int"))).first()[0]
    telling = -F.abs(F.col("block") - F.col("n") * F.lit(share)) / F.sqrt("n")
    return [r.tokens for r in tokens.groupBy("n", "a", "b", "block").agg(F.sort_array(F.collect_list("token")).alias("tokens")).orderBy(telling, F.col("tokens")[0]).collect()]


def in_bunches(labelled: DataFrame, tokens: list[str], longest: int, bunch_items: int) -> DataFrame:
    """items: each labelled row's tokens once for every bunch, with its verdict, all marked with the bunch.

    Tokens are dealt to groups so that `longest` groups hold about
    `bunch_items` of a row's; a bunch is a choice of `longest` groups. Each set
    of up to `longest` tokens is whole in some bunch, and a bunch has one row
    for each labelled row: supports counted in it are those of the uncut rows.
    """
    numbered = F.create_map(*[x for i, t in enumerate(tokens) for x in (F.lit(t), F.lit(i))]) if tokens else F.lit(None).cast("map<string,int>")
    frequent = F.filter(F.transform("tokens", lambda t: F.struct(t.alias("token"), F.try_element_at(numbered, t).alias("n"))), lambda x: x["n"].isNotNull())
    rows = labelled.select("verdict", frequent.alias("tokens"))
    most = rows.agg(F.max(F.size("tokens"))).first()[0] or 0
    if most <= bunch_items:
        return rows.select(F.array_append(F.transform("tokens", lambda x: F.concat(F.lit("|"), x["token"])), F.concat(F.lit("|verdict="), "verdict")).alias("items"))
    groups = math.ceil(longest * most / bunch_items)
    for k in range(longest):
        first = F.lit(0) if k == 0 else F.col(f"g{k - 1}") + 1
        rows = rows.withColumn(f"g{k}", F.explode(F.sequence(first, F.lit(groups - longest + k))))
    chosen = [F.col(f"g{k}") for k in range(longest)]
    mark = F.concat_ws(".", *[c.cast("string") for c in chosen])
    own = F.filter("tokens", lambda x: (x["n"] % groups).isin(*chosen))
    return rows.select(F.array_append(F.transform(own, lambda x: F.concat(mark, F.lit("|"), x["token"])), F.concat(mark, F.lit("|verdict="), "verdict")).alias("items"))


def mined_rules(labelled: DataFrame, min_support: float, min_confidence: float, longest: int, bunch_items: int = 12) -> DataFrame:
    """Association rules antecedent -> verdict from labelled token sets: rule_id, items, verdict, confidence, support.

    Spark's FP-growth finds the frequent sets; every rule of at most `longest`
    tokens whose support and confidence reach the bounds is found, and its
    figures are those of the whole sets. A rule that a shorter one of the same
    verdict and no less confidence implies is pruned.

    Frequent sets of any size grow with the power of a URL's frequent tokens,
    those of `longest` tokens with a power of `longest` only. Tokens that
    always come together are mined as one, which loses nothing (a rule with one
    of them holds with each other); rows with more frequent tokens than
    `bunch_items` are mined in bunches of about so many, which together hold
    every set of up to `longest` (`in_bunches`).
    """
    n = labelled.count()
    least = max(1, math.ceil(min_support * n))
    groups = alike_tokens(labelled, least)
    bunches = written(in_bunches(labelled, [g[0] for g in groups], longest, bunch_items), "url-bunches")
    rows = bunches.count()
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows, minConfidence=min_confidence).fit(bunches)
    found = model.associationRules.where(F.substring_index(F.col("consequent")[0], "|", -1).startswith("verdict=") & (F.size("antecedent") <= longest))
    plain = found.select(F.array_sort(F.transform("antecedent", lambda x: F.substring(x, F.locate("|", x) + 1, F.length(x)))).alias("antecedent"), F.substring_index(F.col("consequent")[0], "verdict=", -1).alias("verdict"), "confidence", (F.round(F.col("support") * rows) / n).alias("support"))
    mined = plain.groupBy("antecedent", "verdict").agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"))
    several = [v for g in groups if len(g) > 1 for v in (F.lit(g[0]), F.array(*[F.lit(x) for x in g]))]
    of = (lambda x: F.coalesce(F.try_element_at(F.create_map(*several), x), F.array(x))) if several else F.array
    mined = mined.withColumn("items", F.array().cast("array<string>"))
    for i in range(longest):
        choices = F.when(F.size("antecedent") > i, of(F.try_element_at("antecedent", F.lit(i + 1)))).otherwise(F.array(F.lit(None).cast("string")))
        mined = mined.withColumn("_item", F.explode(choices)).withColumn("items", F.array_compact(F.array_append("items", F.col("_item")))).drop("_item")
    rules = mined.select(
        F.array_sort("items").alias("items"),
        "verdict",
        "confidence",
        "support",
    ).withColumn("rule_id", F.array_join("items", "\n"))
    rules = written(rules, "url-rules")
    shorter = rules.select(F.col("rule_id").alias("_id"), F.col("items").alias("_items"), F.col("verdict").alias("_verdict"), F.col("confidence").alias("_confidence"))
    parts = rules.withColumn("part", F.explode("items"))
    implied = (
        parts.join(shorter.withColumn("part", F.explode("_items")), "part")
        .where((F.col("_verdict") == F.col("verdict")) & (F.col("_confidence") >= F.col("confidence")) & (F.size("_items") < F.size("items")))
        .groupBy("rule_id", "verdict", "_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_items")).alias("of"))
        .where("n = of")
    )
    return rules.join(implied.select("rule_id", "verdict").distinct(), ["rule_id", "verdict"], "left_anti")


def matched_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The verdict of the best rule all of whose items a URL has: url, mined_verdict.

    An inverted index from item to rule finds the rules that a URL's tokens
    touch; a rule fires when it is touched as often as it has items. The most
    confident wins, then the best supported, then the longest, then by items,
    then block before allow.
    """
    index = rules.select(F.explode("items").alias("token"), "rule_id", F.size("items").alias("of"), "verdict", "confidence", "support")
    touched = urls.select("url", F.explode("tokens").alias("token")).join(index, "token")
    fired = touched.groupBy("url", "rule_id", "verdict", "of", "confidence", "support").agg(F.count(F.lit(1)).alias("n")).where("n = of")
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), -F.col("of"), F.col("rule_id"), F.col("verdict") != "block", F.col("verdict").alias("verdict")))
    return fired.groupBy("url").agg(best.alias("best")).select("url", F.col("best.verdict").alias("mined_verdict"))


def judged_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES, min_support: float = 0.02, min_confidence: float = 0.75, longest: int = 3, bunch_items: int = 12, default: str = "allow") -> DataFrame:
    """A verdict for every page's URL: page_id, host, path, rule, verdict.

    URLs that a fixed rule fits take its verdict; they also are the labelled
    transactions from which FP-growth mines combinations of tokens. Each other
    URL takes the verdict of its best mined rule, or `default` where none
    fires. Null URLs, and those without ://, have empty host and path and no
    rule, and no tokens: they take the default. Rows repeat as they come; an
    empty table gives no rows, and one without labelled rows mines none.
    Other columns are not read.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    parts = source.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    ruled = written(parts.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", F.when(F.col("fixed").isNotNull() | (F.col("host") != ""), tokens)), "url-parts")
    labelled = ruled.where("fixed is not null").select("tokens", F.col("fixed.verdict").alias("verdict"))
    open_urls = ruled.where("fixed is null and host <> ''").select("url", "tokens").dropDuplicates(["url"])
    settled = ruled.where("fixed is not null").select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.col("fixed.verdict").alias("verdict"))
    rest = ruled.where("fixed is null").select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"))
    if labelled.isEmpty():
        return settled.unionByName(rest.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict")))
    found = matched_verdicts(open_urls, mined_rules(labelled, min_support, min_confidence, longest, bunch_items))
    judged = rest.join(found, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("mined_verdict", F.lit(default)).alias("verdict"))
    return settled.unionByName(judged)
