"""URLs in text as package tools read them, and which of them lead away from allowed hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: a scheme before a colon that is no part of a longer word, what follows it, schemes that need no slashes, and git's user@host:path.
URL = r"(?<![A-Za-z0-9+./-])([A-Za-z][A-Za-z0-9+.-]*):(?=(/*)([^/?#\s\"'`]*))"
KNOWN_SCHEME = r"^(?:[A-Za-z0-9_]+\+)?(?:https?|ftp|wss?|git|ssh)$"
REMOTE = r"(?<![A-Za-z0-9+./@:-])([A-Za-z0-9._-]+)@((?:[A-Za-z0-9][A-Za-z0-9-]*+\.(?=[A-Za-z0-9]))++[A-Za-z][A-Za-z0-9-]*\.?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[^\]/]*\]):(?=[^\s\"'])"
GOOD_SCHEMES = ("https", "git+https", "registry+https", "sparse+https", "git+ssh", "ssh")


def urls_in(text: Column) -> Column:
    """array<struct<scheme, authority>> of every URL; the authority is looked at, not consumed, so a scheme cannot hide the next."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(URL), F.lit(i)).alias(n) for i, n in enumerate(("scheme", "slashes", "authority"), 1)])
    real = F.filter(parts, lambda u: (u["authority"] != "") & (F.lower(u["scheme"]).rlike(KNOWN_SCHEME) | (F.length(u["slashes"]) >= 2)))
    return F.transform(real, lambda u: F.struct(F.lower(u["scheme"]).alias("scheme"), u["authority"].alias("authority")))


def host_of(authority: Column) -> Column:
    """Behind the last @, without port and last dots, lower-cased; an IPv6 host keeps its brackets."""
    host = F.lower(F.substring_index(authority, "@", -1))
    literal = F.regexp_extract(host, r"^\[[^\]]*\]", 0)
    return F.when(host.startswith("["), F.when(literal != "", literal).otherwise(host)).otherwise(F.regexp_replace(F.substring_index(host, ":", 1), r"\.+$", ""))


def bad_urls(text: Column, allowed: Column) -> Column:
    """scheme://host of URLs with an odd scheme, a host that is not allowed, or user data that hides one.

    Tabs and line ends vanish and backslashes are slashes, as URL parsers of
    package tools have it.
    """
    flat = F.translate(F.regexp_replace(text, r"[\t\n\r]", ""), "\\", "/")

    def wrong(u: Column) -> Column:
        git_user = u["scheme"].isin("ssh", "git+ssh") & u["authority"].startswith("git@") & (F.length(F.replace(u["authority"], F.lit("@"))) == F.length(u["authority"]) - 1)
        return ~u["scheme"].isin(*GOOD_SCHEMES) | ~F.array_contains(allowed, host_of(u["authority"])) | (F.contains(u["authority"], F.lit("@")) & ~git_user)

    web = F.transform(F.filter(urls_in(flat), wrong), lambda u: F.concat(u["scheme"], F.lit("://"), host_of(u["authority"])))
    remotes = F.arrays_zip(F.regexp_extract_all(flat, F.lit(REMOTE), F.lit(1)).alias("user"), F.regexp_extract_all(flat, F.lit(REMOTE), F.lit(2)).alias("host"))
    plain = F.transform(remotes, lambda r: F.struct(r["user"].alias("user"), F.regexp_replace(F.lower(r["host"]), r"\.+$", "").alias("host")))
    ssh = F.transform(F.filter(plain, lambda r: (r["user"] != "git") | ~F.array_contains(allowed, r["host"])), lambda r: F.concat(F.lit("ssh://"), r["host"]))
    # Each of the patterns holds a colon; a null stays one.
    return F.when(~F.contains(text, F.lit(":")), F.array().cast("array<string>")).otherwise(F.concat(web, ssh))
