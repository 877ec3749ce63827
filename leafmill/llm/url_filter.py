r"""URL filters by a temporal list join, in Spark expressions only.

Dated list entries (domain, verdict, listed_on) become validity intervals: an entry holds from
its day until the domain's next entry. A capture is judged as of the day it was fetched: of
the entries active then for its host or a parent domain of two labels and more, the most
specific decides. Captures are first reduced to distinct (host, day) pairs, so a host with
a third of all captures meets the list once a day.

Defined cases: a null or hostless URL has a null host, matches nothing and is kept; a capture
without a day matches nothing; entries without domain, verdict or day are left out; of several
entries of one domain and day the last verdict by name holds ("block" after "allow"); repeated
captures are judged alike; an empty list or table is an ordinary case; further columns of the
captures come along in ``_row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The scheme and the authority of a URL: schemes of the web take any number of slashes, others two. What a browser
#: strips: white space and controls at the ends, tabs and line ends anywhere. Characters that it reads as dots.
AUTHORITY = r"^(?:(?:https?|wss?|ftp):[/\\]*|[a-z][a-z0-9+.\-]*:[/\\]{2})([^/?#\\]*)"
ENDS, ANYWHERE = r"^[\x00-\x20]+|[\x00-\x20]+$", r"[\t\n\r]"
DOTS = "\u3002\uff0e\uff61"
NUMBER = r"(?:0x[0-9a-f]{0,8}|[0-9]{1,11})"


def _address(host: Column) -> Column:
    """An address whose one to four parts are decimal, octal or hexadecimal numbers, as four decimal ones; null if it is none."""

    def value(part: Column) -> Column:
        digits = F.when(part.startswith("0x"), F.conv(F.concat(F.lit("0"), F.substr(part, F.lit(3))), 16, 10)).when(part.rlike("^0[0-7]*$"), F.conv(part, 8, 10)).when(part.rlike("^[1-9][0-9]*$"), part)
        return digits.cast("long")

    def dotted(v: Column) -> Column:
        n = F.size(v)
        last = F.element_at(v, -1)
        fits = F.forall(F.slice(v, F.lit(1), n - 1), lambda x: x <= 255) & (last < F.pow(F.lit(256), 5 - n))
        byte = lambda k: F.when(F.lit(k) < n - 1, F.get(v, F.lit(k))).otherwise(F.floor(last / F.lit(256 ** (3 - k))) % 256).cast("long").cast("string")
        return F.when(fits, F.concat_ws(".", *[byte(k) for k in range(4)]))

    return F.when(host.rlike(rf"^{NUMBER}(?:\.{NUMBER}){{0,3}}$"), F.get(F.transform(F.array(F.transform(F.split(host, r"\."), value)), dotted), F.lit(0)))


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL as a browser reads it, without user, port and final dots, or null.

    A user part ends at the last @; a backslash ends the host like a slash; escapes are read, wide dots are dots, and
    numbers that are an address are written as one."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(url), ENDS, ""), ANYWHERE, "")
    place = F.substring_index(F.regexp_extract(clean, AUTHORITY, 1), "@", -1)
    name = F.substring_index(place, ":", 1)
    read = F.when(name.contains("%"), F.lower(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name))).otherwise(name)
    plain = F.regexp_replace(F.translate(read, DOTS, "..."), r"\.+$", "")
    host = F.when(place.startswith("["), F.regexp_extract(place, r"^(\[[^\]]*\])", 1)).otherwise(F.coalesce(_address(plain), plain))
    return F.nullif(host, F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels and more; an address stands for itself only."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    cut = lambda i: F.array_join(F.slice(labels, i + 1, n), ".")
    address = host.startswith("[") | host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    return F.when(address, F.array(host)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), cut))


def validity(entries: DataFrame) -> DataFrame:
    """domain, verdict, valid_from, valid_to (exclusive; null: still active)."""
    e = entries.where("domain is not null and verdict is not null and listed_on is not null")
    e = e.groupBy("domain", "listed_on").agg(F.max("verdict").alias("verdict"))
    until = F.lead("listed_on").over(Window.partitionBy("domain").orderBy("listed_on"))
    return e.select("domain", "verdict", F.col("listed_on").alias("valid_from"), until.alias("valid_to"))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures`` (url, fetched) as ``_row`` with host, fetched, rule, verdict, kept.

    Only domains that the list holds are asked for, so a hosting domain gathers its hosts only where
    it is listed; its side of the join can be split, and the best entry is found per (host, day)."""
    rows = captures.select(F.struct("*").alias("_row"), host_of(F.col("url")).alias("host"), "fetched")
    asked = rows.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    asked = asked.select("host", "fetched", F.explode(domains_of(F.col("host"))).alias("_domain"))
    active = (F.col("_domain") == F.col("domain")) & (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    most = F.max(F.struct(F.length("domain").alias("size"), F.col("domain"), F.col("verdict")))
    found = asked.join(validity(entries), active).groupBy("host", "fetched").agg(most.alias("m"))
    found = found.select(F.col("host").alias("_host"), F.col("fetched").alias("_on"), F.col("m.domain").alias("rule"), F.col("m.verdict").alias("_verdict"))
    out = rows.join(found, (F.col("host") == F.col("_host")) & (F.col("fetched") == F.col("_on")), "left")
    verdict = F.coalesce("_verdict", F.lit("none"))
    return out.select("_row", "host", "fetched", "rule", verdict.alias("verdict"), (verdict != "block").alias("kept"))


def dated_list(hosts: DataFrame) -> DataFrame:
    """A list made by rule for tables that come without one: from the digest of each host and
    of its registered domain follow the days in 2024 on which it was blocked and allowed."""
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    # A host stands for itself and, under another number, for its registered domain.
    both = F.array(F.struct(F.col("host").alias("domain"), F.lit(0).alias("more")), F.struct(F.element_at(domains_of(F.col("host")), -1).alias("domain"), F.lit(1).alias("more")))
    n = hosts.where("host is not null").select("host").distinct().select(F.explode(both).alias("d")).select("d.*").distinct()
    n = n.select("domain", (number(F.col("domain")) + F.col("more")).alias("k"))
    entry = lambda every, verdict, on: F.when(F.col("k") % every == 0, F.struct(F.lit(verdict).alias("verdict"), day(on).alias("listed_on")))
    k = F.col("k")
    entries = F.array(entry(3, "block", k % 200), entry(6, "allow", k % 200 + 60), entry(5, "allow", k % 100), entry(10, "block", k % 100 + 150))
    return n.select("domain", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("domain", "e.*")
