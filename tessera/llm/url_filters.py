"""URL filters by a temporal list join, in DataFrame functions alone.

A list's dated entries (add or remove a host) become intervals of validity: an
entry holds from its date to the next entry of the same list and host. Every
capture is joined as of its fetch date with the entries of its host and of the
host's parent domains; it is blocked if one with the action `add` is active. Of
several, the one for the longest host is reported, then by list name.

Entries of one host and list on one date count as one; a removal then wins.

Defined cases: captures with a null or unreadable URL, or a null date, match
nothing and aren't blocked; entries with a null in any column are left out;
repeated captures give repeated rows; hosts are compared in lower case without a
final dot, port, or user part; very long URLs are read whole, in linear time, and a host
is looked up with as many labels as the list's longest entry has, 127 at most; of
several entries for a host the longest counts, ties go by list name; other columns
pass by; an empty list blocks nothing, no captures give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: `scheme://user@host:port/...` or `//host`; else a bare name with a dot. Brackets hold addresses.
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@]+)"
_BARE = r"^([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\.?)(?:[:/?#].*)?$"
#: Labels that a name of the DNS can have: longer parent domains are no domains.
MOST_LABELS = 127


def host_of(url: Column) -> Column:
    found = F.concat(F.regexp_extract(url, _HOST, 1), F.regexp_extract(url, _BARE, 1))
    host = F.regexp_replace(F.lower(found), r"(?<!\.)\.++$", "")
    return F.when(host != "", host)


def domains_of(host: Column, most: int = MOST_LABELS) -> Column:
    """The host and its parent domains with two labels to `most`, longest first; an
    address has none but itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    first = F.greatest(n - most, F.lit(0))
    address = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\[")
    many = F.transform(F.sequence(first, F.greatest(n - 2, first)), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    return F.when(address, F.array(host)).otherwise(many)


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, host, action (add or remove), date. Gives list, host, since,
    until (exclusive, null where open) of every time an entry was active."""
    clean = entries.select("list", F.regexp_replace(F.lower("host"), r"(?<!\.)\.++$", "").alias("host"), "action", "date")
    clean = clean.where("list is not null and host is not null and action in ('add', 'remove') and date is not null")
    daily = clean.groupBy("list", "host", "date").agg(F.max("action").alias("action"))
    following = Window.partitionBy("list", "host").orderBy("date")
    return (
        daily.withColumn("until", F.lead("date").over(following))
        .where("action = 'add'")
        .select("list", "host", F.col("date").alias("since"), "until")
    )


def match_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: page_id, url, fetched (a date). A row for each row of captures:
    page_id, host, fetched, blocked, list, entry, since.

    Captures meet the list by host and date: what a page of a host is judged by on
    a date is found once for each, and joined back, so that a host with very many
    captures is looked up once a date.
    """
    known = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched").cast("date").alias("fetched"))
    asked = known.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    listed = intervals(entries)
    longest_entry = listed.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    tried = asked.select("host", "fetched", F.explode(domains_of(F.col("host"), min(longest_entry, MOST_LABELS))).alias("entry"))
    active = tried.join(listed.withColumnRenamed("host", "entry"), "entry").where(
        "since <= fetched and (until is null or fetched < until)"
    )
    longest = F.min(F.struct((-F.length("entry")).alias("l"), "list", "entry", "since"))
    found = active.groupBy("host", "fetched").agg(longest.alias("x")).select("host", "fetched", "x.list", "x.entry", "x.since")
    return known.join(found, ["host", "fetched"], "left").select(
        "page_id", "host", "fetched", F.col("entry").isNotNull().alias("blocked"), "list", "entry", "since"
    )
