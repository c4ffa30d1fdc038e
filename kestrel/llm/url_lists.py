"""URL filters: dated list entries, as validity intervals, joined as of every capture's fetch time.

A list entry says that from a moment on a domain is in a state: ``block``, ``allow`` or ``off``.  The
entry holds until the next one for the same domain.  A capture is judged by the entries active at its
fetch time for its host and the domains above it (two labels at least); the longest such domain decides.
A date stands for its first moment.

The as-of join never meets captures with all intervals of a domain: captures are first reduced to
different (host, day) pairs, so that a host with a third of all captures is as many rows as it has
days, and one ordered window per domain carries the last entry forward to every day asked for.  A day's own entries for the domain
come along, and a capture takes the last one of them that is not later than itself.

Two entries for one domain and moment: block goes before allow, allow before off.  Entries with a null
or an unknown state are ignored.  A null or malformed URL, and a null time, are judged ``pass``, as is a
capture without an active entry.  Every capture row, repeated or not, gets one result row with all its columns
(one named like a result column is replaced).  Empty tables give empty results, or ``pass``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANK = {"off": 1, "allow": 2, "block": 3}


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; '' if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def domains(host: Column) -> Column:
    """The host and the domains above it, down to two labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))).otherwise(F.array().cast("array<string>"))


def _rank(state: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in RANK.items():
        out = F.when(state == name, r).otherwise(out)
    return out


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, rank, valid_from, valid_to): timestamps, the last is left out, null is open."""
    known = (entries.select(F.lower("domain").alias("domain"), F.col("listed_on").cast("timestamp").alias("valid_from"), _rank(F.col("state")).alias("rank"))
             .where("domain is not null and valid_from is not null and rank is not null"))
    one = known.groupBy("domain", "valid_from").agg(F.max("rank").alias("rank"))
    after = Window.partitionBy("domain").orderBy("valid_from")
    return one.withColumn("valid_to", F.lead("valid_from").over(after))


def choices(asked: DataFrame, valid: DataFrame) -> DataFrame:
    """(_host, _day, _choices): the domains of different (_host, _day) pairs, longest first, each with its entry at the day's
    beginning, if any, and the entries of the day."""
    by_domain = asked.select("_host", "_day", F.explode(domains(F.col("_host"))).alias("domain"))
    days = by_domain.select("domain", "_day").distinct()
    entry = "struct<valid_from:timestamp,rank:int,valid_to:timestamp>"
    spans = valid.select("domain", F.to_date("valid_from").alias("day"), F.struct("valid_from", "rank", "valid_to").alias("entry"))
    # a day comes before its own entries, so it sees the last one of the days before, if that is still open
    stream = (days.select("domain", F.col("_day").alias("day"), F.lit(0).alias("entered"), F.lit(None).cast(entry).alias("entry"))
              .unionByName(spans.select("domain", "day", F.lit(1).alias("entered"), "entry")))
    so_far = Window.partitionBy("domain").orderBy("day", "entered", "entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = stream.withColumn("entry", F.last("entry", ignorenulls=True).over(so_far)).where("entered = 0").select("domain", F.col("day").alias("_day"), F.col("entry").alias("_before"))
    today = spans.groupBy("domain", F.col("day").alias("_day")).agg(F.array_sort(F.collect_list("entry")).alias("_today"))
    held = before.join(today, ["domain", "_day"], "left").select("domain", "_day", F.concat(
        F.when(F.col("_before").isNull(), F.array().cast(f"array<{entry}>")).otherwise(F.array("_before")), F.coalesce("_today", F.array().cast(f"array<{entry}>"))).alias("spans"))
    one = F.struct((-F.length("domain")).alias("n"), "domain", "spans")
    return by_domain.join(held.where("size(spans) > 0"), ["domain", "_day"]).groupBy("_host", "_day").agg(F.sort_array(F.collect_list(one)).alias("_choices"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched_on") -> DataFrame:
    """``captures`` with host, verdict (block, allow or pass), the domain that decides and since when (a date if the entries have dates)."""
    keep = [c for c in captures.columns if c not in ("host", "verdict", "matched", "since")]
    marked = captures.select(*keep, host_of(F.col(url_col)).alias("_host"), F.col(fetched_col).cast("timestamp").alias("_at")).withColumn("_day", F.to_date("_at"))
    asked = marked.select("_host", "_day").where("_host != '' and _day is not null").distinct()
    joined = marked.join(choices(asked, intervals(entries)), ["_host", "_day"], "left")

    def active(choice: Column) -> Column:
        past = F.filter(choice["spans"], lambda s: s["valid_from"] <= F.col("_at"))
        return F.struct(choice["domain"].alias("domain"), F.get(past, F.size(past) - 1).alias("entry"))

    found = F.get(F.filter(F.transform("_choices", active), lambda c: c["entry"]["rank"] > 1), F.lit(0))
    kind = "date" if entries.schema["listed_on"].dataType.typeName() == "date" else "timestamp"
    rank = F.col("_found.entry.rank")
    return joined.withColumn("_found", found).select(
        *keep, F.col("_host").alias("host"), F.when(rank == 3, "block").when(rank == 2, "allow").otherwise("pass").alias("verdict"),
        F.col("_found.domain").alias("matched"), F.col("_found.entry.valid_from").cast(kind).alias("since"))
