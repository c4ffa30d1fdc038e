"""Line dedup: repeated runs of lines by a suffix array over line ids, in DataFrame operations only.

A document is a sequence of line ids (64-bit hashes, whose numeric order orders lines).  Prefix
doubling ranks suffixes over the cluster: a suffix's rank through 2h lines comes from the pair
(rank through h at its start, rank through h at h lines on), pairs are range-partitioned and sorted,
and a pair's place in that order is its new rank.  A suffix that is alone under its rank has no
equal and leaves, so rounds shrink.  Suffixes of one rank through h lines are an interval of the suffix array whose
longest common prefix is at least that.  All starts of an interval but the earliest are later copies, and they
are deleted if the interval is ``min_lines`` lines deep, or fewer lines with more than ``min_words`` words in all.  To judge the
words of every shorter depth, ranks deepen by one line; without ``min_words`` they double.  Ranks deeper than ``min_lines`` would only
split intervals that are deleted anyway.  Copies that touch or overlap join to the maximal repeated runs.

Lines are what ``\\n`` separates, compared as they are.  A null text has no lines and stays null; an
empty text is one empty line.  Ties and repeated rows: ``texts.with_keys``; rows listed
twice are one document and get the same text.  Other columns pass through, whatever their names; ``n_chars`` follows the new
text, and with ``counts`` the operator's own counts replace columns of their names.  Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kestrel.llm import texts as T
from kestrel.session import cut_lineage

MIN_LINES, MIN_WORDS = 3, 50
KEY = ["_id", "_copy"]


def line_ids(keyed: DataFrame) -> DataFrame:
    """(_id, _copy, pos, rank, own, words): a row per line; the rank through one line is its id."""
    first = keyed.where("_listing = 1 and _text is not null")
    words = F.regexp_count("_line", F.lit("[^\\x20\\x09-\\x0D]+"))
    return (first.select(*KEY, F.posexplode(F.split("_text", "\n", -1)).alias("pos", "_line"))
            .select(*KEY, "pos", F.xxhash64("_line").alias("rank"), words.alias("own"), words.alias("words")))


def _repeated(suffixes: DataFrame) -> DataFrame:
    """Suffixes whose rank occurs twice or more.

    The counts are a table of their own: joined straight from their shuffle, they would tie all suffixes of a rank
    to one task; so Spark can split a rank that very many suffixes have.
    """
    again = cut_lineage(suffixes.groupBy("rank").count().where("count > 1").select("rank"))
    return suffixes.join(again, "rank", "left_semi").select(*KEY, "pos", "rank", "own", "words")


def _deepen(suffixes: DataFrame, step: int) -> DataFrame:
    """Ranks through ``step`` more lines, of the suffixes that still have an equal; ``words`` is right for a step of one line."""
    ahead = Window.partitionBy(*KEY).orderBy("pos").rangeBetween(step, step)
    pairs = suffixes.withColumns({"next": F.max("rank").over(ahead), "words": F.col("own") + F.max("words").over(ahead)}).where("next is not null")
    found = (pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
             .repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")
             .select(F.col("rank").alias("r"), F.col("next").alias("s"), F.monotonically_increasing_id().alias("deeper")))
    found = cut_lineage(found)
    return (pairs.join(found, (pairs["rank"] == found.r) & (pairs["next"] == found.s))
            .select(*KEY, "pos", F.col("deeper").alias("rank"), "own", "words"))


def _later(suffixes: DataFrame, depth: int) -> DataFrame:
    """(_id, _copy, start, stop): all starts of each interval of equal ranks but the earliest."""
    earliest = cut_lineage(suffixes.groupBy("rank").agg(F.min(F.struct(*KEY, "pos")).alias("first")))  # see _repeated
    return (suffixes.join(earliest, "rank").where(F.struct(*KEY, "pos") != F.col("first"))
            .select(*KEY, F.col("pos").alias("start"), (F.col("pos") + depth).alias("stop")))


def later_copies(lines: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """(_id, _copy, start, stop) of copies, found by deepening ranks to ``min_lines`` lines."""
    suffixes, h, found = cut_lineage(_repeated(lines)), 1, []
    while h < min_lines:
        if min_words is not None:
            found.append(_later(suffixes.where(F.col("words") > min_words), h))
        step = min(h, min_lines - h) if min_words is None else 1
        suffixes = cut_lineage(_deepen(suffixes, step))
        h += step
    out = _later(suffixes, min_lines)
    for f in found:
        out = out.unionByName(f)
    return out


def repeated_runs(keyed: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """(_id, _copy, start, stop): maximal runs of lines that are later copies."""
    later = later_copies(cut_lineage(line_ids(keyed)), min_lines, min_words)
    by_doc = Window.partitionBy(*KEY).orderBy("start")
    apart = F.col("start") > F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("_apart", F.coalesce(apart.cast("int"), F.lit(0)))
    island = F.sum("_apart").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (marked.withColumn("_run", island).groupBy(*KEY, "_run")
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text",
                counts: bool = False, min_words: int | None = MIN_WORDS) -> DataFrame:
    """Documents without later copies of repeated line runs; with ``counts`` also n_lines, n_removed, n_runs."""
    keyed = T.carried(docs, id_col, text_col)
    runs = (repeated_runs(keyed, min_lines, min_words).groupBy(*KEY)
            .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_runs")))
    kept = F.flatten(F.zip_with(F.concat(F.array(F.lit(0)), F.col("_runs.stop")), F.concat(F.col("_runs.start"), F.array(F.size("_lines"))),
                                lambda a, b: F.slice("_lines", a + 1, b - a)))
    joined = keyed.join(runs, KEY, "left").withColumn("_lines", F.split("_text", "\n", -1))
    whole = F.col("_runs").isNull()
    out = joined.withColumn("_new", F.when(whole, F.col("_text")).otherwise(F.array_join(kept, "\n")))
    cols = T.restored(docs)
    cols[text_col] = F.col("_new")
    if "n_chars" in cols:
        cols["n_chars"] = F.when(whole, cols["n_chars"]).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    if counts:
        removed = F.aggregate("_runs", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])
        cols = {c: v for c, v in cols.items() if c not in ("n_lines", "n_removed", "n_runs")} | {
            "n_lines": F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long"),
            "n_removed": F.coalesce(removed, F.lit(0).cast("long")),
            "n_runs": F.when(whole, 0).otherwise(F.size("_runs")).cast("long")}
    return out.select(*(v.alias(c) for c, v in cols.items()))
