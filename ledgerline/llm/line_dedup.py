"""Line dedup: later copies of repeated line runs are deleted.

The corpus is read as sequences of line ids.  Prefix doubling ranks its suffixes by their first
1, 2, 4, ... lines: rank k+1 of a position orders the pairs of the ranks k at the position and
2^k lines on, found by a distributed sort of the distinct pairs.  Positions whose rank is unique
have no repeated run of that length and leave the doubling.  The suffixes that share a run are an
interval of the suffix array, all with a common prefix of at least the run's length (an LCP interval);
the ranks at the run's head and tail, which overlap, tell intervals apart for runs of any length.

A line is deleted if it stands in a run of lines with at least `min_words` words that occurs
before, by (doc_id, line number).  Every such maximal run is a union of its tightest sub-runs that
still hold `min_words` words, and those are what is named: from each line the shortest run onward
and the shortest run backward.  Names, ranks and lookups are DataFrame operations throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_groups, save, spread_join

KEY = ["doc_id", "version"]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, line, a, b, words): one row a line, its text as two 64-bit hashes."""
    text = docs.filter("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line", "s")
    )
    words = F.when(F.trim("s") == "", 0).otherwise(F.size(F.split(F.trim("s"), r"\s+")))
    return text.select(*KEY, "line", F.xxhash64("s").alias("a"), F.xxhash64(F.lit(1), "s").alias("b"), words.alias("words"))


def _ranked(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Number rows in sorted order; ids rise through the sorted partitions."""
    return distinct.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())


def _by_group(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose group has several, with the group's rank."""
    groups = save(rows.groupBy(*by).count().filter("count > 1"), "groups")
    return spread_join(rows, _ranked(groups.select(*by), by), by, hot_keys(groups, by))


def _doubled(level: DataFrame, k: int) -> DataFrame:
    """Ranks by 2^(k+1) lines from those by 2^k: positions whose longer run is repeated."""
    step = 1 << k
    after = Window.partitionBy(*KEY).orderBy("line").rangeBetween(step, step)
    pairs = level.withColumn("next", F.max("rank").over(after)).filter("next is not null").withColumnRenamed("rank", "first")
    return _by_group(pairs, ["first", "next"]).select(*KEY, "line", "rank")


def _tight_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, start, stop): shortest runs of min_words words from and up to each line.

    `lines` holds repeated lines only; a run crosses no gap.  Starts and stops meet in one ordering by
    the words before them: a search of each by a running extreme.
    """
    order = Window.partitionBy(*KEY).orderBy("line")
    island = (F.col("line") - F.row_number().over(order)).alias("island")
    rows = lines.select(*KEY, "line", "words", island)
    upto = F.sum("words").over(Window.partitionBy(*KEY, "island").orderBy("line"))
    rows = rows.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))

    def kind(key: Column, at: int, start: Column, stop: Column) -> DataFrame:
        return rows.select(*KEY, "island", key.alias("key"), F.lit(at).alias("at"), start.alias("start"), stop.alias("stop"))

    none = F.lit(None).cast("int")
    line = F.col("line")
    onward = kind(F.col("upto"), 0, none, line).unionByName(kind(F.col("before") + min_words, 1, line, none))
    w = Window.partitionBy(*KEY, "island").orderBy(F.desc("key"), "at").rowsBetween(Window.unboundedPreceding, 0)
    onward = onward.withColumn("found", F.min("stop").over(w)).filter("at = 1 and found is not null")
    backward = kind(F.col("before"), 0, line, none).unionByName(kind(F.col("upto") - min_words, 1, none, line))
    w = Window.partitionBy(*KEY, "island").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, 0)
    backward = backward.withColumn("found", F.max("start").over(w)).filter("at = 1 and found is not null")
    return (
        onward.select(*KEY, "start", F.col("found").alias("stop"))
        .unionByName(backward.select(*KEY, F.col("found").alias("start"), "stop"))
        .distinct()
    )


def deleted_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, version, line) of every line of docs(doc_id, text) that is a later copy.

    `version` is the hash of the document's text: rows with equal doc_id and text count as one
    document, with equal doc_id and other text as further ones.  Rows without doc_id or text have
    no lines.  Texts are split at newlines; lines are equal if their characters are.
    """
    lines = save(_lines(docs), "lines")
    repeated = _by_group(lines, ["a", "b"]).select(*KEY, "line", "words", "rank").distinct()
    repeated = save(repeated, "repeated")
    runs = save(_tight_runs(repeated, min_words), "runs")
    longest = runs.agg(F.max(F.col("stop") - F.col("start") + 1)).first()[0] or 0
    level = repeated.select(*KEY, "line", "rank")
    ranks = level.withColumn("level", F.lit(0))
    for k in range(max(0, longest.bit_length() - 1)):
        level = save(_doubled(level, k), f"ranks{k + 1}")
        ranks = ranks.unionByName(level.withColumn("level", F.lit(k + 1)))
    length = F.col("stop") - F.col("start") + 1
    runs = runs.withColumn("length", length).withColumn("level", F.floor(F.log2("length") + 1e-9).cast("int"))
    runs = runs.withColumn("tail", (F.col("stop") - F.expr("shiftleft(1, level)") + 1))
    head = ranks.select(*KEY, F.col("line").alias("start"), "level", F.col("rank").alias("head_rank"))
    tail = ranks.select(*KEY, F.col("line").alias("tail"), "level", F.col("rank").alias("tail_rank"))
    interval, at = ["length", "head_rank", "tail_rank"], F.struct(*KEY, "start")
    members = runs.join(head, [*KEY, "start", "level"]).join(tail, [*KEY, "tail", "level"])
    members = save(members.select(*KEY, "start", "stop", *interval), "members")
    intervals = members.groupBy(*interval).agg(F.min(at).alias("first"), F.count("*").alias("count")).filter("count > 1")
    later = join_groups(members, save(intervals, "intervals"), interval).filter(at > F.col("first"))
    later = later.select(*KEY, F.col("start").alias("line"), "stop")
    marks = repeated.select(*KEY, "line", F.lit(None).cast("int").alias("stop")).unionByName(later)
    reach = F.max("stop").over(Window.partitionBy(*KEY).orderBy("line").rangeBetween(Window.unboundedPreceding, 0))
    return marks.withColumn("reach", reach).filter("stop is null and reach >= line").select(*KEY, "line")


def dedup(docs: DataFrame, min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """docs with later copies of repeated runs cut from `text`, and two counts in front.

    `counts` names the number of lines and of deleted ones; columns of docs with these names give way to them.
    Every row and other column stays; a text that is all later copies becomes empty.
    """
    gone = deleted_lines(docs, min_words).groupBy(*KEY).agg(F.collect_list("line").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), "__gone")
    both = docs.join(gone, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__version")), "left")
    split = F.split("text", "\n")

    def cut(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # as the element of an array the split lines are made once a text, not once a line
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(split), cut), F.lit(0)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    return both.select(
        n_lines.alias(counts[0]),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(counts[1]),
        *(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in counts),
    )
