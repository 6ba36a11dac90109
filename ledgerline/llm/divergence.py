"""Source divergence audit: how far the word use of a language's sources lies apart.

Identical texts of a language are collapsed first: one text with its number of copies by source.
Each is tokenized once, and its terms' counts and document frequencies are added with the
multiplicities.  Term shares are integers, so that all sums are exact.

Pairs of sources are evaluated sparsely.  With p0 the share of a term that a source lacks,

    sum over V terms f(p, q) = V f(p0, q0) + sum over a's terms [f(p, q0) - f(p0, q0)]
        + sum over b's terms [f(p0, q) - f(p0, q0)]
        + sum over common terms [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)],

where the single sums need only the number of terms with each count, and the last one goes term by
term over the sources that have it, added up within tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import by_bytes, save

#: Groups of identical texts up to which they are broadcast with their multiplicities; beyond, texts are shuffled by digest.
MAX_BROADCAST_TEXTS = 200_000
#: (lang, source) groups at most: the report has a row for each pair of a language's sources.
MAX_GROUPS = 1_000_000
#: Rows that a task's arrays have at a time when copies or pairs of sources are laid out.
ROWS = 1 << 20
SHARES = 1_000_000_000


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total) for total = N + V, exact for counts of any size."""
    whole = F.lit(SHARES).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return 1 + F.call_function("div", whole, total.cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def collapsed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, text, shares) with one row a distinct text of a language, shares its copies by source; and (lang, source).

    Only texts that have copies are shuffled, and of each task's copies of a text one.
    """
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = rows.select("lang", "source", "text", digest)
    each = save(rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n")), "copies")
    repeated = each.groupBy("lang", "digest").agg(F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("shares"))
    repeated = save(repeated.filter("`all` > 1").drop("all"), "repeated")
    few = F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST_TEXTS else repeated
    marked = rows.join(few, ["lang", "digest"], "left")
    alone = F.array(F.struct("source", F.lit(1).cast("long").alias("n")))
    single = marked.filter("shares is null").select("lang", "text", alone.alias("shares"))
    several = marked.filter("shares is not null").select("lang", "text", "shares").distinct()
    return single.unionByName(several), each.select("lang", "source").distinct()


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of collapsed texts: occurrences, and documents that have the term."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, size=4 << 20):
            doc, word, known = words.encoded(words.blobs(batch.column("text")), words.LETTERS)
            if not len(doc):
                continue
            shares = batch.column("shares")
            offsets, flat = shares.offsets.to_numpy().astype(np.int64), shares.values
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))  # sliced: offsets are absolute, owners are not
            lang = batch.column("lang").dictionary_encode()
            source = flat.field("source").dictionary_encode()
            n_of, source_of = flat.field("n").to_numpy(), source.indices.to_numpy().astype(np.int64)
            group = np.zeros(len(n_of), np.int64)
            group[offsets[0] : offsets[-1]] = lang.indices.to_numpy().astype(np.int64)[owner] * len(source.dictionary)
            group += source_of
            pair, times = np.unique(doc * len(known) + word, return_counts=True)
            text, term = pair // len(known), pair % len(known)
            width = np.diff(offsets)[text]
            ends = np.cumsum(width)
            at = 0
            while at < len(pair):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ROWS, side="right")))
                some = np.arange(at, stop)
                rep = np.repeat(some, width[some])
                own = offsets[text[rep]] + np.arange(len(rep)) - np.repeat(ends[some] - width[some] - (ends[at - 1] if at else 0), width[some])
                code, back = np.unique(group[own] * len(known) + term[rep], return_inverse=True)
                n, docs = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
                np.add.at(n, back, times[rep] * n_of[own])
                np.add.at(docs, back, n_of[own])
                g, t = code // len(known), code % len(known)
                made = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary)))]
                made += [known.take(pa.array(t)).cast(pa.string()), pa.array(n), pa.array(docs)]
                yield pa.record_batch(made, names=names)
                at = stop

    counted = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


@dataclass
class Groups:
    """Of each (lang, source): its number, N + V, and the share of a term that it lacks."""

    number: dict[tuple[str, str], int]
    total: np.ndarray
    lacking: np.ndarray


def _priced(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    if len(n) and int(n.max()) >= 9_000_000_000:
        return np.array([1 + SHARES * (int(a) + 1) // int(b) for a, b in zip(n, total, strict=True)], np.int64)
    return 1 + SHARES * (n + 1) // total


def _common(kept: DataFrame, groups: Groups) -> DataFrame:
    """(a, b, value): for ordered pairs of groups the sum over common terms, by the groups' numbers."""
    level = kept.sparkSession.sparkContext.broadcast(groups)  # at most MAX_GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, found = level.value, {}
        away = lambda p, q: (p - q) * (p - q) // q
        for batch in batches:
            held = batch.column("held")
            size = np.diff(held.offsets.to_numpy()).astype(np.int64)
            flat = held.flatten()
            lang = np.repeat(np.array(batch.column("lang").to_pylist(), object), size)
            number = groups.number
            g = np.array([number[k] for k in zip(lang.tolist(), flat.field("source").to_pylist(), strict=True)], np.int64)
            p, p0 = _priced(flat.field("n").to_numpy(), groups.total[g]), groups.lacking[g]
            ends = np.cumsum(size)
            width = np.repeat(size, size)  # of each entry, the entries of its term
            head = np.repeat(ends - size, size)
            reach = np.cumsum(width)
            at = 0
            while at < len(g):
                before = reach[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(reach, before + ROWS, side="right")))
                a = np.repeat(np.arange(at, stop), width[at:stop])
                b = head[a] + np.arange(len(a)) - np.repeat(reach[at:stop] - width[at:stop] - before, width[at:stop])
                a, b = a[a != b], b[a != b]
                value = away(p[a], p[b]) - away(p[a], p0[b]) - away(p0[a], p[b]) + away(p0[a], p0[b])
                code, back = np.unique(g[a] * len(groups.total) + g[b], return_inverse=True)
                total = np.zeros(len(code), np.int64)
                np.add.at(total, back, value)
                for c, v in zip(code.tolist(), total.tolist(), strict=True):
                    found[c] = found.get(c, 0) + v
                at = stop
        code = np.array(list(found), np.int64)
        columns = [code // max(1, len(groups.total)), code % max(1, len(groups.total)), np.array(list(found.values()), np.int64)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["a", "b", "value"])

    return kept.select("lang", "held").mapInArrow(run, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source); nulls count as empty texts.

    Terms are runs of letters, only A-Z lower-cased; a language keeps those in at least min_docs of its documents.
    Part `pair` has for each source the distance of every other source of its language, part `term` the `top` terms that
    it has more of than its language.  Copies of a text count one by one, whatever their ids; a source without terms
    has pairs too; a language with one source has no pairs; an empty table gives no rows; other columns are ignored.
    """
    texts, groups = collapsed(docs)
    counts = save(term_counts(texts), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = save(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept")
    entries = kept.select("lang", "term", F.col("n").alias("n_lang"), F.explode("held").alias("h")).select("lang", "term", "n_lang", "h.*")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all_n"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = groups.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "all_n", "own_n"])
    total = F.col("own_n") + F.col("v")
    # a language without terms has V = 0 and no sums; 1 stands for its total
    groups = groups.withColumns({"total": F.when(total > 0, total).otherwise(1), "lang_total": F.col("all_n") + F.col("v")})
    groups = save(groups.withColumn("lacking", share(F.lit(0), F.col("total"))), "groups")
    known = groups.select("lang", "source", "total", "lacking").limit(MAX_GROUPS + 1).collect()
    if len(known) > MAX_GROUPS:
        raise ValueError(f"over {MAX_GROUPS} sources: their pairs are no report")
    numbers = {(r["lang"], r["source"]): i for i, r in enumerate(known)}
    table = Groups(numbers, np.array([r["total"] for r in known], np.int64), np.array([r["lacking"] for r in known], np.int64))

    one = groups.select("lang", "source", "v", "total", "lacking", "lang_total")
    other = groups.select("lang", F.col("source").alias("item"), F.col("lacking").alias("q0"))
    base = distance(F.col("lacking"), F.col("q0"))
    pairs = one.join(other, "lang").filter("source <> item")  # the report's own rows
    parts = [pairs.select("lang", "source", "item", (F.col("v") * base).alias("value"))]
    alike = entries.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    alike = alike.join(F.broadcast(one), ["lang", "source"]).select("lang", "source", "lacking", "terms", share(F.col("n"), F.col("total")).alias("p"))
    laid = alike.join(F.broadcast(other), "lang").filter("source <> item")  # counts that occur, not terms
    forth = F.col("terms") * (distance(F.col("p"), F.col("q0")) - base)
    back = F.col("terms") * (distance(F.col("q0"), F.col("p")) - distance(F.col("q0"), F.col("lacking")))
    sides = F.array(F.struct("source", "item", forth.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("value")))
    parts.append(laid.select("lang", F.explode(sides).alias("s")).select("lang", "s.*"))
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, *k) for k, i in numbers.items()], "number long, lang string, source string")
    both = _common(kept, table).join(F.broadcast(names.withColumnRenamed("number", "a")), "a")
    both = both.join(F.broadcast(names.select(F.col("number").alias("b"), F.col("source").alias("item"))), "b")
    parts.append(both.select("lang", "source", "item", "value"))
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    pair = summed.withColumns({"part": F.lit("pair"), "rank": ranked}).select(*out)

    terms = entries.join(F.broadcast(one), ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total")).alias("p"), share(F.col("n_lang"), F.col("lang_total")).alias("q"))
    terms = terms.filter("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    term = terms.withColumn("rank", ranked).filter(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*out)
    return pair.unionByName(term)
