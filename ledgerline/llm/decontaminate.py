"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask picks some token positions of a window and ignores the others; the hash of the
picked tokens is joined between the training texts and the benchmark items.  A hit aligns the item with
the text, and the alignment counts if some window of `window` item tokens agrees in at least
`share` of its tokens.  The masks of an item are chosen by its length so that every placement of
the substitutions that this leaves room for has a hit.  DataFrame expressions only.
"""

from __future__ import annotations

import math
from functools import cache, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: 1: the token counts, 0: it is ignored.  For windows where they have a hit for every placement of substitutions.
MASKS = ("1110111", "11011011", "1011001101", "10010000111")
#: Placements up to which that is tried out.
MAX_PLACEMENTS = 20_000
#: Seeds of the benchmark up to which they are broadcast; each is a hash, an id and a position.
MAX_BROADCAST_SEEDS = 300_000
#: Alignments up to which they are broadcast to the texts; each is two hashes and a number.
MAX_BROADCAST_HITS = 500_000
#: Copies of each benchmark seed where both sides are shuffled.
SALTS = 16


def tokens(text: str) -> Column:
    """Lower-cased runs of letters and digits; there may be an empty token at either end."""
    return F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")


def covers(masks: tuple[str, ...], length: int, changed: int) -> bool:
    """Whether some mask has a hit in a window of `length` tokens wherever `changed` of them are substituted."""
    places = [{p + i for i, bit in enumerate(m) if bit == "1"} for m in masks for p in range(length - len(m) + 1)]
    return all(any(picked.isdisjoint(c) for picked in places) for c in combinations(range(length), changed))


@cache
def masks_of(length: int, share: float) -> tuple[str, ...]:
    """Masks with a hit in every window of `length` tokens of which at least `share` agree."""
    changed = length - max(1, next(m for m in range(length + 1) if m >= share * length or m == length))
    if math.comb(length, changed) <= MAX_PLACEMENTS and covers(MASKS, length, changed):
        return MASKS
    # of two parts more than there are substitutions, two agree at least
    parts = min(length, changed + 2)
    part = [i * parts // length for i in range(length)]
    left = combinations(range(parts), parts - changed)
    return tuple(sorted({"".join("1" if p in kept else "0" for p in part).strip("0") for kept in left}))


def _hashed(words: Column) -> Column:
    """Each token as a 64-bit hash, which masks are hashed from; alignments are compared by the tokens themselves."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _key(pos: Column, mask: str, number: int) -> Column:
    picked = [F.get(F.col("h"), pos + i) for i, bit in enumerate(mask) if bit == "1"]
    inside = pos + len(mask) <= F.size("h")
    return F.when(inside, F.xxhash64(F.lit(number), *picked))


def _seeds(table: DataFrame, masks: dict[str, int], *keep: str) -> DataFrame:
    """One row a position and mask of table(h): keep..., pos, key.  Masks have numbers of their own."""
    at = table.select(*keep, "h", F.posexplode("h").alias("pos", "__h"))
    keys = F.array(*(_key(F.col("pos"), m, i) for m, i in masks.items()))
    return at.select(*keep, "pos", F.explode(keys).alias("key")).filter("key is not null")


def _best(window: int) -> Column:
    """(matches, place) of the item's window that agrees best with the aligned words, the first of equals."""
    agrees = F.transform(
        F.sequence(F.lit(0), F.size("item_words") - 1),
        lambda j: F.when(F.get("words", F.col("shift") + j) == F.get("item_words", j), 1).otherwise(0),
    )
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("place"), F.lit(0).alias("j"), agrees.alias("m"))

    def step(s: Column, x: Column) -> Column:
        leaving = F.when(s["j"] >= window, F.get(s["m"], s["j"] - window)).otherwise(0)
        now = s["now"] + x - leaving
        more = now > s["most"]
        return F.struct(
            now.alias("now"),
            F.when(more, now).otherwise(s["most"]).alias("most"),
            F.when(more, F.greatest(s["j"] - window + 1, F.lit(0))).otherwise(s["place"]).alias("place"),
            (s["j"] + 1).alias("j"),
            s["m"].alias("m"),
        )

    return F.aggregate(agrees, zero, step, lambda s: F.struct(s["most"].alias("matches"), s["place"].alias("place")))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 20, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, matches, of, item_start): the best window of each contaminated pair.

    `of` is the window's size: `window` tokens, or all of a shorter item.  Items without
    tokens, null texts and empty tables match nothing.  Rows with equal doc_id (or
    item_id) count as one document (item) found by its best window; null ids pass like others.
    Seeds are broadcast only while the benchmark's measured count is at most MAX_BROADCAST_SEEDS;
    beyond, both sides are shuffled by hash, each benchmark seed in SALTS copies, so that a common
    phrase is spread.  Each alignment of a document with an item is verified once, however many
    seeds hit it, on texts fetched again for the hits alone.
    """
    items = benchmark.filter("text is not null").select("item_id", F.filter(tokens("text"), lambda w: w != "").alias("words"))
    items = items.filter(F.size("words") > 0).withColumn("item", F.xxhash64("item_id", "words")).distinct()
    items = items.withColumn("h", _hashed(F.col("words")))
    size = F.least(F.size("words"), F.lit(window))
    of_size: dict[tuple[str, ...], list[int]] = {}
    for row in items.select(size.alias("n")).distinct().collect():  # `window` numbers at most
        of_size.setdefault(masks_of(row["n"], share), []).append(row["n"])
    masks = {m: i for i, m in enumerate(sorted({m for some in of_size for m in some} or {"1"}))}
    kinds = [_seeds(items.filter(size.isin(ns)), {m: masks[m] for m in some}, "item") for some, ns in of_size.items()]
    seeds = reduce(DataFrame.unionByName, kinds or [_seeds(items, masks, "item")])
    seeds = seeds.select("item", F.col("pos").alias("item_pos"), "key")
    whole = items.select("item", "item_id", F.col("words").alias("item_words"))
    n_seeds = (items.agg(F.sum(F.size("words"))).first()[0] or 0) * len(masks)
    texts = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("text_key"))
    own = _seeds(texts.select("text_key", _hashed(tokens("text")).alias("h")), masks, "text_key")
    if n_seeds <= MAX_BROADCAST_SEEDS:
        seeds, on = F.broadcast(seeds), ["key"]
        whole = F.broadcast(whole)
    else:
        own = own.withColumn("salt", F.pmod(F.xxhash64("text_key", "pos"), F.lit(SALTS)).cast("int"))
        seeds, on = seeds.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["key", "salt"]
    hits = own.join(seeds, on).select("text_key", "item", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = save(hits, "hits")
    if hits.count() <= MAX_BROADCAST_HITS:
        hits = F.broadcast(hits)
    hits = texts.join(hits, "text_key").join(whole, "item").withColumn("words", tokens("text"))
    found = hits.select("doc_id", "item_id", F.size("item_words").alias("n"), _best(window).alias("best"))
    of = F.least(F.col("n"), F.lit(window))
    found = found.select("doc_id", "item_id", of.alias("of"), "best").filter(F.col("best.matches") >= share * F.col("of"))
    rank = F.struct(F.col("best.matches").alias("matches"), "of", (-F.col("best.place")).alias("place"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(rank).alias("best"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("best.matches").cast("long").alias("matches"),
        F.col("best.of").cast("long").alias("of"),
        (-F.col("best.place")).cast("long").alias("item_start"),
    )
