"""URL filters: rules by host and path, and naive Bayes on segmented names.

Host names are cut into words by Viterbi search under a unigram model of the pages' title words.
Pages that a rule blocks, or whose words hold a listed topic word, teach multinomial naive Bayes the
blocked class, all others the allowed one, but for pages with a topic word that a rule allows, which
teach nothing; it judges the urls that no rule fits by all their host and path words.
Letters are those of any script, also percent-encoded in paths and in Punycode in hosts.
All words count: the most frequent ones are looked up in the tasks, the rest, if any, by joins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, save, spread_join

# Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Topic words of unwanted sites.
TOPICS = (
    "adult ads bet bets betting casino cheap clickbait dating escort farm free gambling gamble jackpot "
    "loan loans lottery nude pharma pill pills poker porn sex sexy slots spam torrent track tracker viagra warez win xxx"
).split()
#: Title words, and url words of naive Bayes, that each task holds, the most frequent ones; the others are joined.
MAX_WORDS, MAX_FEATURES = 50_000, 50_000
#: Added to each word's count in each class.
SMOOTH = 0.1
_PART = re.compile(r"[^\W\d_]+|\d+")


def _readable(host: str) -> str:
    """The host lower-cased, its labels out of Punycode where they are in it."""
    if "xn--" not in host:
        return host.lower()
    labels = []
    for label in host.lower().split("."):
        try:
            labels.append(label[4:].encode("ascii").decode("punycode") if label.startswith("xn--") else label)
        except (UnicodeError, OverflowError):  # no Punycode after all
            labels.append(label)
    return ".".join(labels)


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Splits a name into its likeliest words under unigram counts.

    Where counts hold only some of the words, `total` and `longest` are those of all, and split() takes the counts of
    the others that a name may hold.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int | None = None):
        self.total = total = sum(counts.values()) + 1 if total is None else total + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1) if longest is None else longest
        self.unknown = math.log(total) + 3  # a stretch of other letters, and each of them
        self.seen: dict[str, list[str]] = {}

    def split(self, name: str, others: dict[str, int] | None = None) -> list[str]:
        if name in self.seen:
            return self.seen[name]
        more = {w: math.log(self.total / n) for w, n in others.items()} if others else {}
        best, back = [0.0], [0]
        stretch = 0  # where the cheapest unknown stretch begins, whatever its end
        for end in range(1, len(name) + 1):
            cost, start = best[stretch] + self.unknown + 3.3 * (end - stretch), stretch
            for at in range(max(0, end - self.longest), end):
                word = name[at:end]
                known = self.cost.get(word) or more.get(word)
                if known and best[at] + known < cost:
                    cost, start = best[at] + known, at
            best.append(cost)
            back.append(start)
            if cost - 3.3 * end < best[stretch] - 3.3 * stretch:
                stretch = end
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        if len(self.seen) > 100_000:
            self.seen.clear()
        self.seen[name] = words[::-1]
        return self.seen[name]

    def words(self, host: str, path: str, others: list[tuple[str, int]] | None = None) -> list[str]:
        """Segmented host and path words; numbers count as one word."""
        out = [w for part in _PART.findall(_readable(host)) for w in (self.split(part, dict(others or ())) if part[0].isalpha() else ["0"])]
        return out + ["/" + w if w[0].isalpha() else "/0" for w in _PART.findall(unquote(path).lower())]


def title_words(pages: DataFrame) -> DataFrame:
    """(w, count) of all title words over all pages."""
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1))
    return pages.select(F.explode(F.split(title, r"[^\p{L}]+")).alias("w")).filter("length(w) > 1").groupBy("w").count()


def _host_words(hosts: DataFrame, words: DataFrame, lengths: list[int]) -> DataFrame:
    """(host, others): for each of distinct hosts the words(w, count), of these lengths, that its names hold, as (w, count)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host in batch.column(0).to_pylist():
                names = [p for p in _PART.findall(_readable(host)) if p[0].isalpha()]
                found = {p[i : i + n] for p in names for n in lengths for i in range(len(p) - n + 1)}
                yield pa.record_batch([pa.array([host] * len(found), pa.string()), pa.array(found, pa.string())], names=["host", "w"])

    held = hosts.mapInArrow(pieces, "host string, w string").join(words, "w")
    return hosts.join(held.groupBy("host").agg(F.collect_list(F.struct("w", "count")).alias("others")), "host", "left")


def judge(pages: DataFrame, rules=RULES, max_features: int = MAX_FEATURES, max_words: int = MAX_WORDS, teach: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages(page_id, url, html).

    score is the probability of the blocked class by naive Bayes, which decides where no rule fits
    (block from 0.5).  Urls that are null or lack :// have empty host and path and no words: their score is the
    prior's.  Rows with equal or null page_id are judged one by one; an empty table gives no rows.
    Only pages that meet `teach` (a condition on host and path; all by default) teach; all are judged.
    All words count; tasks hold the `max_words` and `max_features` most frequent ones, and further ones are
    joined, which changes no result.
    """
    urls = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    titles = title_words(pages)
    rows = titles.orderBy(F.desc("count"), "w").limit(max_words + 1).collect()
    counts = {r["w"]: r["count"] for r in rows[:max_words]}
    rest = None
    n, total, longest = len(counts), sum(counts.values()), max(map(len, counts), default=1)
    if len(rows) > max_words:
        titles = save(titles, "titles")
        n, total, longest = titles.agg(F.count("*"), F.sum("count"), F.max(F.length("w"))).first()
        counts |= {r["w"]: r["count"] for r in titles.filter(F.col("w").isin(*TOPICS)).collect()}
        c, w = rows[max_words]["count"], rows[max_words]["w"]
        rest = titles.filter((F.col("count") < c) | ((F.col("count") == c) & (F.col("w") >= w))).filter(~F.col("w").isin(*TOPICS))
    usual = max(1, total // max(1, n))
    topic = {w: max(usual, counts.get(w, 0)) for w in TOPICS}
    total += sum(c - counts.get(w, 0) for w, c in topic.items())
    segmenter = Segmenter(counts | topic, total, max(longest, *map(len, TOPICS)))
    if rest is not None:
        lengths = [r[0] for r in rest.select(F.length("w")).distinct().collect()]
        hosts = save(urls.groupBy("host").count(), "hosts")
        urls = spread_join(urls, _host_words(hosts.select("host"), rest, lengths), ["host"], hot_keys(hosts, ["host"]))
        urls = urls.select("page_id", "host", "path", "others")
        urls = save(urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "urls")
    else:
        urls = urls.withColumn("others", F.lit(None).cast("array<struct<w: string, count: bigint>>"))
    topics = frozenset(TOPICS)

    def words_of(batch: pa.RecordBatch) -> Iterator[list[str]]:
        for host, path, more in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "others")), strict=True):
            yield segmenter.words(host, path, [(x["w"], x["count"]) for x in more or ()])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [(w, not topics.isdisjoint(w), v) for w, v in zip(words_of(batch), batch.column("verdict").to_pylist(), strict=True)]
            words = [w for w, topic, v in seen if not (topic and v == "allow")]
            blocked = [int(topic or v == "block") for _, topic, v in seen if not (topic and v == "allow")]
            yield pa.record_batch([pa.array(words, pa.list_(pa.string())), pa.array(blocked, pa.int64())], names=["words", "blocked"])

    taught = urls if teach is None else urls.filter(teach)
    taught = taught.select("host", "path", "others", rule_of("host", "path", rules)[1].alias("verdict"))
    taught = taught.mapInArrow(features, "words array<string>, blocked long")
    # one pass: a row's class counts ride on an empty word
    words = taught.select("blocked", F.explode(F.array_append("words", F.lit(""))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("blocked").alias("b"), F.sum(1 - F.col("blocked")).alias("a"))
    rows = counts.orderBy(F.desc(F.col("a") + F.col("b")), "w").limit(max_features + 2).collect()
    whole = len(rows) < max_features + 2
    if not whole:
        counts = save(counts, "url-words")
    of = {r["w"]: (r["a"], r["b"]) for r in rows[: max_features + 1]}
    if whole:
        allowed, blocked = of.pop("", (0, 0))
        n, *sums = len(of), *(sum(x[i] for x in of.values()) for i in (0, 1))
    else:
        of.pop("", None)
        allowed, blocked = counts.filter("w = ''").select("a", "b").first()
        n, *sums = counts.filter("w <> ''").agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    in_allowed, in_blocked = (max(1, x + SMOOTH * n) for x in sums)
    weight = {w: math.log((b + SMOOTH) / in_blocked) - math.log((a + SMOOTH) / in_allowed) for w, (a, b) in of.items()}
    prior = math.log((blocked + 1) / (allowed + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, others = [], []
            for words in words_of(batch):
                z.append(prior + sum(weight.get(w, 0.0) for w in words))
                others.append([] if whole else [w for w in words if w not in weight])
            z, others = pa.array(z, pa.float64()), pa.array(others, pa.list_(pa.string()))
            yield pa.record_batch([*batch.columns[:3], z, others], names=["page_id", "host", "path", "z", "others"])

    scored = urls.mapInArrow(score, "page_id long, host string, path string, z double, others array<string>")
    if not whole:
        scored = save(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        # the words held by the tasks are the most frequent ones, so none of these is in many rows
        of_word = F.log((F.col("b") + SMOOTH) / in_blocked) - F.log((F.col("a") + SMOOTH) / in_allowed)
        more = scored.select("row", F.explode("others").alias("w")).join(counts.select("w", of_word.alias("more")), "w")
        more = more.groupBy("row").agg(F.sum("more").alias("more"))
        scored = scored.join(more, "row", "left").withColumn("z", F.col("z") + F.coalesce("more", F.lit(0.0)))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("z"))))))
    rule, verdict = rule_of("host", "path", rules)
    verdict = F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
