"""Substring dedup, source divergence and importance resampling against plain versions and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import divergence, queries, resampling, sql, substring_dedup, words

SCHEMA = "doc_id long, text string, lang string, source string, rank long, row long, n_words string"


def table(spark, rows):
    """rows of (doc_id, text, lang, source) with further columns of clashing names."""
    return spark.createDataFrame([(*r, *("en", "s")[len(r) - 2 :], 5, 6, "clash") for r in rows], SCHEMA)


def plain_windows(rows, size):
    """[(doc_id, n_words, n_removed, text)] of rows(doc_id, text, ...)."""
    split = [[w for w in re.split("[ \t-\r]+", r[1] or "") if w] for r in rows]
    starts = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for r, w in zip(rows, split, strict=True):
        gone = {i + k for i in range(len(w) - size + 1) if starts[tuple(w[i : i + size])] > 1 for k in range(size)}
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def text_rows(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "Aß", "ärger", "c,", "　x", "Ünit", "7", "12a"] + [f"w{i}" for i in range(60)])
    texts = [[word() for _ in range(rng.randrange(1, 90))] for _ in range(40)]
    shared = texts[0] + texts[1]
    texts += [t[:10] + shared[5:40] + t[10:] for t in texts[2:8]]
    texts += [texts[9], texts[9], ["z"] * 50, ["z"] * 7, list("abcdefghij") * 3]
    texts.append([f"u{i}" for i in range(3000)] + texts[9])
    rows = [(i, rng.choice([" ", "\n", "\t\r "]).join(t), rng.choice(["en", "de"]), rng.choice("pqr")) for i, t in enumerate(texts)]
    return [*rows, (900, None, None, None), (901, "", "", "q"), (902, " \n", "en", None), (5, "again " * 12, "en", "p"), (None, "no id here", "xx", "s"), (None, "no id here", "xx", "s"), (7, rows[7][1], *rows[7][2:])]


def bag(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize(("size", "gram", "bits"), [(8, 5, 20), (8, 8, 20), (8, 1, 20), (8, 5, 17)])
def test_windows_against_plain_version(spark, size, gram, bits):
    rows = text_rows()
    got = substring_dedup.remove_repeated(table(spark, rows), size, gram, bits)
    assert got.columns == ["doc_id", "n_words", "n_removed", "text"]
    want = plain_windows(rows, size)
    assert bag(map(tuple, got.collect())) == bag(want) and 0 < sum(x[2] for x in want) < sum(x[1] for x in want)


def test_windows_when_every_cell_is_met(spark, monkeypatch):
    """An overfull sketch: all windows are grouped exactly, and in many partial sketches."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 1 << 6)
    monkeypatch.setattr(substring_dedup, "HELD", 1 << 6)
    monkeypatch.setattr(substring_dedup, "MAX_BROADCAST_PLACES", 0)
    rows = text_rows(4)
    got = substring_dedup.remove_repeated(table(spark, rows).repartition(7), 8, 5, 7).collect()
    assert bag(map(tuple, got)) == bag(plain_windows(rows, 8))


def test_windows_of_an_empty_table(spark):
    assert substring_dedup.remove_repeated(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="gram"):
        substring_dedup.remove_repeated(table(spark, []), 5, 6)


def test_anchors_are_equal_in_equal_windows():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 4000).astype(np.uint64)
    at = substring_dedup.anchors(h, 9, 4)
    gram = words.runs(h, 4)
    for i in range(len(h) - 8):
        least = gram[i : i + 6].min()
        assert at[i] == i + int(np.flatnonzero(gram[i : i + 6] == least)[0])


def test_sketches_never_count_too_little():
    h = words.runs(np.random.default_rng(2).integers(0, 50, 20_000).astype(np.uint64), 2)
    for bits in (8, 14, 20):
        c = substring_dedup.cells(h, bits)
        assert c.min() >= 0 and c.max() < 1 << bits and (c >> (bits - 2) == np.arange(4)[:, None]).all()


def test_word_arrays():
    texts = ["Ab,c 9ß x", None, "", "ab AB\tÄb"]
    doc, word, known = words.encoded(words.blobs(pa.array(texts)), words.LETTERS)
    found = [(d, known[w].as_py().decode()) for d, w in zip(doc.tolist(), word.tolist(), strict=True)]
    assert found == [(0, "ab"), (0, "c"), (0, "ß"), (0, "x"), (3, "ab"), (3, "ab"), (3, "Äb")]
    doc, word, known = words.encoded(words.blobs(pa.array(texts)), words.LETTERS_DIGITS)
    assert [known[w].as_py().decode() for w in word.tolist()] == ["ab", "c", "9ß", "x", "ab", "ab", "Äb"]


def plain_audit(rows, min_docs, top):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for _, s, ts in own:
            counts[s].update(t for t in ts if df[t] >= min_docs)
            counts[s].update()
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit_against_plain_version(spark, monkeypatch, small):
    if small:  # shuffled copies, many slices of copies and of pairs
        monkeypatch.setattr(divergence, "MAX_BROADCAST_TEXTS", 0)
        monkeypatch.setattr(divergence, "ROWS", 3)
    rows = text_rows(5)
    got = divergence.audit(table(spark, rows), 3, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain_audit(rows, 3, 4)
    assert bag(map(tuple, got.collect())) == bag(want) and {x[2] for x in want} == {"pair", "term"}


def test_audit_of_few_documents(spark):
    rows = [(1, "one two", "en", "a"), (2, None, "en", "b")]
    assert bag(map(tuple, divergence.audit(table(spark, rows)).collect())) == bag(plain_audit(rows, 3, 200))
    assert divergence.audit(table(spark, [])).count() == 0


def test_shares_of_large_counts(spark):
    n, total = 8 * 10**12 + 1, 3 * 10**13 + 7
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total)), divergence.share(F.lit(0), F.lit(7))).first()
    assert tuple(got) == (1 + 10**9 * (n + 1) // total, 1 + 10**9 // 7)
    assert divergence._priced(np.array([n]), np.array([total])).tolist() == [got[0]]


def plain_resample(rows, target, percent, min_words, longest, buckets, seed):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(x.encode()) % buckets for x in runs]

    docs = [(r[0], *found(r[1])) for r in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in found(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    scored = []
    for d, n, bs in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        scored.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((x for x in scored if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in scored]


@pytest.mark.parametrize(("percent", "longest", "margin"), [(10, 1, 0.002), (30, 3, 1e-9), (100, 2, 0.002), (0, 1, 0.002)])
def test_resample_against_plain_version(spark, percent, longest, margin):
    rows = [r for r in text_rows(6) if r[0] != 7]
    target = ["a b w1 w2 w3 w1", None, "Ünit ärger 7 12a", ""]
    got = resampling.resample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent, 5, longest, 97, "x", margin)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert bag(map(tuple, got.collect())) == bag(plain_resample(rows, target, percent, 5, longest, 97, "x"))


def test_resample_ties_and_empties(spark):
    """Rows with equal scores: repeated ids and null ones; as many as asked for are drawn."""
    text = "same words over and over again " * 5
    rows = [(1, text)] * 6 + [(None, text)] * 5 + [(2, "short")]
    none = spark.createDataFrame([], "text string")
    for percent in (20, 60, 90):
        got = resampling.resample(table(spark, rows).repartition(3), none, percent).collect()
        assert sorted(r.rank for r in got if r.rank) == list(range(1, percent * 11 // 100 + 1)) and len(got) == len(rows)
        assert bag(tuple(r)[1:] for r in got) == bag(x[1:] for x in plain_resample(rows, [], percent, 20, 1, 10_000, "2024"))
    assert resampling.resample(table(spark, []), none).count() == 0


def test_bracket_is_widened_and_numbering_is_global(spark):
    scores = spark.createDataFrame([(i % 50,) for i in range(5000)], "score long").repartition(5)
    for k in (1, 100, 101, 2500, 5000):
        lo, hi, above = resampling.bracket(scores, 5000, k, 1e-12)
        at = sorted((i % 50 for i in range(5000)), reverse=True)[k - 1]
        assert lo <= at <= hi and above == sum(i % 50 > hi for i in range(5000)) < k
    got = resampling.numbered(spark.range(0, 3000, 1, 6).withColumn("x", F.expr("id % 7")), [F.desc("x"), F.asc("id")])
    want = {i: k + 1 for k, i in enumerate(sorted(range(3000), key=lambda i: (-(i % 7), i)))}
    assert {r.id: r["rank"] for r in got.collect()} == want


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_source_divergence", "op13_importance_resampling"])
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({sql.ORACLE_SQL[name]})").fetchall()
    assert bag(map(tuple, got.select(*columns).collect())) == bag(want) and want
