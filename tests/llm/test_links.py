"""Decontamination, Jaccard join, embeddings, licenses, urls, line dedup against plain versions."""

import itertools
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, decontaminate, jaccard, licenses, line_dedup, queries, sql, urls, vectors

DOCS = "doc_id long, text string, item_id long, words string, n_deleted long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash", 9) for i, t in rows], DOCS)


def groups(n, links):
    root = {i: i for i in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in root}


def text_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("name", ["op1_decontaminate", "op6_embedding_near_dup", "op7_jaccard_join", "op10_line_dedup"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(sql.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    plain = lambda f: sorted(map(repr, f.astype(object).where(f.notna(), None).values.tolist()))
    assert plain(got) == plain(want)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 500)] + [(600, i) for i in range(601, 700)]
    want = {k: v for k, v in groups(range(700), links).items() if k != v}
    got = common.components(spark.createDataFrame([*links, (None, 1)], "a long, b long"))
    assert {r.id: r.component_id for r in got.collect()} == want


# decontamination


def test_substitutions_are_tolerated(spark):
    rng = random.Random(1)
    item = text_of(rng, 30, 5000)
    fifth = [w if i % 5 else "other" for i, w in enumerate(item)]
    third = [w if i % 3 else "other" for i, w in enumerate(item)]
    pad = lambda: text_of(rng, 20, 5000)
    rows = [
        (1, " ".join(pad() + item + pad())), (2, " ".join(pad() + fifth + pad())), (3, " ".join(third)), (4, None), (5, ""),
        (6, ("! ".join(item)).upper()), (6, ("! ".join(item)).upper()), (7, " ".join(pad() * 2000)), (8, " ".join(item[:16])), (9, " ".join(item[:15])),
    ]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None)], "item_id long, text string")
    found = decontaminate.overlaps(docs_of(spark, rows), bench)
    assert {r.doc_id: r.matches for r in found.collect()} == {1: 20, 2: 16, 6: 20, 8: 16}
    assert decontaminate.overlaps(docs_of(spark, []), bench).count() == 0
    assert decontaminate.overlaps(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    small = decontaminate.overlaps(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_SEEDS", 0)
    assert sorted(small) == sorted(decontaminate.overlaps(docs, bench).collect()) and small


def test_every_placement_of_substitutions_has_a_hit():
    for length in range(1, 21):
        changed = length - next(m for m in range(length + 1) if m >= 0.8 * length)
        assert decontaminate.covers(decontaminate.masks_of(length, 0.8), length, changed), length
        assert not changed or not decontaminate.covers(("1" * length,), length, changed)
    assert all(decontaminate.masks_of(n, 0.8) == decontaminate.MASKS for n in (15, 16, 17, 18, 19, 20))
    assert decontaminate.covers(decontaminate.masks_of(12, 0.5), 12, 6)


def test_short_items_and_unlucky_placements_are_found(spark, monkeypatch):
    rng = random.Random(11)
    bench, rows, want = [], [], set()
    for n in (1, 3, 5, 6, 7, 8, 10, 14, 15, 16, 20, 25):
        item = [f"i{n}x{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        of = min(n, 20)
        changed = of - next(m for m in range(of + 1) if m >= 0.8 * of)
        places = list(itertools.combinations(range(of), changed))
        for c in places if len(places) < 60 else rng.sample(places, 60):
            for more in (0, 1):
                gone = {*c, *range(of, n)} | ({next(i for i in range(of) if i not in c)} if more else set())
                rows.append((len(rows), " ".join(["pad", *("other" if i in gone else w for i, w in enumerate(item)), "pad"])))
                want |= set() if more else {(rows[-1][0], n, of - changed, of)}
    docs, bench = docs_of(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.matches, r["of"]) for r in decontaminate.overlaps(docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_SEEDS", 0)
    assert {(r.doc_id, r.item_id, r.matches, r["of"]) for r in decontaminate.overlaps(docs, bench).collect()} == want


def test_whole_copies_of_a_long_item_are_verified_once(spark):
    rng = random.Random(12)
    item = text_of(rng, 3_000)
    rows = [(i, " ".join(item)) for i in range(4)]
    began = time.time()
    found = decontaminate.overlaps(docs_of(spark, rows), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.matches, r["of"], r.item_start) for r in found.collect()} == {(i, 5, 20, 20, 0) for i in range(4)}
    assert time.time() - began < 60


# Jaccard join


def plain_shingles(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_jaccard_against_all_pairs(spark):
    rng = random.Random(5)
    base = text_of(rng, 120, 10_000)
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # near copies, some just above and some just below the limit
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, "same passage " * 3 + " ".join(text_of(rng, 30))) for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "one  TWO"), (205, "one two"), (206, "É"), (207, "é"), (208, " ".join(text_of(rng, 40_000))), (209, "a b c d e " * 50), (210, "a b c d e " * 60)]
    rng.shuffle(rows)
    sets = {i: plain_shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = jaccard.join(docs_of(spark, [*rows, rows[0], (0, None), (0, "~ a later text"), (None, "x y")]), sketch_bits=10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert got.count() == len(rows)
    assert jaccard.join(docs_of(spark, [])).count() == 0


# embeddings


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(250, 16))
    near = base[0] + rng.normal(size=(120, 16)) * 0.08
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(np.concatenate([base, near, base[:40] * 3, base[40:80] + 0.03 * rng.normal(size=(40, 16))]))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, None] * 8, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] * 16, 0), (n + 5, rows[0][1], None), (n + 6, [], 0), (n + 7, rows[0][1][:8], 0), rows[3]]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, v string")
    valid = {}
    for r in table.collect():
        v = np.array([np.nan if x is None else x for x in r.embedding or []], float)
        if r.label is not None and len(v) and np.isfinite(v).all() and v.any():
            valid[r.vec_id] = (r.label, v)
    links = [
        (a, b) for a, b in itertools.combinations(valid, 2)
        if valid[a][0] == valid[b][0] and len(valid[a][1]) == len(valid[b][1])
        and valid[a][1] @ valid[b][1] / np.linalg.norm(valid[a][1]) / np.linalg.norm(valid[b][1]) >= 0.98
    ]
    want = groups({r[0] for r in rows}, links)
    degree = {i: sum(i in p for p in links) for i in want}
    got = {r.vec_id: r for r in vectors.near_duplicates(table, leaf=20, block=16, max_sample=100).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (degree[i], c, c == i) for i, c in want.items()}
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def near_pairs(rng, n, far):
    """n random unit vectors and a partner of each, of cosine 0.98 to 0.985."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    u, r = unit(rng.normal(size=(n, far))), rng.normal(size=(n, far))
    r = unit(r - (r * u).sum(axis=1, keepdims=True) * u)
    c = rng.uniform(0.9801, 0.985, (n, 1))
    return u, c * u + np.sqrt(1 - c * c) * r


def test_recall_with_production_parameters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    u, v = near_pairs(rng, 1_000, 64)
    rest = rng.normal(size=(38_000, 64))
    x = np.concatenate([u, v, rest])
    label = np.r_[np.arange(1_000) % 2, np.arange(1_000) % 2, np.arange(38_000) % 2]
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), "label": label.astype(np.int32)})
    path = f"{common.shared_dir(spark)}/recall.parquet"
    frame.to_parquet(path)
    table = spark.read.parquet(path)
    for small in (False, True):
        if small:  # upper splits on few vectors: leaves have to be split further
            monkeypatch.setattr(vectors, "LEAF_SAMPLE", 500)
        got = {r.vec_id: r for r in vectors.near_duplicates(table, **({"max_sample": 300} if small else {})).collect()}
        found = sum(got[i].n_links == 1 and got[1_000 + i].component_id == i for i in range(1_000))
        assert found >= 900 and all(got[i].n_links == 0 for i in range(2_000, 40_000))


def test_leaves_are_as_small_in_larger_tables(spark):
    rng = np.random.default_rng(6)
    mean = []
    for n in (2_000, 16_000):
        rows = [(i, 0, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 16)))]
        own = spark.createDataFrame(rows, "vec_id long, label int, v array<double>").cache()
        members = own.select("vec_id", "label", F.size("v").alias("size"), F.lit(0).alias("tree"), F.lit(0).cast("long").alias("leaf"))
        sizes = vectors._split_further(members, own, 0.98, 32).groupBy("leaf").count().toPandas()["count"].to_numpy()
        assert sizes.max() <= 64
        mean.append((sizes.astype(float) ** 2).sum() / sizes.sum())
    assert mean[1] < 1.5 * mean[0]


# licenses


def test_alignment_is_rising_and_equal():
    rng = random.Random(4)
    for _ in range(100):
        a, b = text_of(rng, rng.randrange(20), 12), text_of(rng, rng.randrange(20), 12)
        found = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(found))
    assert len(licenses.align("a b c d e".split(), "x a c d y e".split())) == 4


def test_every_template_is_found_and_little_else(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        pad = " ".join(text_of(rng, 50))
        rows.append((i, f"{pad}\n{text.upper()}.\n{pad}"))
        want[i] = [name]
    rows += [(50, None), (51, ""), (52, "license"), (53, "the License of Version 2 " + "word " * 30_000), (54, rows[0][1] + "\n" + rows[5][1])]
    want[54] = sorted(want[0] + want[5])
    got = {}
    for r in licenses.scan(docs_of(spark, rows)).collect():
        assert r.coverage == 1.0
        got.setdefault(r.doc_id, []).append(r.license)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_every_stretch_of_a_license_is_found():
    scanner, of = licenses.Scanner(licenses.TEMPLATES, 0.9), licenses.TEMPLATES
    rng = random.Random(9)
    pad = " ".join(text_of(rng, 60))

    def found(*parts):
        return [hit[0] for hit in sorted(scanner.scan(" ".join(parts)), key=lambda hit: hit[2])]

    for longer in ("LGPL-3.0", "AGPL-3.0"):
        for between in ("", "end", pad):
            assert found(pad, of[longer], between, of["GPL-3.0"], pad) == [longer, "GPL-3.0"]
    for longer in ("CC-BY-SA-4.0", "CC-BY-NC-4.0"):
        assert found(of[longer], pad, of["CC-BY-4.0"]) == [longer, "CC-BY-4.0"]
    for name, text in of.items():
        for between in ("", "x", pad):
            assert found(text, between, text, between, text) == [name] * 3
    changed = of["GPL-3.0"].replace("GNU", "other")
    assert found(changed, pad, changed, of["MIT"]) == ["GPL-3.0", "GPL-3.0", "MIT"]
    spaced = of["MIT-notice"].replace("charge", "charge x y z")
    assert scanner.scan(f"{pad} {spaced} {spaced}") == [("MIT-notice", 1.0, 60, 91), ("MIT-notice", 1.0, 92, 123)]


def plain_covered(template, words, share=0.9):
    """Whether any stretch of the words covers the template, by the longest common subsequence of each stretch."""
    n = len(template)
    for start in {i for i, w in enumerate(words) if w in template}:
        row = [0] * (n + 1)
        for w in words[start : start + 2 * n + licenses.MAX_INSERTED]:
            last = row
            row = [0] * (n + 1)
            for i, t in enumerate(template):
                row[i + 1] = last[i] + 1 if t == w else max(row[i], last[i + 1])
        if row[n] >= share * n:
            return True
    return False


def test_edited_notices_against_all_stretches():
    rng = random.Random(21)
    some = {k: licenses.TEMPLATES[k] for k in ("CC0-1.0", "MIT-notice", "BSD-3-Clause", "ISC", "MPL-2.0", "Apache-2.0")}
    scanner = licenses.Scanner(some, 0.9)
    seen = {True: 0, False: 0}
    for _ in range(150):
        name = rng.choice(list(some))
        words = licenses.words_of(some[name])
        for _ in range(rng.randrange(5)):  # words changed, dropped and put in
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], ["other"], [words[i], *text_of(rng, rng.choice([1, 3, 20]))], ["copyright", words[i]]])
        words = [*text_of(rng, rng.randrange(30)), *rng.sample(licenses.words_of(some[name]), 2), *words, *text_of(rng, rng.randrange(30))]
        found = {hit[0] for hit in scanner.scan(" ".join(words))}
        want = {k for k in some if plain_covered(licenses.words_of(some[k]), words)}
        assert found == want, (name, words)
        seen[name in want] += 1
    assert min(seen.values()) > 20


def test_notices_with_insertions_and_stray_words():
    scanner, cc0 = licenses.Scanner(licenses.TEMPLATES, 0.9), licenses.TEMPLATES["CC0-1.0"]
    for stray in ("neighboring", "x copyright possible neighboring", "neighboring copyright waived rights related"):
        assert ("CC0-1.0", 1.0) in [hit[:2] for hit in scanner.scan(f"{stray} {cc0}")]
    words = cc0.split()
    for at in range(1, len(words)):
        hits = scanner.scan(" ".join([*words[:at], *(f"new{i}" for i in range(20)), *words[at:]]))
        assert [hit[0] for hit in hits] == ["CC0-1.0"] and hits[0][1] >= 0.9
    for name in ("MIT-text", "BSD-3-Clause-text", "BSD-2-Clause-text", "GPL-3.0-notice"):
        text = licenses.TEMPLATES[name].split()
        text[30:30] = ["holder"] * 30
        assert name in [hit[0] for hit in scanner.scan(" ".join(text))]


def test_a_notice_after_an_earlier_key_word_is_found():
    scanner, of = licenses.Scanner(licenses.TEMPLATES, 0.9), licenses.TEMPLATES
    text = "Documentation for Foo, copyright 2020 by the Foo authors. " + of["MIT-notice"]
    assert scanner.scan(text) == [("MIT-notice", 1.0, 9, 37)]
    for name, notice in of.items():
        for word in scanner.keys[name]:
            for gap in range(12):
                hits = scanner.scan(" ".join([word, *["foo"] * gap, notice.replace(" ", " foo ", 1)]))
                assert name in [hit[0] for hit in hits], (name, word, gap)


# urls


def test_urls_against_the_rules(spark, sf_dir):
    def plain(url):
        if not url or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits, default=(0, None, None))[1:]

    odd = ["http://A.Example.NET/en/x?y#z", "https://example.com/de/", "http://notexample.com/de/x", "x.org/fr/", "http://x.org/fr/a", "http://net/", "http://net", "net://", "://a.net/b", "http://h?x/en/", "http://free-casino-bets.example.com/", "HTTP://É.net/", "a\nb://c.net/d\ne", "http://net." + "/", "http://" + "x" * 5000 + ".com/", None, ""]
    pages = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(odd)] + [(0, odd[0], None, "clash"), (None, odd[1], "<title>", "")], "page_id long, url string, html string, words string")
    for table in (pages, spark.read.parquet(f"{sf_dir}/pages.parquet")):
        url = {r.page_id: r.url for r in table.collect()}
        rows = urls.judge(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            host, path, rule = plain(url[r.page_id])
            assert (r.host, r.path) == (host, path)
            if rule and rule[0]:
                assert (r.rule, r.verdict) == rule
            else:
                assert r.rule is None and r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert urls.judge(pages.limit(0)).count() == 0


def test_names_are_segmented_and_topics_blocked(spark):
    words = urls.Segmenter({"cheap": 50, "pills": 40, "the": 500, "garden": 60})
    assert words.split("cheappills") == ["cheap", "pills"] and words.split("thegarden") == ["the", "garden"]
    pages = [(i, f"http://garden{i % 7}.example.com/roses/{i}", "<title>the garden roses</title>") for i in range(200)]
    pages += [(1000 + i, f"http://{'casinowin' if i % 2 else 'cheappills'}.example.com/offer/{i}", "<title>cheap offer</title>") for i in range(40)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(200)} == {"allow"} and {got[1000 + i] for i in range(40)} == {"block"}


def plain_split(counts, total, name):
    """The cheapest split of a short name among all of them."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        words, start = [], 0
        for i, cut in enumerate([*cuts, 1]):
            if cut:
                words.append(name[start : i + 1])
                start = i + 1
        cost = sum(math.log(total / counts[w]) if w in counts else math.log(total) + 3 + 3.3 * len(w) for w in words)
        best = min(best or (math.inf, None), (cost, words))
    return best[0]


def test_segmentation_against_all_splits():
    rng = random.Random(13)
    for _ in range(60):
        counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 90) for _ in range(12)}
        name, words = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 11))), urls.Segmenter(counts)
        cost = sum(words.cost.get(w, words.unknown + 3.3 * len(w)) for w in words.split(name))
        assert "".join(words.split(name)) == name and cost == pytest.approx(plain_split(counts, sum(counts.values()) + 1, name))


def test_scores_against_plain_naive_bayes(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    titles = {r.w: r["count"] for r in urls.title_words(pages).collect()}
    usual = max(1, sum(titles.values()) // max(1, len(titles)))
    segmenter = urls.Segmenter(titles | {w: max(usual, titles.get(w, 0)) for w in urls.TOPICS})
    got = urls.judge(pages).collect()
    words = [segmenter.words(r.host, r.path) for r in got]
    verdict = {"/".join(k[:1]) + k[1]: k[2] for k in urls.RULES}
    count = [{}, {}]
    pages_of = [0, 0]
    for r, some in zip(got, words, strict=True):
        topic, rule = not set(urls.TOPICS).isdisjoint(some), verdict.get(r.rule)
        if not (topic and rule == "allow"):
            k = int(topic or rule == "block")
            pages_of[k] += 1
            for w in some:
                count[k][w] = count[k].get(w, 0) + 1
    n = len({*count[0], *count[1]})
    total = [sum(c.values()) + urls.SMOOTH * n for c in count]
    for r, some in zip(got, words, strict=True):
        z = math.log((pages_of[1] + 1) / (pages_of[0] + 1))
        z += sum(math.log((count[1].get(w, 0) + urls.SMOOTH) / total[1]) - math.log((count[0].get(w, 0) + urls.SMOOTH) / total[0]) for w in some if w in count[0] or w in count[1])
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_ruled_urls_of_held_out_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    fold = F.crc32(F.encode("host", "UTF-8")) % 4 == 2
    found = urls.judge(pages, teach=~fold).filter(fold).filter("rule is not null").select("verdict", "score").collect()
    right = sum((r.score >= 0.5) == (r.verdict == "block") for r in found)
    assert len(found) > 10 and right >= 0.8 * len(found), (right, len(found))


def test_rare_words_count_beyond_those_that_tasks_hold(spark):
    titles = ["the garden roses", "cheap offer", "orchid"]
    pages = [(i, f"http://garden{i % 7}.example.com/roses/slug{chr(97 + i % 26)}{chr(97 + i % 17)}", f"<title>{titles[0]} word{chr(97 + i % 26)}</title>") for i in range(150)]
    pages += [(1000 + i, f"http://{'casinowin' if i % 2 else 'cheappills'}.example.com/offer/{i}", f"<title>{titles[1]}</title>") for i in range(20)]
    pages += [(2000, "http://rareorchidporn.example.com/roses", f"<title>{titles[2]}</title>"), (2001, "http://lottery.net", None), (2001, None, None), (None, "http://orchidgarden.example.com/x", None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    plain = lambda rows: sorted((str(r.page_id), r.host, r.path, r.verdict, round(r.score, 9)) for r in rows)
    want = plain(urls.judge(table).collect())
    assert {r[3] for r in want if r[0] == "2001"} == {"block", "allow"} and len(want) == len(pages)
    assert plain(urls.judge(table, max_features=3).collect()) == want
    assert plain(urls.judge(table, max_features=3, max_words=2).collect()) == want
    assert plain(urls.judge(table, max_features=10_000, max_words=0).collect()) == want


def test_letters_of_any_script():
    words = urls.Segmenter({"grün": 50, "haus": 60, "новости": 20, "дня": 20})
    want = ["grün", "haus", "de", "/für", "/über", "/0"]
    assert words.words("grünhaus.de", "/f%C3%BCr/Über/22") == want == words.words("GRÜNHAUS.de", "/für/%c3%9cber/7")
    puny = "xn--" + "grünhaus".encode("punycode").decode()
    assert words.words(f"{puny}.de", "/für/über/22") == want
    assert words.words("новостидня.xn--\u00ff", "/%zz%ff") == ["новости", "дня", "xn", "ÿ", "/zz"]
    assert words.split("q" * 60 + "haus") == ["q" * 60, "haus"]  # an unknown stretch is one, however long


def test_a_host_with_most_pages_and_rare_words(spark):
    pages = [(i, "http://roseorchid.example.com/a/b", "<title>rose</title>") for i in range(3000)]
    pages += [(3000 + i, f"http://tulip{chr(97 + i % 26)}casino.example.com/{i}", "<title>orchid tulip blüte</title>") for i in range(60)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    plain = lambda rows: sorted((r.page_id, r.verdict, round(r.score, 9)) for r in rows)
    want = plain(urls.judge(table).collect())
    assert plain(urls.judge(table, max_words=1).collect()) == want and len(want) == len(pages)
    assert [v for i, v, _ in want] == ["allow"] * 3000 + ["block"] * 60


# line dedup


def plain_line_dedup(rows, min_words=50):
    lines = {i: t.split("\n") for i, t in rows if t is not None and i is not None}
    at = [(i, k) for i in sorted(lines) for k in range(len(lines[i]))]
    gone = set()
    for i, s in at:
        for j, q in at:
            if (j, q) >= (i, s):
                break
            n = words = 0
            while s + n < len(lines[i]) and q + n < len(lines[j]) and lines[i][s + n] == lines[j][q + n]:
                words += len(lines[i][s + n].split())
                n += 1
            if words >= min_words:
                gone |= {(i, k) for k in range(s, s + n)}
    return {i: "\n".join(x for k, x in enumerate(ls) if (i, k) not in gone) for i, ls in lines.items()}


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(8)
    pool = [" ".join(text_of(rng, rng.choice([1, 3, 20, 60]))) for _ in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "five words are in this\n" * 30), (54, rows[3][1]), (55, "y " * 30_000), (56, "y " * 30_000)]
    got = line_dedup.dedup(docs_of(spark, rows))
    want = plain_line_dedup(rows)
    assert got.columns == ["n_lines", "n_deleted", "doc_id", "text", "item_id", "words"]
    assert line_dedup.dedup(docs_of(spark, rows), counts=("n", "m")).columns == ["n", "m", "doc_id", "text", "item_id", "words", "n_deleted"]
    texts = {r["doc_id"]: r["text"] for r in got.select("doc_id", "text").collect()}
    assert texts == want | {50: None}
    again = line_dedup.dedup(docs_of(spark, [*rows, rows[0], (None, rows[3][1])])).select("doc_id", "text").collect()
    assert len(again) == len(rows) + 2 and {r["doc_id"]: r["text"] for r in again if r["doc_id"] is not None} == texts
    assert line_dedup.dedup(docs_of(spark, [])).count() == 0


def test_cutting_is_linear_in_lines(spark):
    lines = [f"line {i} of a long text with some words" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own line", *lines[:50_000], "last line"]))]
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (60_000, 0, rows[0][1]), 2: (50_002, 50_000, "own line\nlast line")}
    assert time.time() - began < 120


def test_hot_keys_are_spread(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") < 2_000, 7).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("count"), F.min("id").alias("first"))
    assert [r.k for r in common.hot_keys(groups, ["k"]).collect()] == [7]
    got = common.join_groups(rows, groups, ["k"])
    assert {(r.k, r.id, r.first) for r in got.collect()} == {(7 if i < 2_000 else i, i, 0 if i < 2_000 else i) for i in range(3_000)}
    assert got.count() == 3_000


def test_slices_by_bytes_of_text():
    texts = ["ab", None, "", "x" * 50, "é" * 3, "c", None]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(common.by_bytes(iter([batch, batch.slice(0, 0)]), size=8))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert [p.num_rows for p in parts] == [3, 1, 3]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vectors_with_labels_of_any_type_and_far_norms(spark, kind):
    label = lambda k: k + (1 << 40) if kind == "long" else f"label {k}"
    rows = [(1, [1e-170, 2e-170], 0), (2, [1e160, 2e160], 0), (3, [1.0, 2.0], 0), (4, [2.0, -1.0], 0), (5, [3.0, 6.0], 1), (6, [1e-170, 2.1e-170], 1), (7, [1.0, 2.0], None)]
    table = spark.createDataFrame([(i, v, None if k is None else label(k)) for i, v, k in rows], f"vec_id long, embedding array<double>, label {kind}")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False), 7: (0, 7, True)}


def test_vectors_in_many_leaves_on_the_given_table(spark):
    """A leaf far below a label's rows: splits decide which vectors meet a near copy of theirs, and nearly all do."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("label is not null and embedding is not null")
    rng = np.random.default_rng(5)
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in table.collect()]
    rows += [(i + 10**6, x + rng.normal(size=len(x)) * np.linalg.norm(x) * 0.15 / np.sqrt(len(x)), k) for i, x, k in rows]
    links = Counter()
    for label in {k for _, _, k in rows}:
        ids, x = zip(*((i, x) for i, x, k in rows if k == label), strict=True)
        x = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.98
        np.fill_diagonal(near, False)
        links.update(dict(zip(ids, near.sum(axis=1).tolist(), strict=True)))
    both = spark.createDataFrame([(i, x.tolist(), k) for i, x, k in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(both, leaf=16).collect()}
    assert all(n <= links[i] for i, n in got.items()) and sum(got.values()) >= 0.9 * sum(links.values()) > 1000
