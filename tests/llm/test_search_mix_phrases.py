"""Ranked search, mixing and phrase mining against brute force, and the cases each docstring defines."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import mixture, phrases, search

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "word " * 30_000), (6, "same text here now"), (7, "same text here now"), (None, "a text of no id"), (8, "twice"), (8, "twice")]


def vocabulary(pick, n):
    return ["".join(pick.choice("abcdeéß") for _ in range(pick.randint(2, 5))) + str(i) for i in range(n)]


def random_docs(seed, n, words=40, size=60):
    pick = random.Random(seed)
    known = vocabulary(pick, words)
    rank = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(pick.choices(known, rank, k=pick.randint(0, size)))) for i in range(n)]


def brute_search(docs, items, k=50):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(i, Counter(term.findall((t or "").translate(fold)))) for i, t in docs]
    N, L = sum(bool(c) for _, c in terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked, out = defaultdict(set), set()
    for i, t in items:
        asked[i] |= set(term.findall((t or "").translate(fold)))
    for item, mine in asked.items():
        scores = []
        for i, c in terms:
            m = 50 + 50 * c.total() * N // max(L, 1)
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in mine if c[t])
            scores += [(-s, i is None, i)] if s > 0 else []
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"shard_postings": 300, "block_docs": 4}, {"block_docs": 8, "block_terms": 20}, {"k": 3, "block_docs": 2}])
def test_search_against_all_scores(docs_of, spark, options):
    docs = random_docs(1, 400) + [(1000, None), (1001, ""), (None, "ab0 cd1"), (7, "Ab0!")] + [(2000 + i, "same ones, SAME ones") for i in range(40)]
    pick = random.Random(2)
    items = [(i, " ".join(pick.choices([w for _, t in docs[:50] for w in t.split()], k=12))) for i in range(12)]
    items += [(20, "same"), (21, None), (22, "unheard of"), (20, "ones again")]
    got = search.search(docs_of(*docs), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_search(docs, items, options.get("k", 50))))


def test_search_skips_blocks_and_scores_no_document_twice():
    pick = np.random.default_rng(5)
    rows = [np.unique(np.concatenate([pick.integers(0, 4, 3), pick.integers(4 + 40 * (i % 8), 44 + 40 * (i % 8), 8)])) for i in range(4000)]
    begins = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    cols = np.concatenate(rows)
    impacts, weight = pick.integers(1, 900_000, len(cols)), np.concatenate([np.full(4, 20), pick.integers(2000, 9000, 330)])
    shard, scored = search.Shard(np.arange(4000), begins, cols, impacts, weight, 32), 0
    for _ in range(20):
        terms, best = np.unique(np.concatenate([pick.integers(0, 4, 2), pick.integers(4, 330, 6)])), search.Best(20)
        scored += search.search_shard(shard, terms, best)
        every = np.zeros(334, dtype=np.int64)
        every[terms] = weight[terms]
        scores = np.add.reduceat(every[cols] * impacts, begins[:-1])
        want = np.lexsort((np.arange(4000), -scores))[:20]
        assert best.ids.tolist() == want.tolist() and best.scores.tolist() == scores[want].tolist()
    assert scored < 20 * 4000 * 0.4


def test_search_edges(docs_of, spark):
    bench = spark.createDataFrame([(1, "same word text")], "item_id long, text string")
    got = search.search(docs_of(*EDGE), bench).collect()
    assert {r.doc_id for r in got} == {5, 6, 7, None} and [r.rank for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert search.search(docs_of(*EDGE).limit(0), bench).count() == 0 and search.search(docs_of(*EDGE), bench.limit(0)).count() == 0
    # Terms over the edge of a piece of a long text stay whole.
    assert search.term_counts("ab, " * 3_000_000) == {b"ab": 3_000_000}


def test_apportionment_against_single_seats(spark):
    pick = random.Random(4)
    for seats in (0, 1, 2, 7, 100, 5003):
        votes = [pick.choice([0, 1, 5, 5, 33, 1000, 12345]) for _ in range(17)]
        rows = spark.createDataFrame([(0, i, float(v), seats) for i, v in enumerate(votes)], "g int, i int, votes double, seats long")
        got = {r.i: r.quota for r in mixture.apportion(rows, ["g"], "i", "votes", "seats").collect()}
        want = [0] * len(votes)
        for _ in range(seats):
            i = min(range(len(votes)), key=lambda i: (-votes[i] / (2 * want[i] + 1), i))
            want[i] += 1
        assert [got[i] for i in range(17)] == want


def brute_targets(sizes):
    """Rounds of resharing, as the contract says; sizes by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), {}
    free = set(names)
    while free:
        left = total - sum(target.values())
        above = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        target |= {s: 2.0 * sizes[s] for s in above}
        free -= above
    return target


def test_mix_meets_its_targets_over_many_shards(docs_of):
    pick = random.Random(6)
    sources = [None, "", "s", "a", "b", "é", "z9"]
    docs = [(i, " ".join(["w"] * pick.randint(0, 300)), "en", pick.choice(sources + ["a"] * 5)) for i in range(600)]
    rows = docs_of(*docs)
    made = mixture.mix(rows, block_words=8, shard_words=2000)
    got = made.join(rows.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for _, text, _, source in docs:
        sizes[source] += len(text.split())
    targets = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.size == len(docs[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    # A shard's last block may be short, and the quotas of sources and shards are rounded to blocks.
    assert len(got) == 600 and all(abs(taken[s] - targets[s]) <= 8 * (3 + sizes[s] / 2000) for s in sizes)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, mixture.mix(rows.repartition(7), block_words=8, shard_words=2000).collect()))
    assert sorted(map(tuple, made.collect())) != sorted(map(tuple, mixture.mix(rows, block_words=8, shard_words=2000, seed=8).collect()))


def test_mix_edges(docs_of):
    got = mixture.mix(docs_of(*EDGE)).collect()
    assert len(got) == len(EDGE) and sum(r.size for r in got) == 30_000 + 1 + 8 + 5 + 2 and {r.taken for r in got if r.size == 0} == {0}
    assert mixture.mix(docs_of(*EDGE).limit(0)).count() == 0
    assert [tuple(r)[1:] for r in mixture.mix(docs_of((1, None), (2, " "))).collect()] == [(0, 0, 0.0, 0)] * 2


def brute_phrases(docs, threshold, longest=5, top=2000):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n, out = Counter(), Counter(), set()
    for text, lang in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(fold)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {x: c for x, c in f.items() if c >= threshold and len(x[1]) > 1}
    drop = {(g, w[i:j]) for (g, w), c in often.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and c >= f[g, w[i:j]]}
    by = defaultdict(list)
    for (g, w), a in often.items():
        if (g, w) not in drop:
            score, k = min((1000 * a * n[g] // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w)))
            by[g].append((-score, -a, " ".join(w).encode("utf-8"), f[g, w[:k]], f[g, w[k:]]))
    for g, rows in by.items():
        out |= {(g, r, p.decode("utf-8"), -a, x, y, n[g], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"chunk": 64, "flush": 100}, {"chunk": 7, "flush": 5000}])
def test_phrases_against_enumeration(docs_of, options):
    pick = random.Random(7)
    known = ["New", "york", "é", "City", "of", "the", "\x1c", "a"]
    text = lambda: "".join(pick.choice(known) + pick.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(pick.randint(0, 80)))
    docs = [(i, text(), pick.choice(["en", "de", None, "und"]), "s") for i in range(120)]
    docs += [(500, "New york City of the " * 400, "en", "s"), (501, None, "fr", "s"), (502, "", None, "s")]
    got = phrases.mine(docs_of(*docs), threshold=12, **options)
    assert {tuple(r) for r in got.collect()} == brute_phrases([(t, g) for _, t, g, _ in docs], 12)
    few = phrases.mine(docs_of(*docs), threshold=12, top=5, **options)
    assert {tuple(r) for r in few.collect()} == brute_phrases([(t, g) for _, t, g, _ in docs], 12, top=5)


def test_phrases_edges(docs_of):
    got = {r.phrase: (r.a, r.l, r.r, r.n) for r in phrases.mine(docs_of(*EDGE)).collect()}
    n = 30_000 + 1 + 8 + 5 + 2
    assert got == {" ".join(["word"] * k): (30_001 - k, 30_000, 30_002 - k, n) for k in (2, 3, 4, 5)}
    assert phrases.mine(docs_of(*EDGE).limit(0)).count() == 0


def test_misra_gries_keeps_everything_frequent():
    pick = np.random.default_rng(3)
    stream = np.concatenate([np.repeat(np.arange(20, dtype=np.uint32), 100), pick.integers(100, 200_000, 50_000).astype(np.uint32)])
    pick.shuffle(stream)
    summary = phrases.MisraGries(len(stream) // 100 + 1, buffer=50)
    for part in np.array_split(stream, 400):
        keys, counts = np.unique(part, return_counts=True)
        blob = phrases.pack_counts(keys, counts)
        assert [x.tolist() for x in phrases.unpack_counts(blob)] == [keys.tolist(), counts.tolist()]
        summary.merge(*phrases.unpack_counts(blob))
    kept = summary.survivors(100)
    assert set(range(20)) <= set(kept.tolist()) and len(summary.keys) <= summary.capacity and 0 < summary.lost < 100


def test_decimal_scores_beyond_64_bits(spark):
    row = spark.sql("select cast((cast(1000 as decimal(4,0)) * cast(1000000000000 as decimal(18,0)) * cast(90000000000000 as decimal(15,0))) div (cast(2000000000000 as decimal(18,0)) * cast(3000000000000 as decimal(18,0))) as bigint) as s").first()
    assert row.s == 1000 * 10**12 * 9 * 10**13 // (2 * 10**12 * 3 * 10**12)
