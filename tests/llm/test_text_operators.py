"""Corpus operators on small hand-made tables: brute force, round trips, and the cases each docstring defines."""

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlake.llm import chat, common, decontamination, jaccard, language, licenses, merkle, packing, quality, queries, tokens, toxicity

WORDS = "river stone garden window letter summer winter bridge copper silver market candle forest island harbor".split()


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(["", "s", "ed", "ing"]) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \n\n "), (4, "one"), (5, "word " * 30_000), (6, "same text here now"), (7, "same text here now")]


def exact_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    return whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_tokens_sum_to_the_document(docs_of, rule):
    rows = [*EDGE, (8, "aé\n\nü b\n<|endoftext|>\n"), (9, "end.\nNext")]
    got = tokens.section_tokens(docs_of(*rows), rule=rule).collect()
    for key, text in rows:
        mine = sorted((r for r in got if r.doc_id == key), key=lambda r: r.section)
        assert sum(r.tokens for r in mine) == pytest.approx(len(exact_ids(text)))
        assert "".join((text or "")[r.begin : r.end] for r in mine) == (text or "")


def test_attribution_rules():
    # Tokens of 3, 4 and 1 bytes over sections of 4, 0, 2 and 2 bytes: the second token lies in three.
    sizes, sections = np.array([3, 4, 1]), np.array([4, 0, 2, 2])
    by = {rule: tokens.attribute(sizes, sections, rule)[0].tolist() for rule in tokens.RULES}
    assert by == {"start": [2, 0, 0, 1], "most": [1, 0, 1, 1], "split": [1.25, 0, 0.5, 1.25]}


def test_fields_keep_their_tokens(docs_of):
    got = tokens.section_tokens(docs_of((1, "body text", "en", "title")), fields=("source", "text")).collect()
    assert [(r.field, r.begin, r.end) for r in sorted(got, key=lambda r: r.field)] == [("source", 0, 5), ("text", 0, 9)]
    assert sum(r.tokens for r in got) == len(exact_ids("title\nbody text"))


def test_merkle_roots_and_differences(docs_of, spark):
    a, b = "p one.\np two.\n\nq one.", "p one.\np 2.\n\nq one."
    got = {r.doc_id: r for r in merkle.fingerprints(docs_of((1, a), (2, b), (3, a), (4, None), (5, ""))).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint and got[4].fingerprint == got[5].fingerprint
    trees = docs_of((1, a)).select(merkle.differences(merkle.tree(F.lit(a)), merkle.tree(F.lit(b))).alias("d"), merkle.differences(merkle.tree(F.lit(a)), merkle.tree(F.lit(a))).alias("e")).first()
    assert [tuple(x) for x in trees.d] == [(0, 1)] and trees.e == []


def test_edited_fingerprints_cases(docs_of):
    got = {r.doc_id: r for r in merkle.edited_fingerprints(docs_of(*EDGE, (9, "Zebra words."))).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9}
    assert got[6].near_next == 1.0 and got[6].fingerprint == got[7].fingerprint and got[1].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert merkle.edited_fingerprints(docs_of((1, "a")).limit(0)).count() == 0
    assert merkle.edited_fingerprints(docs_of((1, "ab"))).first().edited_sha256 == merkle.edited_fingerprints(docs_of((1, "aa"))).first().edited_sha256


def test_subsequence_kernel_against_enumeration():
    from itertools import combinations

    def features(w, decay=0.6):
        w, out = f"^{w}$", {}
        for at in combinations(range(len(w)), 3):
            u = "".join(w[i] for i in at)
            out[u] = out.get(u, 0) + decay ** (at[-1] - at[0] + 1)
        return out

    words = ["idiot", "idxiot", "cat", "a", "tidily"]
    want = [[sum(v * features(b).get(u, 0) for u, v in features(a).items()) for b in words] for a in words]
    assert np.allclose(toxicity.subsequence_kernel(words, words), want, atol=1e-4)
    assert np.allclose(toxicity.self_kernel(words * 20)[:5], np.maximum(np.diag(want), 1e-9), atol=1e-4)


def test_screen_is_the_longest_common_subsequence():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    pick = random.Random(1)
    words = ["".join(pick.choice("abcdé") for _ in range(pick.randint(1, 14))) for _ in range(60)]
    marks = words[:20]
    got = toxicity.Screen.of(marks, 0.8).lengths(words)
    assert got.tolist() == [[lcs(f"^{w}$", f"^{m}$") for m in marks] for w in words]


def test_toxicity_on_held_out(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    machine = toxicity.learn(docs, labels.where(~held))
    got = toxicity.score(docs, machine).join(labels.where(held), "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.9
    assert sum(r.predicted == 1 and r.toxic == 0 for r in got) <= 2


def test_toxicity_edges(docs_of):
    got = toxicity.score(docs_of(*EDGE), toxicity.fit([])).collect()
    assert len(got) == len(EDGE) and {r.predicted for r in got} == {0}
    assert toxicity.tokens("I.D.I.O.T! a b c xx st-upid") == ["idiot", "abc", "xx", "stupid"]


def test_decontamination_against_items(docs_of, spark):
    item = prose(1, 30)
    edited = item.split()
    edited[7] = edited[19] = "changed"
    rows = [*EDGE, (10, prose(2, 50) + " " + item.upper() + "! " + prose(3, 40)), (11, " ".join(edited)), (12, prose(4, 200)), (13, " ".join(item.split()[:6]))]
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, prose(9, 300))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs_of(*rows), bench).collect()}
    assert set(got) == {(10, 1), (11, 1)} and got[10, 1] == 1.0 and 0.8 < got[11, 1] < 1
    blocks = decontamination.contaminated(docs_of(*rows), bench, block_words=1).collect()
    assert {(r.doc_id, r.item_id): r.score for r in blocks} == got
    assert decontamination.contaminated(docs_of(*rows), bench.limit(0)).count() == 0


def test_edited_copies_are_found_beside_whole_copies(docs_of, spark):
    item = "amber basket copper dragon engine falcon gravel hammer island jacket kettle ladder magnet needle orange pepper"
    edited = item.split()
    edited[0] = edited[5] = edited[10] = edited[15] = "changed"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for copies in (0, 1, 20):
        rows = [(1, prose(1, 30) + " " + " ".join(edited) + " " + prose(2, 30))] + [(10 + k, prose(k, 20) + " " + item) for k in range(copies)]
        got = {r.doc_id: r.score for r in decontamination.contaminated(docs_of(*rows), bench).collect()}
        assert set(got) == {k for k, _ in rows} and 0.6 < got[1] < 0.7


def test_decontamination_scores_by_the_whole_item(docs_of, spark):
    # Forty copied words are too few of any of these items, a hundred and more enough of the first two, whatever their length.
    pick = random.Random(5)
    items = [[f"w{pick.randrange(10_000)}" for _ in range(n)] for n in (128, 129, 300, 1000)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    rows = []
    for k, w in enumerate(items):
        for j, part in enumerate((40, 100, 128, len(w))):
            edited = [x if i % 9 else "changed" for i, x in enumerate(w[:part])]
            rows += [(100 * k + 10 * j, prose(k, 60) + " " + " ".join(w[:part]) + " " + prose(j, 60)), (100 * k + 10 * j + 1, " ".join(edited))]
    want = {}
    for key, text in rows:
        for k, w in enumerate(items):
            score = decontamination.smith_waterman(w, decontamination.words(text))
            if score >= 0.5:
                want[key, k] = score
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs_of(*rows), bench).collect()}
    assert got == want and {k for _, k in want} == {0, 1, 2, 3} and not any(key % 100 < 10 for key, _ in want)


def test_smith_waterman_against_cells():
    def slow(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h)) / (2 * len(a))

    pick = random.Random(3)
    for _ in range(50):
        a, b = ([pick.choice("abc") for _ in range(pick.randint(1, 12))] for _ in "ab")
        assert decontamination.smith_waterman(a, b) == slow(a, b)


def test_licenses_against_containment(docs_of):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [*EDGE, (10, prose(1, 500) + "\n" + notice + "\n" + prose(2, 300)), (11, notice.lower()), (12, notice.replace("under", "by"))]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(docs_of(*rows)).collect()}
    assert got == {(10, "Apache-2.0"): 1.0, (11, "Apache-2.0"): 1.0}
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs_of(*rows), templates=[("X", "two words")])


def test_whole_licenses_against_brute_force(docs_of):
    # Whole bodies and notices, edited or not, at places of long texts; every template held against every window of every text.
    import re

    split = lambda text: re.findall(r"[^\W_]+", (text or "").lower())
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    pick, rows = random.Random(8), [*EDGE, (8, licenses.TEMPLATES[2][1])]
    for k, (_, body) in enumerate(licenses.TEMPLATES):
        for j, edits in enumerate((0, 1, 4)):
            w = body.split()
            for at in pick.sample(range(len(w)), min(edits, len(w) // 4)):
                w[at] = pick.choice(["changed", "", w[at] + " added"])
            rows.append((100 + 10 * k + j, prose(k, 100 + 37 * k) + "\n" + " ".join(w) + "\n" + prose(j, 90)))
    rows += [(900, rows[-1][1] + " " + rows[-4][1]), (900, rows[-1][1] + " " + rows[-4][1])]
    want = {}
    for key, text in rows:
        hashes = cut(split(text))
        for t, (_, body) in enumerate(licenses.TEMPLATES):
            s, template = len(split(body)), set(cut(split(body)))
            for begin in range(0, max(1, len(hashes)), s):
                window = hashes[begin : begin + 2 * s - 4]
                share = len(template & set(window)) / len(template)
                if share >= 0.8 and share > want.get((key, t), (0,))[0]:
                    at = [begin + i for i, x in enumerate(window) if x in template]
                    want[key, t] = share, at[0], at[-1] + 5
    got = {(r.doc_id, r.template): (r.containment, r.begin, r.end) for r in licenses.scan_licenses(docs_of(*rows)).collect()}
    assert got == want and got[8, 2] == (1.0, 0, 8) and {t for _, t in want} == set(range(len(licenses.TEMPLATES)))
    assert any(1 > share >= 0.8 and t == 10 for (_, t), (share, *_) in want.items())
    assert licenses.scan_licenses(docs_of(*rows).limit(0)).count() == 0


def brute_components(rows, percent=85):
    sets, root = {}, {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        root[key] = key
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(k, len(sets[k]), find(k)) for k in sets}


def near_copies():
    rows, pick = list(EDGE), random.Random(5)
    for g in range(12):
        base = prose(100 + g, pick.choice([6, 8, 20, 60, 200, 700])).split()
        for c in range(10):
            w = list(base)
            for _ in range(pick.randint(0, max(1, len(w) // 60))):
                w[pick.randrange(len(w))] = f"new{pick.random()}"
            rows.append((1000 + 100 * g + c, " ".join(w)))
    return rows


@pytest.mark.parametrize("task_shingles", [4_000_000, 1500])
def test_jaccard_groups_against_all_pairs(docs_of, task_shingles):
    rows = near_copies()
    got = jaccard.near_groups(docs_of(*rows), task_shingles=task_shingles).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows) and len(got) == len(rows)


def test_region_keys_go_packed_and_meet_by_bucket():
    pick = np.random.default_rng(5)
    for ids in (np.sort(pick.integers(0, 2000, 100_000)), pick.permutation(np.repeat([-(2**63), -7, 0, 2**62, 2**63 - 1], 50))):
        keys = pick.integers(0, 2**64, len(ids), dtype=np.uint64)
        keys[: len(keys) // 2] = pick.choice(keys[:300], len(keys) // 2)
        stars = pick.random(len(ids)) < 0.2
        parts = [jaccard.packed_regions(keys[at::2], ids[at::2], stars[at::2], 7) for at in (0, 1)]
        assert sum(len(x) for f in parts for c in ("keys", "ids", "stars") for x in f[c]) < 6.5 * len(ids) or len(ids) < 1000
        met = pd.concat([jaccard.met_regions(f) for _, f in pd.concat(parts).groupby("bucket")])
        groups = {}
        for key, doc, star in zip(keys.tolist(), ids.tolist(), stars.tolist()):
            groups.setdefault(key, []).append((doc, star))
        want = [(d, min(g)[0], len(g), any(s for _, s in g)) for g in groups.values() if len(g) > 1 for d, _ in g]
        assert sorted(zip(met["id"], met["low"], met["n"], met["star"])) == sorted(want)
        assert met["key"].nunique() == sum(len(g) > 1 for g in groups.values())
    assert len(jaccard.met_regions(jaccard.packed_regions(np.array([9], dtype=np.uint64), np.array([1]), np.array([True]), 1))) == 0


def test_long_unrelated_texts_form_no_block(spark):
    long = {k: " ".join(f"{k}w{i}" for i in range(5000)) for k in (1, 2)}
    long[3] = long[1].replace("1w700 ", "other ").replace("1w2500 ", "")
    long[4] = " ".join(long[1].split()[:4200])
    rows = spark.createDataFrame(list(long.items()), "id long, text string")
    for ids, want in (([1, 2], []), ([1, 3], [(1, 3)]), ([2, 3], []), ([1, 4], [(1, 4)]), ([1, 2, 3, 4], [(1, 3), (1, 4)])):
        lists = spark.createDataFrame([(ids,)], "ids array<long>")
        assert sorted(tuple(r) for r in jaccard.bounded_edges(rows, lists, 5, 80).collect()) == want
    sets = [jaccard.shingles(t, 5) for t in (*long.values(), "a b c d e f g", "x " * 90_000)]
    vectors = [jaccard.packed_vector(s) for s in sets]
    for a, (ga, va) in zip(sets, vectors):
        for b, (gb, vb) in zip(sets, vectors):
            folded = jaccard.unpacked_vectors(np.array([ga, gb]), [va, vb])
            assert (folded == [jaccard.count_vector(s, min(ga, gb)) for s in (a, b)]).all()
    crowded = np.arange(300, dtype=np.uint64) * np.uint64(128)
    assert (jaccard.unpacked_vectors(np.array([128]), [jaccard.packed_vector(crowded)[1]]).sum()) == 300


def test_jaccard_empty(docs_of):
    assert jaccard.near_groups(docs_of((1, "a")).limit(0)).count() == 0


def test_region_keys_meet_for_every_linked_pair():
    pick = np.random.default_rng(0)
    for n in [*range(6, 40), 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(pick.integers(0, 1 << 63, n, dtype=np.uint64))
            k = pick.integers(0, n // 6 + 2)
            b = np.unique(np.concatenate([a[: len(a) - k], pick.integers(0, 1 << 63, pick.integers(0, n // 6 + 2), dtype=np.uint64)]))
            if jaccard.linked(a, b, 85) and jaccard.differing(2 * min(len(a), len(b)) + 2, 85):
                assert np.intersect1d(jaccard.signatures(a, 85), jaccard.signatures(b, 85)).size


def test_tree_search_loses_nothing():
    pick = np.random.default_rng(1)
    points = pick.integers(0, 6, (300, 8))
    tree = jaccard.CountTree(points)
    for q in points[:40]:
        bound = np.minimum(points, q).sum(axis=1)
        want = np.flatnonzero(185 * bound >= 85 * (q.sum() + points.sum(axis=1)))
        assert sorted(tree.search(q, 85).tolist()) == want.tolist()


def test_language_on_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    dictionaries = language.learn_dictionaries(docs.where(~held))
    got = language.identify(docs.where(held), dictionaries).join(docs, "doc_id").select("lang_pred", "lang").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95


def test_language_of_very_long_texts(docs_of, spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet")
    dictionaries = language.learn_dictionaries(docs)
    rows = []
    for i, lang in enumerate(["en", "de", "fr", "es"]):
        text = "\n".join(r.text for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(2000).select("text").collect() if r.text)
        rows += [(10 * i, text[:20_000], lang), (10 * i + 1, (text * (3_000_000 // len(text) + 1))[:3_000_000], lang)]
    got = {r.doc_id: r for r in language.identify(docs_of(*rows), dictionaries).collect()}
    for key, _, lang in rows:
        assert got[key].lang_pred == lang and got[key].accepted
    assert all(got[10 * i + 1].margin > 0.5 * got[10 * i].margin for i in range(4))


def test_language_edges(docs_of):
    rows = [*EDGE, (8, "123 !!")]
    known = language.learn_dictionaries(docs_of(*rows, (9, "der die das und", "de")))
    got = {r.doc_id: r for r in language.identify(docs_of(*rows), known).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 8} and len(got) == len(rows)
    assert language.learn_dictionaries(docs_of((1, None))) == {} and language.identify(docs_of((1, "a")), {}).first().lang_pred == "und"


@pytest.mark.parametrize("shares", [None, {"s0": 0.7, "s1": 0.2, "s2": 0.1}])
def test_packing_round_trip(docs_of, shares):
    rows = [(k, t, "en", f"s{k % 3}") for k, t in EDGE] + [(100 + k, prose(k, 5 * k), None, None if k % 5 else "s1") for k in range(60)]
    got = packing.pack(docs_of(*rows), shares=shares).collect()
    for key, text, *_ in rows:
        ids = np.array([*exact_ids(text), 0], dtype="<u4")
        mine = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes() and all(r.doc_tokens == len(ids) for r in mine)
        assert [r.start for r in mine] == [sum(x.length for x in mine[:i]) for i in range(len(mine))]
    windows = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert windows.get(r.sequence_id, 0) == r.offset
        windows[r.sequence_id] = r.offset + r.length
    assert sorted(windows) == list(range(len(windows))) and all(n == 1024 for w, n in windows.items() if w + 1 < len(windows))


def test_packing_keeps_proportions(docs_of):
    rows = [(k, prose(k, 400), "en", f"s{k % 4 == 0:d}") for k in range(80)]
    by = {r.doc_id: r.source for r in docs_of(*rows).collect()}
    got = packing.pack(docs_of(*rows)).collect()
    total = sum(r.length for r in got)
    share = sum(r.length for r in got if by[r.doc_id] == "s1") / total
    for w in range(total // 1024):
        mine = sum(r.length for r in got if r.sequence_id == w and by[r.doc_id] == "s1")
        assert abs(mine - 1024 * share) <= 3
    assert packing.pack(docs_of((1, "a")).limit(0)).count() == 0


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "x"), (2, 0, "system", "alone"), (3, 600, "ann", "late"), (3, 1, "ann", "")]
    got = {(r.conv_id, r.part, r.speaker): r for r in chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (1, 0, "unknown"), (3, 0, "ann"), (3, 1, "ann")}
    ann = got[1, 0, "ann"]
    assert ann.text == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nx<|im_end|>\n"
    begin, end = map(int, ann.mask.split(":"))
    assert ann.text[begin:end] == "hi<|im_end|>" and ann.n_masked == end - begin and ann.n_turns == 4


def test_chat_parts_show_every_participant(spark):
    # "eve" speaks in the first part only, "bob" in the last; the second conversation has no id and a part of narrators only.
    rows = [(1, 0, "system", "S"), (1, 1, "eve", "first"), (1, 3, "ann", "hi"), (1, 5, "ann", "two"), (1, 9, "system", "still"), (1, 13, "bob", "last"), (1, 14, "ann", "end")]
    rows += [(None, 0, "ann", "a"), (None, 6, "system", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.perspectives(turns, turns_per_part=4).collect()
    assert {(r.conv_id, r.part, r.speaker) for r in got} == {(1, p, s) for p in range(4) for s in ("eve", "ann", "bob")} | {(None, 0, "ann"), (None, 1, "ann")}
    whole = {(r.conv_id, r.speaker): r for r in chat.perspectives(turns).collect()}
    for key, one in whole.items():
        mine = sorted((r for r in got if (r.conv_id, r.speaker) == key), key=lambda r: r.part)
        assert "".join(r.text for r in mine) == one.text and ",".join(r.mask for r in mine if r.mask) == one.mask
        assert sum(r.n_turns for r in mine) == one.n_turns and sum(r.n_masked for r in mine) == one.n_masked


def test_chat_sql_on_long_conversations(spark):
    import duckdb

    rows = [(1, k, "system" if k % 400 == 0 else f"p{k % 3 if k < 600 else 3}", f"turn {k}" if k % 7 else None) for k in range(1300)]
    rows += [(2, None, "ann", "no number"), (2, 700, "bob", "late"), (2, -3, None, "early"), (None, 600, "ann", "x"), (None, 1, "bob", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat.perspectives(turns)
    conversations = turns.toArrow()  # noqa: F841
    want = duckdb.sql(queries.ORACLES["op9_chat_perspectives"]).fetchall()
    assert len(want) > 12 and {tuple(r) for r in got.collect()} == set(want)


def slow_kneser_ney(texts, order):
    """Probability of a character after a context, from the published formulas, with plain dictionaries."""
    from collections import Counter, defaultdict

    grams = {order: Counter()}
    for t in texts:
        c = [0] * (order - 1) + quality.codes_of(t).tolist()
        grams[order].update(tuple(c[i - order + 1 : i + 1]) for i in range(order - 1, len(c)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discounts, contexts = {}, {}
    for k, found in grams.items():
        n = Counter(found.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        discounts[k] = [min(i, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[i + 1] else 0.5 * i + 0.5 - 0.5 * (i == 1) for i in (1, 2, 3)]
        contexts[k] = defaultdict(list)
        for g, c in found.items():
            contexts[k][g[:-1]].append(c)

    def prob(gram):
        k = len(gram)
        if not k:
            return 1 / 2**quality.BITS
        seen = contexts[k].get(gram[:-1])
        if not seen:
            return prob(gram[1:])
        d = lambda c: discounts[k][min(c, 3) - 1] if c else 0
        return (grams[k][gram] - d(grams[k][gram]) + sum(map(d, seen)) * prob(gram[1:])) / sum(seen)

    return prob


def test_quality_model_against_formulas(spark):
    texts = [prose(k, 40) for k in range(12)]
    rows = spark.createDataFrame([(5, t) for t in texts], "lang int, text string")
    model = quality.fit(rows)
    prob = slow_kneser_ney(texts, quality.ORDER)
    probe = "The river, winters bridgeé ZZ"
    codes = [0, 0, 0, *quality.codes_of(probe).tolist()]
    want = [np.log(prob(tuple(codes[i - 3 : i + 1]))) for i in range(3, len(codes))]
    assert np.allclose(model.log_probs(probe, 5), want, atol=1e-4)


def test_quality_model_loses_no_gram(spark):
    # About 300,000 n-grams and contexts of random characters, in one shard and in many.
    pick = random.Random(11)
    texts = ["".join(pick.choices([chr(c) for c in range(32, 380)], k=1500)) for _ in range(60)]
    rows = spark.createDataFrame([(5, t) for t in texts], "lang int, text string")
    prob = slow_kneser_ney(texts, quality.ORDER)
    codes = [0, 0, 0, *quality.codes_of(texts[7]).tolist()]
    want = [np.log(prob(tuple(codes[i - 3 : i + 1]))) for i in range(3, len(codes))]
    for shard_rows in (1 << 20, 20_000):
        model = quality.fit(rows, shard_rows)
        assert (len(model.shards) > 8) == (shard_rows == 20_000)
        assert np.allclose(model.log_probs(texts[7], 5), want, atol=1e-4)
        got = spark.createDataFrame([(1, "", 5, True, texts[7])], "id long, lang string, number long, fresh boolean, text string")
        assert quality.perplexities(got, model).first().perplexity == pytest.approx(np.exp(-np.mean(want)), rel=1e-4)


def test_quality_counts_grams_a_few_texts_at_a_time():
    texts, langs = [prose(i, 300) for i in range(2000)], [i % 3 for i in range(2000)]
    frame = pd.DataFrame({"text": [*texts, "", None], "lang": [*langs, 1, 1]})
    want = Counter(np.concatenate([quality.keys_of(t, n)[-1] for t, n in zip(texts, langs)]).tolist())
    for at_once, most in ((1 << 17, 16), (2_000, 8)):  # the second holds fewer n-grams than there are
        got: Counter = Counter()
        tracemalloc.start()
        for part in quality.gram_counts(iter([frame.iloc[:1500], frame.iloc[:0], frame.iloc[1500:]]), at_once):
            got.update(dict(zip(part["key"].tolist(), part["c"].tolist())))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == want
        assert peak < most << 20  # the n-grams of all texts of the first frame are 25 MB alone
    assert not list(quality.gram_counts(iter([frame.iloc[2000:]])))


def test_quality_of_scripts_beyond_latin(spark):
    # Cyrillic, Chinese and emoji: no two characters share codes, and probabilities follow the formulas.
    codes = quality.codes_of("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    own, spelled = codes[: quality.DIRECT], codes[quality.DIRECT :].reshape(-1, 2)
    assert np.array_equal(own, np.arange(1, quality.DIRECT + 1)) and spelled.min() > quality.DIRECT and spelled.max() < 1 << quality.BITS
    assert len(np.unique(spelled[:, 0] * 4096 + spelled[:, 1])) == len(spelled) == 0x110000 - 0x800 - quality.DIRECT
    pick = random.Random(12)
    alphabet = [chr(c) for c in [*range(0x430, 0x450), *range(0x4E00, 0x4E00 + 400), 0x1F600, 0x10FFFF]]
    texts = ["".join(pick.choices(alphabet, k=300)) + "a \x00\x01" for _ in range(20)]
    model = quality.fit(spark.createDataFrame([(7, t) for t in texts], "lang int, text string"), shard_rows=10_000)
    prob = slow_kneser_ney(texts, quality.ORDER)
    probe = texts[3][:80] + "新しい ё"
    codes = [0, 0, 0, *quality.codes_of(probe).tolist()]
    want = [np.log(prob(tuple(codes[i - 3 : i + 1]))) for i in range(3, len(codes))]
    assert len(want) > len(probe) and np.allclose(model.log_probs(probe, 7), want, atol=1e-4)
    got = spark.createDataFrame([(1, "", 7, True, probe)], "id long, lang string, number long, fresh boolean, text string")
    assert quality.perplexities(got, model).first().perplexity == pytest.approx(np.exp(-np.sum(want) / len(probe)), rel=1e-3)


def test_quality_decisions(docs_of, spark):
    rows = [*EDGE] + [(100 + k, prose(k, 80)) for k in range(60)] + [(900, "#$% ZQX!! " * 60), (901, prose(901, 70))]
    labels = spark.createDataFrame([(100 + k, 1) for k in range(60)] + [(900, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs_of(*rows), labels).collect()}
    assert len(got) == len(rows) and not got[900].accepted and got[901].accepted and not got[1].accepted and not got[2].accepted
    assert all(got[100 + k].accepted for k in range(60))
    none = quality.classify(docs_of((1, "a"), (2, None)), labels.limit(0)).collect()
    assert {(r.doc_id, r.accepted, r.perplexity) for r in none} == {(1, True, None), (2, False, None)}


def test_held_out_rule(docs_of):
    from meterlake.llm.common import is_held_out

    got = {r.doc_id: r.h for r in docs_of(*EDGE).select("doc_id", is_held_out().alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k, _ in EDGE}


def copies_of_one(seed, count, words=300, edits=8):
    pick = random.Random(seed)
    base = [pick.choice(WORDS) + str(pick.randint(0, 9999)) for _ in range(words)]
    for i in range(count):
        mine = list(base)
        for at in pick.sample(range(words), edits):
            mine[at] = f"edit{i}x{at}"
        yield " ".join(mine)


def test_near_copies_send_about_one_edge_each(docs_of, monkeypatch):
    texts = list(copies_of_one(1, 500, edits=2))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3]) for i in range(50)]
    sent = []
    real = jaccard.components

    def counted(edges, *args):
        sent.append(edges.count())
        return real(edges, *args)

    monkeypatch.setattr(jaccard, "components", counted)
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs_of(*rows), n=5, percent=80).collect()}
    assert set(got.values()) == {0} and len(got) == 550
    assert max(sent) <= 4 * 500, sent  # four tasks


def test_near_groups_of_repeated_and_null_ids(docs_of):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(5, a), (5, b), (9, a), (3, b), (None, a), (7, ""), (5, None), (2**53 + 1, a)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(docs_of(*rows)).collect()), key=str)
    sizes = {a: len(jaccard.shingles(a)), b: len(jaccard.shingles(b))}
    want = [(k, sizes.get(t, 0), None if k is None else 7 if k == 7 else 3) for k, t in rows]
    assert got == sorted(want, key=str)


def test_rows_among_is_a_semi_join(spark):
    rows = spark.range(5000).withColumn("text", F.lit("x")).unionByName(spark.range(100).withColumn("text", F.lit("y")))
    ids = spark.range(0, 9000, 3).unionByName(spark.range(0, 9, 3))
    got = common.rows_among(rows, ids)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.where("id % 3 = 0").collect()))
    assert common.rows_among(rows, ids.limit(0)).count() == 0 and common.rows_among(rows.limit(0), ids).count() == 0


def test_full_bitmaps_only_cost_time(spark):
    rows = spark.range(3000).withColumn("text", F.lit("x"))
    assert rows.where(common.maybe_among(spark.range(2000), most_bits=64)).count() >= 2000
