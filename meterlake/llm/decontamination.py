"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def smith_waterman(item: list[str], passage: list[str], match: int = 2, mismatch: int = -1, gap: int = -1) -> float:
    """Best local alignment of words, as a part of the score of the item against itself; 0 for an empty item."""
    if not item or not passage:
        return 0.0
    codes: dict[str, int] = {}
    a = [codes.setdefault(w, len(codes)) for w in item]
    b = np.array([codes.get(w, -1) for w in passage])
    steps = -gap * np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, dtype=np.int64), 0
    for code in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(b == code, match, mismatch), row[1:] + gap)
        # Gaps along the passage: the best of all earlier cells less their distance.
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        best = max(best, int(row.max()))
    return best / (match * len(a))


def align(docs: DataFrame, items: list[tuple[object, list[str]]], n: int, min_score: float, kinds: dict[str, str]) -> DataFrame:
    """Rows (id, item, score, passage) of stretches of documents that share n-grams with items, from `min_score` on."""
    vocabulary: dict[str, int] = {}
    grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for c, (_, w) in enumerate(items):
        ids = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in w]
        for p in range(len(ids) - n + 1):
            grams.setdefault(tuple(ids[p : p + n]), []).append((c, p))
    bags = [Counter(w) for _, w in items]
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, grams, bags, items))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, grams, bags, items = held.value
        get = vocabulary.get
        for frame in frames:
            out, scored = [], {}
            for key, text in zip(frame["id"], frame["text"]):
                w = words(text)
                if len(w) < n:
                    continue
                ids = np.fromiter((get(x, 0) for x in w), dtype=np.int64, count=len(w))
                known = np.concatenate([[0], np.cumsum(ids > 0)])
                found: dict[tuple[int, int], tuple[int, int]] = {}
                for p in np.flatnonzero(known[n:] - known[:-n] == n).tolist():
                    gram = tuple(ids[p : p + n].tolist())
                    for c, q in grams.get(gram, ()):
                        place = c, (p - q) // len(items[c][1])
                        low, high = found.get(place, (p - q, p - q))
                        found[place] = min(low, p - q), max(high, p - q)
                for (c, _), (low, high) in found.items():
                    item, body = items[c]
                    slack = len(body) // 4 + 2
                    begin, end = max(0, low - slack), min(len(w), high + len(body) + slack)
                    if known[end] - known[begin] < min_score * len(body):
                        continue
                    passage = tuple(w[begin:end])
                    # No alignment scores more than the words in common, in any order, would.
                    if (bags[c] & Counter(passage)).total() < min_score * len(body):
                        continue
                    if (c, passage) not in scored:
                        scored[c, passage] = smith_waterman(body, list(passage))
                    if scored[c, passage] >= min_score:
                        out.append((key, item, scored[c, passage], " ".join(passage)))
            yield pd.DataFrame(out, columns=["id", "item", "score", "passage"])

    return docs.mapInPandas(run, f"id {kinds['id']}, item {kinds['item']}, score double, passage string")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 4,
    min_score: float = 0.5,
    block_words: int = 1_000_000,
) -> DataFrame:
    """Pairs (id_col, item_col, score, passage) of documents and the benchmark items they hold a copy of.

    Lower-case words of letters and digits. Documents and items meet on word n-grams, each of which is a seed, however
    many documents hold it, so that a copy is found whatever the others hold. Passages around seeds are aligned to the item
    word by word and scored as a part of the item's own score; a pair counts from `min_score` on, with its best passage.

    The items are taken in blocks of at most `block_words` words and one more item, the only thing that is broadcast; each
    block is one pass over the documents. Work is by document: copies in many documents need no group.

    NULL or empty texts and items, and items of under n words: in no pair. Repeated rows: pairs once for each id. Empty
    tables: no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {"id": dict(rows.dtypes)["id"], "item": dict(benchmark.select(F.col(item_col).alias("item")).dtypes)["item"]}
    found, waiting, size = [], [], 0
    for r in benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).toLocalIterator():
        waiting.append((r["item"], words(r["text"])))
        size += len(waiting[-1][1])
        if size >= block_words:
            found.append(align(rows, waiting, n, min_score, kinds))
            waiting, size = [], 0
    found.append(align(rows, waiting, n, min_score, kinds))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    best = pairs.groupBy("id", "item").agg(F.max(F.struct("score", "passage")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.score", "best.passage")
