"""Ranked lexical search: posting lists clustered into blocks of similar documents, skipped by coordinatewise maxima."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, cut_lineage, in_bitmap, mix64, stored

#: Of the ASCII bytes only letters and digits are parts of terms; A-Z are lower-cased. Other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_PIECE = 1 << 22
_LAST = (1 << 63) - 1


def term_counts(text: str | None) -> Counter:
    """Terms, as UTF-8, with their occurrences; a long text is read in pieces."""
    raw, found, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def term_hash(term: bytes) -> int:
    """63 bits, so that it is a positive long."""
    return xxhash.xxh3_64_intdigest(term) >> 1


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, term) of the items, terms as hashes."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[term_hash(t) for t in term_counts(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "terms"])

    kind = dict(rows.dtypes)["item_id"]
    return rows.mapInArrow(run, f"item_id {kind}, terms array<long>").select("item_id", F.explode("terms").alias("term")).distinct()


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    """Every document's (doc_id, n, terms, tfs): its length, and the occurrences of those terms that are in the bitmap.

    The bitmap only saves space: a term that is in it by chance is looked up and not found later.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        words = held.value

        def look_up(terms: list[bytes]) -> None:
            hashes = np.array([term_hash(t) for t in terms], dtype=np.uint64)
            kept = in_bitmap(words, hashes)
            known.update(zip(terms, np.where(kept, hashes, 0).astype(np.int64).tolist()))

        for batch in batches:
            lengths, terms, tfs = [], [], []
            for text in batch.column(1):
                found = term_counts(text.as_py())
                if len(known) > 500_000:
                    known.clear()
                look_up([t for t in found if t not in known])
                mine = [(h, c) for t, c in found.items() if (h := known[t])]
                lengths.append(found.total())
                terms.append([h for h, _ in mine])
                tfs.append([c for _, c in mine])
            out = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<long>, tfs array<long>")


class Shard:
    """Documents of one flush: rows by document, posting lists by term, and each list's blocks, made when first asked for.

    Summaries of about `held_entries` coordinates are kept; beyond, they are dropped and made again when asked for.
    """

    def __init__(self, ids, begins, cols, impacts, weight, block_docs: int, held_entries: int = 4_000_000):
        self.held, self.held_entries = 0, held_entries
        self.ids, self.begins, self.cols, self.impacts, self.weight, self.block_docs = ids, begins, cols, impacts, weight, block_docs
        self.of = np.repeat(np.arange(len(ids)), np.diff(begins))
        order = np.argsort(cols, kind="stable")
        self.listed, sorted_cols = self.of[order], cols[order]
        self.list_begins = np.searchsorted(sorted_cols, np.arange(len(weight) + 1))
        self.top = np.zeros(len(weight), dtype=np.int64)
        np.maximum.at(self.top, cols, impacts)
        self.blocks: dict[int, tuple] = {}
        self.sketch = None

    def rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of these documents' postings, and where each document's begin."""
        sizes = self.begins[docs + 1] - self.begins[docs]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return np.repeat(self.begins[docs] - starts[:-1], sizes) + np.arange(starts[-1]), starts[:-1]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        at, starts = self.rows(docs)
        return np.add.reduceat(weights[self.cols[at]] * self.impacts[at], starts)

    def sketches(self, dims: int = 32) -> np.ndarray:
        """Documents as unit vectors: weighted impacts, with hashed signs, summed into a few dimensions."""
        if self.sketch is None:
            h = mix64(np.arange(1, len(self.weight) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            slot, sign = (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
            mass = self.weight[self.cols] * self.impacts * sign[self.cols]
            flat = np.bincount(self.of * dims + slot[self.cols], mass, minlength=len(self.ids) * dims).reshape(-1, dims)
            self.sketch = (flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        return self.sketch

    def list_blocks(self, term: int) -> tuple:
        """A posting list's (documents in order of blocks, block begins, summary begins, coordinates, maxima).

        Members go to the most similar of evenly spaced centres; a centre's members are cut into blocks of at most
        `block_docs`. A block's summary holds, for every term of any of its documents, the largest impact in the block.
        """
        if term not in self.blocks:
            docs = self.listed[self.list_begins[term] : self.list_begins[term + 1]]
            points = self.sketches()[docs]
            centres = points[:: self.block_docs]
            nearest = np.concatenate([(points[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(docs), 4096)])
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            firsts = np.flatnonzero(np.diff(nearest, prepend=-1))
            place = np.arange(len(docs)) - np.repeat(firsts, np.diff(np.append(firsts, len(docs))))
            begins = np.flatnonzero(place % self.block_docs == 0)
            block = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(docs))))
            coords, maxima, counts = [], [], np.zeros(len(begins), dtype=np.int64)
            for lo in range(0, len(begins), 256):
                hi = min(lo + 256, len(begins))
                part = slice(begins[lo], begins[hi] if hi < len(begins) else len(docs))
                at, _ = self.rows(docs[part])
                sizes = (self.begins[1:] - self.begins[:-1])[docs[part]]
                key = (np.repeat(block[part] - lo, sizes) << 40) | (self.cols[at] << 20) | self.impacts[at]
                key.sort()
                last = np.flatnonzero(np.append((key[1:] >> 20) != (key[:-1] >> 20), True))
                kept = key[last]
                counts[lo:hi] = np.bincount(kept >> 40, minlength=hi - lo)
                coords.append(((kept >> 20) & 0xFFFFF).astype(np.int32))
                maxima.append((kept & 0xFFFFF).astype(np.int32))
            summary = np.concatenate([[0], np.cumsum(counts)[:-1]])
            if self.held > self.held_entries:
                self.blocks, self.held = {}, 0
            self.held += sum(map(len, coords))
            self.blocks[term] = docs, np.append(begins, len(docs)), summary, np.concatenate(coords), np.concatenate(maxima)
        return self.blocks[term]


class Best:
    """The k best (score, id) so far, equal scores by smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def search_shard(shard: Shard, terms: np.ndarray, best: Best) -> int:
    """Offers the shard's documents that can be among the best; returns how many were scored.

    Lists are opened from the largest possible contribution down. A document that no earlier list holds has no weight on
    earlier terms, so a block's bound is taken over the terms from this list on, and a block, or all lists left, are
    skipped only where the bound is below the least score of the best. Equal bounds aren't skipped.
    """
    most = shard.weight[terms] * shard.top[terms]
    order = np.argsort(-most, kind="stable")
    terms, left = terms[order], np.cumsum(most[order][::-1])[::-1]
    weights = np.zeros(len(shard.weight), dtype=np.int64)
    weights[terms] = shard.weight[terms]
    ahead, seen, scored = weights.copy(), np.zeros(len(shard.ids), dtype=bool), 0
    for term, bound in zip(terms.tolist(), left.tolist()):
        if bound < best.least:
            break
        size = shard.list_begins[term + 1] - shard.list_begins[term]
        if size > shard.block_docs:
            docs, begins, summary, coords, maxima = shard.list_blocks(term)
            bounds = np.add.reduceat(ahead[coords] * maxima, summary)
            queue, step = np.argsort(-bounds, kind="stable"), 2
            while len(queue):
                now, queue = queue[:step], queue[step:]
                now = now[bounds[now] >= best.least]
                if not len(now):
                    break
                step *= 2
                mine = np.concatenate([docs[begins[b] : begins[b + 1]] for b in now])
                mine = mine[~seen[mine]]
                seen[mine] = True
                scored += len(mine)
                if len(mine):
                    best.offer(shard.scores(mine, weights), shard.ids[mine])
        elif size:
            # One block: to score its documents costs no more than its summary.
            mine = shard.listed[shard.list_begins[term] : shard.list_begins[term + 1]]
            mine = mine[~seen[mine]]
            seen[mine] = True
            scored += len(mine)
            if len(mine):
                best.offer(shard.scores(mine, weights), shard.ids[mine])
        ahead[term] = 0
    return scored


def search_block(rows: DataFrame, queries: pa.Table, n_docs: int, n_terms: int, k: int, shard_postings: int, block_docs: int) -> DataFrame:
    """(q, doc_id, score): the best of each task for each item of a block of queries (q, term, w)."""
    vocabulary, first = np.unique(queries.column("term").to_numpy(), return_index=True)
    weight = queries.column("w").to_numpy()[first]
    q = queries.column("q").to_numpy()
    order = np.argsort(q, kind="stable")
    at = np.searchsorted(vocabulary, queries.column("term").to_numpy())[order]
    names, cuts = np.unique(q[order], return_index=True)
    held = rows.sparkSession.sparkContext.broadcast((vocabulary, weight, names, np.split(at, cuts[1:])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weight, names, items = held.value
        best = [Best(k) for _ in items]
        parts, waiting = [], 0

        def flush() -> None:
            ids, sizes, cols, impacts = (np.concatenate(x) for x in zip(*parts))
            shard = Shard(ids, np.concatenate([[0], np.cumsum(sizes)]), cols, impacts, weight, block_docs)
            for terms, mine in zip(items, best):
                search_shard(shard, terms, mine)

        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            terms, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            of = np.repeat(np.arange(len(sizes)), sizes)
            cols = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
            known = vocabulary[cols] == terms
            of, cols, tf = of[known], cols[known], tf[known]
            m = np.array([50 + 50 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], dtype=np.int64)
            impacts = 1_000_000_000 * tf // (1000 * tf + 20 * m[of])
            sizes = np.bincount(of, minlength=len(sizes))
            ids, some = batch.column(0).fill_null(_LAST).to_numpy(), np.flatnonzero(sizes)
            ends = np.cumsum(sizes[some])
            lo = 0
            while lo < len(some):
                begin = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begin + shard_postings - waiting, side="right")))
                parts.append((ids[some[lo:hi]], sizes[some[lo:hi]], cols[begin : ends[hi - 1]], impacts[begin : ends[hi - 1]]))
                waiting += int(ends[hi - 1] - begin)
                lo = hi
                if waiting >= shard_postings or lo < len(some):
                    flush()
                    parts, waiting = [], 0
        if waiting:
            flush()
        for name, mine in zip(names.tolist(), best):
            if len(mine.ids):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(mine.ids), pa.int64()), pa.array(mine.ids), pa.array(mine.scores)], ["q", "doc_id", "score"])

    return rows.mapInArrow(run, "q long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 50,
    block_terms: int = 200_000,
    shard_postings: int = 400_000,
    block_docs: int = 64,
) -> DataFrame:
    """Each item's `k` best documents with a score above 0: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A term in df of N documents (with a
    term) weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n of all L terms has the normaliser
    m = 50 + 50 n N div L, and its score sums weight * (10^9 tf div (1000 tf + 20 m)) over the item's distinct terms.

    1. One pass over the texts stores each document's length and the occurrences of terms that any item asks for.
    2. For each block of items (about `block_terms` terms, by a hash of the id; a single one unless there are many
       thousand items), tasks build an index of `shard_postings` postings at a time: see Shard. An item's posting lists
       are opened in turn, and blocks skipped by their summaries' exact bounds: see search_shard. A task keeps the best of
       all its shards, so later shards skip more.
    3. The tasks' best are merged in two steps, so that no task gets those of all.

    The driver holds one block of items, N, L and a bitmap of 2^23 bits. NULL and empty texts: no term, never found.
    NULL item text: no rows. Equal scores: smaller id first, NULL ids last. Repeated items of one id are one item with the
    terms of all; repeated documents are ranked each. Ids are below 2^63 - 1. Empty tables: no rows.
    """
    asked = cut_lineage(item_terms(items, item_col, item_text_col))
    rows = stored(postings(docs, id_col, text_col, bitmap(asked, "term", 1 << 23)), "search-postings")
    whole = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
    w = F.floor(1000 * F.log(F.lit(2.0 * whole[0] + 2) / (2 * F.col("count") + 1))).cast("long")
    weighed = asked.join(df, "term").select("item_id", "term", w.alias("w")).where("w > 0")
    keys = cut_lineage(weighed.select("item_id").distinct().withColumn("q", F.monotonically_increasing_id()))
    size = weighed.count()
    blocks = max(1, -(-size // block_terms))
    weighed = cut_lineage(weighed.alias("a").join(keys.alias("b"), F.expr("a.item_id <=> b.item_id")).select("b.q", "a.term", "a.w"))
    found = None
    for i in range(blocks if size else 0):
        block = weighed.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow()
        if block.num_rows:
            part = search_block(rows, block, int(whole[0]), int(whole[1]), k, shard_postings, block_docs)
            found = part if found is None else found.unionByName(part)
    if found is None:
        kind = dict(items.dtypes)[item_col]
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    few = found.withColumn("_task", F.spark_partition_id() % 64)
    few = few.withColumn("_rank", F.row_number().over(Window.partitionBy("q", "_task").orderBy(*order))).where(F.col("_rank") <= k)
    ranked = few.select("q", "doc_id", "score", F.row_number().over(Window.partitionBy("q").orderBy(*order)).alias("rank")).where(F.col("rank") <= k)
    doc_id = F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id")
    return ranked.join(keys, "q").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")
