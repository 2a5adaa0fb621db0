"""N-gram Jaccard join: regions of equal token groups, an R-tree over count vectors in each, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.skew import lookup_join

from .common import components, cut_lineage, maybe_among, mix64, stored

#: Odd 64-bit values by byte, and the base of the rolling hash with its inverse modulo 2**64.
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def shingles(text: str | None, n: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; A-Z lower-cased, words split at ASCII white space.

    Fewer than n words: the whole sequence as one shingle; no word: none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * powers(_BASE, len(raw)), out=prefix[1:])
    gaps = np.flatnonzero(raw == 32)
    begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    m = min(n, len(parts))
    begins, ends = begins[: len(begins) - m + 1], ends[m - 1 :]
    hashes = (prefix[ends] - prefix[begins]) * powers(_INVERSE, len(raw))[begins]
    return np.unique(mix64(hashes ^ mix64((ends - begins).astype(np.uint64))))


def size_class(n: int, ratio: float) -> int:
    return int(np.log(max(n, 1)) / np.log(ratio) + 1e-9)


def differing(total: int, percent: int) -> int:
    """Most elements in one of two linked sets only, from the sum of their sizes."""
    return (100 - percent) * total // (100 + percent)


def signatures(hashes: np.ndarray, percent: int, ratio: float = 1.2) -> np.ndarray:
    """A key for each of a set's heavier token groups: linked sets share at least one.

    Sets meet in the size class of the larger; a set whose partner may be of a later class has keys there too. Two
    linked sets of a class differ in at most k elements, so of k + 1 + spare groups (by hash) at least 1 + spare agree.
    The `spare` lightest groups, by size and number, get no key: an agreeing group has the same place in that order's
    tail in both sets, so the heaviest agreeing one is among the k + 1 kept ones in both. A key hashes a group's tokens.
    """
    n, out = len(hashes), []
    for c in range(size_class(n, ratio), size_class(n * 100 // percent, ratio) + 1):
        k = differing(2 * (int(np.ceil(ratio ** (c + 1))) + 1), percent)
        spare = k // 2
        groups = k + 1 + spare
        of = ((hashes >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)
        size = np.bincount(of, minlength=groups)
        sums = np.zeros(groups, dtype=np.uint64)
        np.add.at(sums, of, mix64(hashes ^ np.uint64(c + 1)))
        kept = np.lexsort((np.arange(groups), size))[spare:]
        out.append(mix64(sums[kept] ^ mix64(kept.astype(np.uint64) * np.uint64(4096) + np.uint64(c))))
    return np.concatenate(out)


def count_vector(hashes: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((hashes % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


class CountTree:
    """R-tree over count vectors, packed bottom up in the order of size and coordinates; a node keeps upper corners.

    The overlap of a query with anything below a node is at most the sum over groups of min(query, upper corner).
    """

    def __init__(self, points: np.ndarray, fanout: int = 16):
        sizes = points.sum(axis=1)
        self.order = np.lexsort((*points.T[::-1][:3], sizes))
        self.fanout, level = fanout, points[self.order]
        self.levels, self.least = [level], [sizes[self.order]]
        while len(self.levels[-1]) > 1:
            at = np.arange(0, len(self.levels[-1]), fanout)
            self.levels.append(np.maximum.reduceat(self.levels[-1], at))
            self.least.append(np.minimum.reduceat(self.least[-1], at))

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Points whose bound allows a link: 100 * overlap >= percent * (|a| + |b| - overlap)."""
        size, nodes = int(query.sum()), np.array([0])
        for depth in range(len(self.levels) - 1, -1, -1):
            bound = np.minimum(self.levels[depth][nodes], query).sum(axis=1)
            nodes = nodes[(100 + percent) * bound >= percent * (size + self.least[depth][nodes])]
            if depth and len(nodes):
                nodes = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1])]
            if not len(nodes):
                break
        return self.order[nodes]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = np.intersect1d(a, b, assume_unique=True).size
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def connect(points: np.ndarray, percent: int, test=None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect all points whose bound allows a link and for which the test, if any, holds.

    Points already connected (from the start those of equal labels) needn't be tested, so a thousand near copies take about
    a thousand tests.
    """
    label = np.arange(len(points)) if label is None else label
    if (label == label[0]).all():
        return []
    tree, links = CountTree(points), []
    for i in range(len(points)):
        if (label == label[i]).all():
            break
        near = tree.search(points[i], percent)
        for j in near[(near > i) & (label[near] != label[i])].tolist():
            if label[j] != label[i] and (test is None or test(i, j)):
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


class Forest:
    """Union-find over ids: which are connected so far."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent, at = self.parent, x
        while (up := parent.get(at, at)) != at:
            at = up
        while x != at:
            parent[x], x = at, parent.get(x, x)
        return at

    def join(self, a: int, b: int) -> bool:
        """Whether this edge connects what was apart."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def forest_of(edges: np.ndarray, forest: Forest) -> np.ndarray:
    """Of the (a, b) edges, by ascending b, those that connect what the forest hasn't yet."""
    edges = edges[np.lexsort((edges[:, 0], edges[:, 1]))]
    return edges[[forest.join(a, b) for a, b in edges.tolist()]] if len(edges) else edges


def fewer_edges(edges: DataFrame) -> DataFrame:
    """(a, b) edges with the same components: of each task's edges at most one for each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for frame in frames:
            if len(frame):
                yield pd.DataFrame(forest_of(frame[["a", "b"]].to_numpy(), forest), columns=["a", "b"])
            if len(forest.parent) > 1_000_000:
                forest = Forest()

    return edges.mapInPandas(run, "a long, b long").distinct()


def local_links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets of one region; with two sides, only links between sides are looked for."""
    # As many groups as keep unrelated sets of this size apart.
    groups = int(np.clip(2 ** int(np.log2(max(1, np.mean([len(s) for s in sets]) // 8) + 1)), 64, 512))
    two = len(np.unique(sides)) > 1
    points = np.array([count_vector(s, groups) for s in sets])
    return connect(points, percent, lambda i, j: (not two or sides[i] != sides[j]) and linked(sets[i], sets[j], percent))


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, digest): equal sets have equal digests; NULL for an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(t, n) for t in frame["text"]]
            digests = [whole_key(s) if len(s) else None for s in sets]
            yield pd.DataFrame({"id": frame["id"], "n_shingles": [len(s) for s in sets], "digest": pd.array(digests, dtype="Int64")})

    return rows.mapInPandas(run, "id long, n_shingles long, digest long")


def whole_key(got: np.ndarray) -> int:
    key = np.bitwise_xor.reduce(mix64(got)) ^ mix64(np.array([len(got)], dtype=np.uint64))[0]
    return int(key.view(np.int64))


def packed_regions(keys: np.ndarray, ids: np.ndarray, stars: np.ndarray, buckets: int) -> pd.DataFrame:
    """(bucket, keys, ids, stars): one row for each bucket of keys, about 6 bytes a key.

    The upper half of a key tells its bucket, and only its low 40 bits are sent. Two keys that differ above may so be taken
    for one, which makes a region too large but loses no link. Ids go in ascending order as steps, in as few bytes as these need.
    """
    of = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((ids, of))
    of, ids, stars = of[order], ids[order], stars[order]
    low = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    out, begins = [], np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)])
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(of)]):
        part = ids[lo:hi].astype("<i8")
        steps = np.diff(part.view("<u8"))
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(steps) or int(steps.max()) >> (8 * w) == 0)
        sent = bytes([width]) + part[:1].tobytes() + steps.astype(f"<u{width}").tobytes()
        out.append((of[lo], low[lo:hi].tobytes(), sent, np.packbits(stars[lo:hi]).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "keys", "ids", "stars"])


def unpacked_regions(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (their low 40 bits), ids and stars of the rows of one bucket."""
    raw = np.frombuffer(b"".join(frame["keys"]), dtype=np.uint8).reshape(-1, 5)
    keys = np.zeros((len(raw), 8), dtype=np.uint8)
    keys[:, :5] = raw
    ids, stars = [], []
    for sent, bits in zip(frame["ids"], frame["stars"]):
        first, steps = np.frombuffer(sent[1:9], dtype="<u8"), np.frombuffer(sent[9:], dtype=f"<u{sent[0]}").astype(np.uint64)
        ids.append(np.cumsum(np.concatenate([first, steps]), dtype=np.uint64).view(np.int64))
        stars.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(ids[-1])).astype(bool))
    return keys.view("<u8").ravel(), np.concatenate(ids), np.concatenate(stars)


def met_regions(frame: pd.DataFrame) -> pd.DataFrame:
    """(key, id, low, n, star) of the bucket's keys that several rows have: smallest id, number of rows, whether any is a star."""
    keys, ids, stars = unpacked_regions(frame)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    keys, ids, stars = keys[order], ids[order], stars[order]
    order = np.lexsort((ids, keys))
    keys, ids, stars = keys[order], ids[order], stars[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    sizes = np.diff(np.append(begins, len(keys)))
    star = np.logical_or.reduceat(stars, begins) if len(begins) else stars
    whole = keys.astype(np.int64) | np.int64(frame["bucket"].iloc[0]) << np.int64(40)
    return pd.DataFrame({"key": whole, "id": ids, "low": np.repeat(ids[begins], sizes), "n": np.repeat(sizes, sizes), "star": np.repeat(star, sizes)})


def region_rows(docs: DataFrame, n: int, percent: int, many: int, buckets: int) -> DataFrame:
    """(bucket, keys, ids, stars): region keys of documents, packed by bucket.

    A key that more than `many` documents of a task have is sent with its smallest id alone, marked as a star; the
    others' edges to that id get keys of their own, so that no frequent key brings its documents together in one task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ids, held = [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal keys, ids, held
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(begins, len(k)))
            low, often = np.repeat(i[begins], sizes), np.repeat(sizes > many, sizes)
            first = np.zeros(len(k), dtype=bool)
            first[begins] = True
            edges = np.unique(np.stack([i[often], low[often]], axis=1), axis=0)
            edges = forest_of(edges[edges[:, 0] != edges[:, 1]], Forest())
            own = mix64(mix64(edges[:, 0].astype(np.uint64)) + edges[:, 1].astype(np.uint64))
            sent = ~often | first
            keys, ids, held = [], [], 0
            return packed_regions(
                np.concatenate([k[sent], own, own]), np.concatenate([i[sent], edges[:, 0], edges[:, 1]]),
                np.concatenate([often[sent], np.ones(2 * len(edges), dtype=bool)]), buckets,
            )

        for frame in frames:
            for key, text in zip(frame["id"], frame["text"]):
                got = shingles(text, n)
                # Equal sets have one representative; small unequal ones can't link.
                if len(got) and differing(2 * len(got) + 2, percent):
                    mine = signatures(got, percent)
                    keys.append(mine), ids.append(np.full(len(mine), key, dtype=np.int64))
                    held += len(mine)
                    if held > 500_000:
                        yield flush()
        if held:
            yield flush()

    return docs.mapInPandas(run, "bucket int, keys binary, ids binary, stars binary")


def key_buckets(total_shingles: int, percent: int, bucket_keys: int = 1 << 19) -> int:
    """As many buckets as give each about `bucket_keys` region keys."""
    keys_a_shingle = len(signatures(mix64(np.arange(1000, dtype=np.uint64)), percent)) / 1000
    return min(max(1, -int(-total_shingles * keys_a_shingle // bucket_keys)), 1 << 23)


def vector_groups(n: int) -> int:
    """Coordinates of a set's count vector: a power of two with at most 8 elements each, so that the overlap of unrelated sets stays low."""
    return int(np.clip(1 << max(0, -(-n // 8) - 1).bit_length(), 128, 1 << 14))


def packed_vector(hashes: np.ndarray) -> tuple[int, bytes]:
    """Coordinates and their counts, a byte each or four where one is larger."""
    groups = vector_groups(len(hashes))
    v = count_vector(hashes, groups)
    return groups, v.astype("<u1" if v.max() < 256 else "<i4").tobytes()


def unpacked_vectors(groups: np.ndarray, packed: list[bytes]) -> np.ndarray:
    """Count vectors as rows, folded to the fewest coordinates of any."""
    least = int(groups.min())
    if all(len(p) == least for p in packed):
        return np.frombuffer(b"".join(packed), dtype="<u1").reshape(-1, least).astype(np.int32)
    whole = (np.frombuffer(p, dtype="<u1" if len(p) == g else "<i4").astype(np.int32) for g, p in zip(groups.tolist(), packed))
    return np.stack([v.reshape(-1, least).sum(axis=0, dtype=np.int32) for v in whole])


def bounded_edges(rows: DataFrame, lists: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) edges that connect, within each list of ids, the documents whose count vectors allow a link.

    The lists of a near-copy group mostly repeat each other. Those of one smallest id meet in a task, which sends only the
    edges that connect what its earlier edges haven't: at most one for each document. Vectors grow with the sets, as with a fixed number
    of coordinates all long texts would seem alike and their blocks would grow faster than the corpus.
    """

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [packed_vector(shingles(t, n)) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "groups": [g for g, _ in found], "v": [v for _, v in found]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, forest = None, Forest()
        for frame in frames:
            if not len(frame):
                continue
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held["region"].iloc[-1]
            ready, held = held[held["region"] != last], held[held["region"] == last]
            if len(ready):
                yield edges(ready, forest)
            if len(forest.parent) > 1_000_000:  # what is forgotten is sent again at worst
                forest = Forest()
        if held is not None:
            yield edges(held, forest)

    def edges(frame: pd.DataFrame, forest: Forest) -> pd.DataFrame:
        regions, ids, out = frame["region"].to_numpy(), frame["id"].tolist(), []
        groups, packed = frame["groups"].to_numpy(), frame["v"].tolist()
        cuts = np.flatnonzero(np.diff(regions)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            roots = np.array([forest.root(x) for x in ids[lo:hi]])
            if (roots == roots[0]).all():
                continue
            pairs = ((ids[lo + x], ids[lo + y]) for x, y in connect(unpacked_vectors(groups[lo:hi], packed[lo:hi]), percent, label=roots))
            out += [pair for pair in pairs if forest.join(*pair)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    # A document has a bounded number of keys, so the lists with one smallest id are few.
    members = lists.select(F.xxhash64("ids").alias("region"), F.get("ids", F.lit(0)).alias("low"), F.explode("ids").alias("id"))
    points = rows.where(maybe_among(members.select("id").distinct())).mapInPandas(vectors, "id long, groups int, v binary")
    # Lists have at most a few thousand ids; in order of region, a task holds one batch and one list.
    ordered = members.join(points, "id").repartition("low").sortWithinPartitions("low", "region")
    return ordered.mapInPandas(run, "a long, b long")


def verified_links(members: DataFrame, n: int, percent: int, task_shingles: int) -> DataFrame:
    """(a, b) links among (region, id, size, text): regions beyond `task_shingles` are cut into shards, taken two by two."""
    totals = members.groupBy("region", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.sum("size").alias("s")).groupBy("region").agg(F.ceil(F.sum("s") / task_shingles).cast("int").alias("shards"))
    sharded = members.join(totals, "region").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    placed = sharded.withColumn("other", other).select(
        "region", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "id", "text"
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        sets = [shingles(t, n) for t in frame["text"]]
        ids = frame["id"].to_numpy()
        links = local_links(sets, frame["shard"].to_numpy(), percent)
        return pd.DataFrame({"a": ids[[x for x, _ in links]], "b": ids[[y for _, y in links]]}, dtype="int64")

    return placed.groupBy("region", "i", "j").applyInPandas(run, "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, task_shingles: int = 2_000_000
) -> DataFrame:
    """One row for each document: id_col, n_shingles, component_id (smallest id reachable by links).

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct n-word shingles. No link is lost:
    0. Documents of equal sets are one node, their smallest id; only its text goes on.
    1. Tokens are hashed into more groups than linked sets can differ in, so linked sets agree on a whole group; its
       content is the key of a region. A task sends a frequent key once, and its documents' edges to the smallest id. Keys
       go packed by bucket, a bucket to a task, as there are many a document.
    2. In each region the sets' count vectors (tokens hashed into groups, one coordinate each) are the points of an
       R-tree, which bounds the overlap of pairs by summed coordinate minima. Documents that bounded pairs connect (or, in a
       frequent region, all) form a block. In a block the same tree finds the pairs, which are verified on the sets;
       pairs already connected aren't compared. A block beyond `task_shingles` is cut into shards that meet two by two.
    3. Components of the verified links.
    Texts, not sets, are shuffled, and only those of documents that met another. Shingles are 64-bit hashes.

    ids must be integers. NULL or empty text: 0 shingles, its own component. Repeated rows: one row for each; equal ids are
    one node, also with different texts. A NULL id links with nothing and has a NULL component. Empty table: no rows.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    nameless = shingle_sets(whole.where("id is null").withColumn("id", F.lit(0).cast("long")), n)
    whole = whole.where("id is not null")
    sets = stored(shingle_sets(whole, n), "jaccard-sets")
    first = cut_lineage(sets.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("size")))
    belongs = lookup_join(sets.where("digest is not null").select("id", "digest"), first.select("digest", "rep"), ["digest"])
    belongs = cut_lineage(belongs.select("id", "rep").distinct())
    # Rows of one id with different texts are one node.
    twice = belongs.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b < most").select("id", "b")
    same = belongs.join(twice, "id").select(F.col("rep").alias("a"), "b").where("a <> b")
    rows = whole.where(maybe_among(first.select(F.col("rep").alias("id"))))

    buckets = key_buckets(first.agg(F.sum("size")).first()[0] or 0, percent)
    found = region_rows(rows, n, percent, many=32, buckets=buckets)
    met = cut_lineage(found.groupBy("bucket").applyInPandas(met_regions, "key long, id long, low long, n long, star boolean"))
    stars = met.where("(star or n > 2000) and id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    lists = met.where("not star and n <= 2000").groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    lists = cut_lineage(lists.select("ids").distinct())
    regions = components(cut_lineage(fewer_edges(stars.unionByName(bounded_edges(rows, lists, n, percent)))))
    members = rows.where(maybe_among(regions.select("id"))).join(regions.withColumnRenamed("root", "region"), "id")
    members = members.withColumn("size", F.greatest(F.length("text") / 4, F.lit(400)))
    roots = components(fewer_edges(verified_links(members, n, percent, task_shingles).unionByName(same)))
    placed = belongs.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    placed = placed.groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("root"))
    found = sets.join(placed, "id", "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
    found = found.unionByName(nameless.select(F.lit(None).cast("long").alias("id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return found.withColumnRenamed("id", id_col)
