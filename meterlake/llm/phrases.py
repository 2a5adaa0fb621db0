"""Phrase collocation mining: Misra-Gries summaries by hash partition find candidates, a second pass counts them exactly."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, cut_lineage, in_bitmap, mix64
from .jaccard import _BASE, _BYTES, _INVERSE, powers

_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, the ends of pieces as line feeds, tabs as spaces.
_FOLD = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[ \n]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PROBES = [np.uint64(x) for x in (0x0, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)]


def folded(text: str | None, chunk: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """The folded bytes in chunks, each with the next longest - 1 words, and how many of its bytes begin words of its own."""
    raw, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0
    ahead = re.compile(rb"(?:[ \n]*[^ \n]+){0,%d}" % (longest - 1))
    while len(raw) - at > chunk:
        gap = _GAP.search(raw, at + chunk)
        if gap is None:
            break
        end = gap.start()
        yield raw[at : ahead.match(raw, end).end()], end - at
        at = end
    yield raw[at:], len(raw) - at


class Words:
    """The words of several chunks, and a 64-bit hash for each run of 1 to `longest` words of a piece."""

    def __init__(self, chunks: list[tuple[bytes, int, int]], langs: list[str], longest: int):
        self.text = b"\n".join(c for c, _, _ in chunks)
        raw = np.frombuffer(self.text, dtype=np.uint8)
        word = (raw != 32) & (raw != 10)
        edge = np.diff(word, prepend=False, append=False)
        places = np.flatnonzero(edge)
        self.begins, self.ends = places[::2], places[1::2]
        starts = np.cumsum([0, *(len(c) + 1 for c, _, _ in chunks)])[:-1]
        of = np.searchsorted(starts, self.begins, side="right") - 1
        own = self.begins - starts[of] < np.array([o for _, o, _ in chunks])[of]
        self.lang = np.array([x for _, _, x in chunks])[of]
        piece = np.cumsum(raw == 10)[self.begins] if len(raw) else np.empty(0, dtype=np.int64)
        self.words = np.bincount(self.lang[own], minlength=len(langs))
        prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw] * powers(_BASE, len(raw)), out=prefix[1:])
        single = (prefix[self.ends] - prefix[self.begins]) * powers(_INVERSE, len(raw))[self.begins]
        single = mix64(single ^ mix64((self.ends - self.begins).astype(np.uint64)))
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], dtype=np.uint64)
        run = mix64(single ^ mix64(seeds)[self.lang])
        self.first, self.hashes, at = [], [], np.flatnonzero(own)
        for n in range(1, longest + 1):
            if n > 1:
                at = at[at + n - 1 < len(single)]
                at = at[piece[at] == piece[at + n - 1]]
                run[at] = mix64(run[at] * _STEP + single[at + n - 1])
            self.first.append(at)
            self.hashes.append(run[at])

    def phrase(self, i: int, n: int) -> str:
        """Words i to i + n - 1, joined by single spaces."""
        raw = self.text[self.begins[i] : self.ends[i + n - 1]]
        return b" ".join(x for x in raw.split(b" ") if x).decode("utf-8", "surrogatepass")


def read_words(batches: Iterator[pa.RecordBatch], longest: int, chunk: int) -> Iterator[tuple[Words, list[str]]]:
    """(lang, text) batches as Words of about `chunk` bytes each."""
    for batch in batches:
        chunks, held, langs = [], 0, {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for raw, own in folded(text.as_py(), chunk, longest):
                chunks.append((raw, own, langs.setdefault(lang, len(langs))))
                held += len(raw)
                if held > chunk:
                    yield Words(chunks, list(langs), longest), list(langs)
                    chunks, held = [], 0
        if chunks:
            yield Words(chunks, list(langs), longest), list(langs)


def dealt(hashes: np.ndarray, partitions: int) -> np.ndarray:
    """Keys: the hash partition in the high 32 bits, by the hash's high half, and the hash's low half."""
    return (((hashes >> np.uint64(32)) * np.uint64(partitions)) & ~np.uint64(0xFFFFFFFF)) | (hashes & np.uint64(0xFFFFFFFF))


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, and counts, byte plane by byte plane."""
    both = np.concatenate([np.diff(keys, prepend=np.uint32(0)), np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)])
    return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
    return np.cumsum(both[: len(both) // 2], dtype=np.uint32), both[len(both) // 2 :].astype(np.int64)


class MisraGries:
    """A mergeable summary of at most `capacity` counters (while merging, of one buffer more).

    A merge adds counters and takes the (capacity + 1)-th largest off all, so each unit of `lost` was taken off at least
    capacity + 1 counters: a true count is at most counter + lost, and lost <= mass / (capacity + 1).
    """

    def __init__(self, capacity: int, buffer: int = 1 << 20):
        self.capacity, self.buffer, self.lost = capacity, buffer, 0
        self.keys, self.counts = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        self.waiting, self.held = [], 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > max(self.capacity, self.buffer):
            self.fold()

    def fold(self) -> None:
        if not self.held:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.counts, self.waiting, self.held = keys[firsts], np.add.reduceat(counts, firsts), [], 0
        if len(self.keys) > self.capacity:
            least = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.lost += least
            kept = self.counts > least
            self.keys, self.counts = self.keys[kept], self.counts[kept] - least

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys whose true count can reach the threshold."""
        self.fold()
        return self.keys[self.counts + self.lost >= threshold]


def summaries(rows: DataFrame, partitions: int, longest: int, flush: int, chunk: int) -> DataFrame:
    """(p, kind, mass, counts): for each flush of a task and hash partition its mass (kind 0) and exact counters (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            keys = np.concatenate(held)
            keys.sort()
            firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.diff(np.append(firsts, len(keys)))
            keys = keys[firsts]
            p = (keys >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            ends = np.append(cuts[1:], len(p))
            low = keys.astype(np.uint32)
            blobs = [pack_counts(low[a:b], counts[a:b]) for a, b in zip(cuts, ends)]
            mass, none = np.add.reduceat(counts, cuts), [None] * len(cuts)
            columns = [
                pa.array(np.concatenate([p[cuts]] * 2)), pa.array([0] * len(cuts) + [1] * len(cuts), pa.int32()),
                pa.array(np.concatenate([mass, mass]).astype(np.int64)), pa.array(none + blobs, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["p", "kind", "mass", "counts"])

        for words, _ in read_words(batches, longest, chunk):
            held += [dealt(h, partitions) for h in words.hashes]
            size += sum(map(len, words.hashes))
            if size > flush:
                yield emit()
                held, size = [], 0
        if size:
            yield emit()

    return rows.mapInArrow(run, "p long, kind int, mass long, counts binary")


def frequent_slots(parts: DataFrame, threshold: int) -> DataFrame:
    """(slot): three probes for each key that can have `threshold` occurrences.

    Each hash partition is one summary, read in order: first all its masses, which set the capacity above mass /
    threshold, then its counters, a row at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mass, summary = None, 0, None

        def close() -> pd.DataFrame:
            keys = (np.uint64(at) << np.uint64(32)) | summary.survivors(threshold).astype(np.uint64)
            return pd.DataFrame({"slot": np.concatenate([mix64(keys ^ probe) for probe in _PROBES]).view(np.int64)})

        for frame in frames:
            for p, kind, m, counts in zip(frame["p"], frame["kind"], frame["mass"], frame["counts"]):
                if p != at:
                    if summary is not None:
                        yield close()
                    at, mass, summary = p, 0, None
                if kind == 0:
                    mass += m
                else:
                    summary = summary or MisraGries(mass // threshold + 1)
                    summary.merge(*unpack_counts(counts))
        if summary is not None:
            yield close()

    return parts.repartition("p").sortWithinPartitions("p", "kind").mapInPandas(run, "slot long")


def exact_counts(rows: DataFrame, slots: np.ndarray, partitions: int, longest: int, chunk: int, most: int = 200_000) -> DataFrame:
    """(lang, phrase, f): occurrences of every phrase whose key is among the slots; phrase NULL: all words of the language.

    A task's counts go out by hash partition, as (p, counts) of packed lists; a partition has about as many phrases as its
    summary had counters, and sums them in one dictionary.
    """
    held = rows.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = {}, {}

        def emit() -> pa.RecordBatch:
            hashes = np.fromiter(counts, dtype=np.uint64, count=len(counts))
            p = (dealt(hashes, partitions) >> np.uint64(32)).astype(np.int64)
            order, hashes = np.argsort(p, kind="stable"), hashes.tolist()
            cuts = np.flatnonzero(np.diff(p[order], prepend=-1))
            groups = [[(*names[hashes[i]], counts[hashes[i]]) for i in part] for part in np.split(order, cuts[1:])]
            blobs = [zstandard.ZstdCompressor(level=1).compress(pickle.dumps(list(zip(*sorted(g))))) for g in groups]
            return pa.RecordBatch.from_arrays([pa.array(p[order][cuts]), pa.array(blobs, pa.binary())], ["p", "counts"])

        for words, langs in read_words(batches, longest, chunk):
            for n, (first, hashes) in enumerate(zip(words.first, words.hashes), 1):
                keys = dealt(hashes, partitions)
                for probe in _PROBES:
                    known = in_bitmap(held.value, mix64(keys ^ probe))
                    first, hashes, keys = first[known], hashes[known], keys[known]
                found, where, times = np.unique(hashes, return_index=True, return_counts=True)
                for h, i, c in zip(found.tolist(), first[where].tolist(), times.tolist()):
                    if h not in counts:
                        counts[h], names[h] = 0, (langs[words.lang[i]], words.phrase(i, n))
                    counts[h] += c
            for x, n in zip(langs, words.words.tolist()):
                # No phrase is empty: it stands for the words of the language.
                key = xxhash.xxh3_64_intdigest(b"\0" + x.encode("utf-8", "surrogatepass"))
                names[key] = (x, "")
                counts[key] = counts.get(key, 0) + n
            if len(counts) > most:
                yield emit()
                counts, names = {}, {}
        if counts:
            yield emit()

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, Counter()

        def close() -> pd.DataFrame:
            return pd.DataFrame([(lang, phrase or None, f) for (lang, phrase), f in sums.items()], columns=["lang", "phrase", "f"])

        for frame in frames:
            for p, blob in zip(frame["p"], frame["counts"]):
                if p != at:
                    yield close()
                    at, sums = p, Counter()
                for lang, phrase, f in zip(*pickle.loads(zstandard.ZstdDecompressor().decompress(blob))):
                    sums[lang, phrase] += f
        yield close()

    found = rows.mapInArrow(run, "p long, counts binary")
    return found.repartition("p").sortWithinPartitions("p").mapInPandas(merge, "lang string, phrase string, f long")


def mine(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    threshold: int = 100,
    longest: int = 5,
    top: int = 2000,
    flush: int = 6_000_000,
    chunk: int = 2 << 20,
) -> DataFrame:
    """Each language's first `top` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Words are runs of anything but space and tab, A-Z lower-cased, in pieces between `.,;:!?` and line breaks. A phrase of 2
    to `longest` words with a >= `threshold` occurrences is a candidate. Cut after its first k words, it scores
    1000 a n div (l r) with the occurrences l and r of its parts and n of all words; the lowest cut counts, the first of
    equal ones. Candidates within a longer candidate of as many occurrences are dropped.

    1. Runs of 1 to `longest` words are hashed with their language and dealt to hash partitions. A task counts `flush` runs
       at a time; each partition merges these counts into a Misra-Gries summary with more counters than its mass divided
       by the threshold, so everything frequent survives, and rare runs fall out of memory.
    2. A second pass over the texts counts exactly, by language and text, the runs whose hash survived. The survivors are
       a bitmap of at most 2^27 bits; what passes it by chance is counted too and fails the threshold.
    Parts of a frequent phrase are as frequent, so all l and r are among the counts.

    The number of hash partitions grows with the text (one for 4M characters, up to 65,536). A very long text is read in
    chunks that overlap by longest - 1 words. Scores are taken in decimals of 38 digits.

    NULL language: 'und'. NULL or empty text: no words. Repeated rows count each. Empty table: no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    partitions = int(min(max(size // 4_000_000, 8), 65_536))
    slots = cut_lineage(frequent_slots(summaries(rows, partitions, longest, flush, chunk), threshold))
    bits = 1 << min(max(16, int(6 * slots.count()).bit_length()), 27)
    counted = exact_counts(rows, bitmap(slots, "slot", bits), partitions, longest, chunk)
    counted = cut_lineage(counted.where(F.col("phrase").isNull() | (F.col("f") >= threshold)))
    whole = counted.where("phrase is null").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ", -1)
    found = counted.where("phrase is not null")
    phrases = found.withColumn("words", words).where(F.size("words") > 1).withColumnRenamed("f", "a")

    part = lambda begin, count: F.array_join(F.slice("words", begin, count), " ")
    cuts = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(whole, "lang")
    wide = {x: f"cast({x} as decimal(18,0))" for x in "alrn"}
    score = F.expr(f"cast((cast(1000 as decimal(4,0)) * {wide['a']} * cast(n as decimal(15,0))) div ({wide['l']} * {wide['r']}) as bigint)")
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = phrases.where(F.size("words") > 2)
    inner = longer.select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("phrase"))
    # A longer candidate of as many occurrences has one of just one word more between it and the phrase, with as many.
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = lowest.join(held, ["lang", "phrase"], "left").where("inside is null or 100 * inside < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
