"""Toxicity: subsequence string-kernel support vector machine with Nyström landmarks."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARKS = ".,;:!?*#$%&|\"'()[]{}<>_-~^+=/\\@"
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
LONGEST, STRIDE = 24, 12


def tokens(text: str) -> list[str]:
    """Lower-case words of letters only. What lies within a word is taken out; three or more letters that stand alone, one
    after the other, are one gapped word; long words are cut into overlapping ones."""
    out, run = [], []
    for w in text.lower().split():
        if not w.isalpha():
            w = w.strip(MARKS)
            if not w.isalpha():
                w = "".join(filter(str.isalpha, w))
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) > 2:
                out.append("".join(run))
            run = []
        out.append(w)
    if len(run) > 2:
        out.append("".join(run))
    return [x for w in out if len(w) > 1 for x in ((w,) if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - STRIDE, STRIDE)])]


def codes(words: list[str]) -> np.ndarray:
    """Code points between edge marks, padded by 0 to a common width: an insult's first and last letters tell it from a part of a word."""
    marked = np.array([f"^{w}$" for w in words])
    return marked.view(np.int32).reshape(len(words), -1)


def subsequence_kernel(a: list[str], b: list[str], order: int = 3, decay: float = 0.6) -> np.ndarray:
    """Gap-weighted subsequence kernel of all of a with all of b, not normalised, for all words at once.

    K_p sums decay ** (spans in both words) over common subsequences of p letters.
    """
    s, t = codes(a), codes(b)
    n, m = s.shape[1], t.shape[1]
    far = np.subtract.outer(np.arange(m), np.arange(m))
    gaps = np.where(far <= 0, decay ** (-far.astype(float)), 0.0).astype(np.float32)  # later letters of b gather earlier matches
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    # inner[i][:, :, j]: pairs of subsequences of i letters, weighted from their starts up to here (K' of the recursion).
    inner = [np.ones((len(a), len(b), m), dtype=np.float32)] + [np.zeros((len(a), len(b), m), dtype=np.float32) for _ in range(order - 1)]
    for x in range(n):
        same = ((s[:, x, None, None] == t[None]) & (s[:, x, None, None] > 0)).astype(np.float32) * np.float32(decay**2)
        total += np.einsum("abm,abm->ab", same, inner[order - 1])
        for i in range(order - 1, 0, -1):
            fresh = ((same * inner[i - 1]).reshape(-1, m) @ gaps).reshape(same.shape)
            inner[i] *= np.float32(decay)
            inner[i][:, :, 1:] += fresh[:, :, :-1]
    return total


def self_kernel(words: list[str]) -> np.ndarray:
    """K(w, w), at least a small number for words without so many letters."""
    found = [subsequence_kernel([w], [w])[0, 0] for w in words] if len(words) < 64 else None
    if found is None:
        s, decay, order = codes(words), 0.6, 3
        m = s.shape[1]
        far = np.subtract.outer(np.arange(m), np.arange(m))
        gaps = np.where(far <= 0, decay ** (-far.astype(float)), 0.0).astype(np.float32)
        total, inner = np.zeros(len(words), np.float32), [np.ones((len(words), m), np.float32)] + [np.zeros((len(words), m), np.float32) for _ in range(order - 1)]
        for x in range(m):
            same = ((s[:, x, None] == s) & (s[:, x, None] > 0)).astype(np.float32) * np.float32(decay**2)
            total += (same * inner[order - 1]).sum(axis=1)
            for i in range(order - 1, 0, -1):
                fresh = (same * inner[i - 1]) @ gaps
                inner[i] *= np.float32(decay)
                inner[i][:, 1:] += fresh[:, :-1]
        found = total
    return np.maximum(np.asarray(found, dtype=np.float32), 1e-9)


@dataclass(frozen=True)
class Screen:
    """Longest common subsequences with all landmarks at once, by the bits of a few 64-bit numbers, one bit apart."""

    at: list[tuple[int, int, int]]
    full: np.ndarray
    alphabet: np.ndarray
    masks: np.ndarray
    need: np.ndarray

    @classmethod
    def of(cls, landmarks: list[str], share: float) -> Screen:
        at, number, bit = [], 0, 0
        landmarks = [f"^{x}$" for x in landmarks]
        for x in landmarks:
            if bit + len(x) + 1 > 64:
                number, bit = number + 1, 0
            at.append((number, bit, len(x)))
            bit += len(x) + 1
        full, masks = [0] * (number + 1), {}
        for x, (k, b, size) in zip(landmarks, at):
            full[k] |= ((1 << size) - 1) << b
            for i, c in enumerate(x):
                masks.setdefault(ord(c), [0] * (number + 1))[k] |= 1 << (b + i)
        alphabet = sorted(masks)
        rows = [[0] * (number + 1)] + [masks[c] for c in alphabet]
        need = np.ceil(share * np.array([len(x) for x in landmarks]) - 1e-9).astype(int)
        return cls(at, np.array(full, dtype=np.uint64), np.array(alphabet, dtype=np.int32), np.array(rows, dtype=np.uint64), need)

    def lengths(self, words: list[str]) -> np.ndarray:
        s = codes(words)
        spot = np.minimum(np.searchsorted(self.alphabet, s), len(self.alphabet) - 1)
        spot = np.where(self.alphabet[spot] == s, spot + 1, 0)
        row = np.broadcast_to(self.full, (len(words), len(self.full))).copy()
        for x in range(s.shape[1]):
            u = row & self.masks[spot[:, x]]
            row = ((row + u) | (row - u)) & self.full
        parts = [(row[:, k] >> np.uint64(b)) & np.uint64((1 << size) - 1) for k, b, size in self.at]
        return np.stack([size - np.bitwise_count(p).astype(int) for p, (_, _, size) in zip(parts, self.at)], axis=1)

    def near(self, words: list[str]) -> np.ndarray:
        """Which words have as many letters in common with some landmark as is needed."""
        out = np.zeros(len(words), dtype=bool)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # few widths a block
        for k in range(0, len(order), 20_000):
            some = order[k : k + 20_000]
            out[some] = (self.lengths([words[i] for i in some]) >= self.need).any(axis=1)
        return out


@dataclass(frozen=True)
class Machine:
    """Landmarks, their first `toxic` being insults; the support vector machine in the space they span."""

    landmarks: list[str]
    toxic: int
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    scaling: np.ndarray
    share: float
    norms: np.ndarray
    odds: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; -1 for those with too little in common with any insult to be looked at closer."""
        out = np.full(len(words), -1.0)
        if not words or not self.toxic:
            return out
        near = np.flatnonzero(Screen.of(self.landmarks[: self.toxic], self.share).near(words))
        near = near[np.argsort([len(words[i]) for i in near], kind="stable")]
        for k in range(0, len(near), 1000):
            some = near[k : k + 1000]
            out[some] = np.maximum(-1.0, self.features([words[i] for i in some]) @ self.weights + self.bias)
        return out

    def features(self, words: list[str]) -> np.ndarray:
        cosine = subsequence_kernel(words, self.landmarks) / np.sqrt(self_kernel(words)[:, None] * self.norms)
        return cosine @ self.whiten

    def nearest(self, words: list[str]) -> np.ndarray:
        """The insult landmark most like each word."""
        return cosines(words, self.landmarks[: self.toxic]).argmax(axis=1)

    def evidence(self, texts: list[list[tuple[float, str]]]) -> np.ndarray:
        """For each text's (margin, word) pairs: the worst margin, the mean of the next two, and the worst word's odds."""
        tops = [sorted(((max(0.0, m), x) for m, x in words), reverse=True)[:3] for words in texts]
        out = np.zeros((len(texts), 3))
        for i, top in enumerate(tops):
            out[i, 0] = top[0][0] if top else 0.0
            out[i, 1] = sum(m for m, _ in top[1:]) / 2
        hit = [i for i in range(len(texts)) if out[i, 0] > 0]
        if hit:
            out[hit, 2] = self.odds[self.nearest([tops[i][0][1] for i in hit])] * np.minimum(out[hit, 0], 1.0)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = np.hstack([evidence, np.ones((len(evidence), 1))]) @ self.scaling
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.01, steps: int = 50) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps over its support vectors."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (z @ w) < 1
        a = z[active] * weight[active, None]
        new = np.linalg.solve(a.T @ z[active] + ridge, a.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights of Platt's scaling, with his smoothed targets, the last one for the constant."""
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), 1e-2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (t - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def cosines(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel, in blocks of words of like length."""
    norms, out = self_kernel(b), np.zeros((len(a), len(b)), dtype=np.float32)
    order = sorted(range(len(a)), key=lambda i: len(a[i]))
    for k in range(0, len(a), 1000):
        some = order[k : k + 1000]
        words = [a[i] for i in some]
        out[some] = subsequence_kernel(words, b) / np.sqrt(self_kernel(words)[:, None] * norms)
    return out


def fit(rows: list[tuple[str, int]], insults: int = 32, others: int = 32, share: float = 0.8, odds: float = 12.0) -> Machine:
    """Learns from (text, 0 or 1); equal texts count once.

    Words whose odds of standing in a toxic text are high are witnesses of toxicity. The insult landmarks are the
    most frequent of them that are unlike each other; the other landmarks are the words of clean texts that come closest to
    them. The machine separates witnesses from the words of clean texts that pass its screen; a text's score is
    calibrated on all the rows from its three worst words and from how often the landmark nearest to the worst is toxic.
    """
    # One string for a word of many texts keeps the driver's memory low.
    held = list(dict.fromkeys((frozenset(map(sys.intern, tokens(t or ""))), y) for t, y in rows))
    bad, good = [w for w, y in held if y], [w for w, y in held if not y]
    in_bad, in_good = Counter(x for w in bad for x in w), Counter(x for w in good for x in w)

    def ratio(x: str) -> float:
        return (in_bad[x] / (len(bad) + 1)) / ((in_good[x] + 0.5) / (len(good) + 1))

    # A word in one text of hundreds is in a second by chance now and then.
    least = 3 if len(bad) > 20 else 2
    witness = sorted(x for x in in_bad if 3 <= len(x) <= LONGEST and in_bad[x] >= least and ratio(x) >= odds)
    if not witness or not good:
        return Machine([], 0, np.zeros((0, 0)), np.zeros(0), -1.0, np.array([0.0, 0.0, 0.0, -3.0]), share, np.zeros(0), np.zeros(0))
    number, chosen = {x: i for i, x in enumerate(witness)}, []
    alike = cosines(witness, witness)
    for x in sorted(witness, key=lambda x: (-in_bad[x], x)):
        if len(chosen) < insults and (not chosen or alike[number[x], [number[c] for c in chosen]].max() < 0.6):
            chosen.append(x)
    clean = sorted(in_good.keys() - number.keys())
    near = [clean[i] for i in np.flatnonzero(Screen.of(chosen, share).near(clean))]
    close = cosines(near, chosen).max(axis=1) if near else np.zeros(0)
    hard = [near[i] for i in np.argsort(-close, kind="stable")]
    landmarks = chosen + hard[:others]
    norms = self_kernel(landmarks)
    values, vectors = np.linalg.eigh(cosines(landmarks, landmarks).astype(float))
    whiten = vectors / np.sqrt(np.maximum(values, 0.02)) @ vectors.T
    negative = hard[:10_000] + hard[10_000:][:: max(1, len(hard) // 10_000)]
    # Insults with a letter doubled or put in are insults too.
    spoilt = {v: in_bad[w] / len(w) for w in chosen for i in range(1, len(w)) for v in (w[:i] + w[i - 1 :], w[:i] + "x" + w[i:]) if v not in in_good}
    positive = {**{w: float(in_bad[w]) for w in witness}, **{v: n for v, n in spoilt.items() if v not in number}}
    x = (cosines([*positive, *negative], landmarks) @ whiten).astype(float)
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.array([*positive.values(), *(1.0 + in_good[w] for w in negative)])
    weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum() if negative else 1.0
    weights, bias = squared_hinge(x, y, weight / weight.mean(), penalty=1e-4 * len(y))
    machine = Machine(landmarks, len(chosen), whiten, weights, bias, np.zeros(4), share, norms, np.zeros(len(chosen)))
    words = sorted(in_bad.keys() | in_good.keys())
    margin = dict(zip(words, machine.margins(words)))
    # Of the texts whose worst word is nearest to a landmark, the log odds of being toxic.
    labels, pairs = np.array([y for _, y in held], dtype=float), [[(margin[x], x) for x in w] for w, _ in held]
    worst = [max(p, default=(-1.0, "")) for p in pairs]
    hit = [i for i, (m, _) in enumerate(worst) if m > 0.3]
    place = machine.nearest([worst[i][1] for i in hit]) if hit else np.zeros(0, dtype=int)
    ones, all_ = np.bincount(place, labels[hit], len(chosen)), np.bincount(place, minlength=len(chosen))
    machine = replace(machine, odds=np.log((ones + 0.5) / (all_ - ones + 0.5)))
    return replace(machine, scaling=logistic(machine.evidence(pairs), labels))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 6000, max_chars: int = 20_000
) -> Machine:
    """Fits on a bounded sample: at most `max_rows` labelled texts of at most `max_chars` characters, the lowest hashes
    of text first, as many of either label where there are enough."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sized = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, max_chars))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, n in counts.items():
        wanted = max_rows // 2
        part = marks.where(F.col("y") == y).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, 1.5 * wanted / n) * (1 << 30))
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return fit([])
    few = sized.join(picked, "id")
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("text"), "id"))).where(F.col("r") <= max_rows // 2)
    return fit([(r["text"], r["y"]) for r in ranked.select("text", "y").orderBy("y", "r").collect()])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.3) -> DataFrame:
    """One row for each document: id_col, score, predicted, worst (the word that decides), sentence (the first that holds it).

    The whole text is scored by the worst three of its words. Gapped words are joined and marks within words taken out first;
    the kernel takes inserted letters. NULL or empty text: the score of a text without any such word. Repeated rows: each
    by itself. Work is by row, without a shuffle; the model is of at most 128 landmarks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for frame in frames:
            texts = [t or "" for t in frame["text"]]
            sets = [set(tokens(t)) for t in texts]
            fresh = list(set().union(*sets) - known.keys())
            if len(known) > 300_000:
                known.clear()
                fresh = list(set().union(*sets))
            known.update(zip(fresh, machine.margins(fresh).tolist()))
            worst = [max(((known[x], x) for x in s), default=(-1.0, "")) for s in sets]
            evidence = machine.evidence([[(known[x], x) for x in s if known[x] > 0] for s in sets])
            names = [x if m > -1.0 else None for m, x in worst]
            sentences = [next((q for q in SENTENCE.findall(t) if x in tokens(q)), None) if x and m > 0 else None for t, (m, x) in zip(texts, worst)]
            scores = machine.score(evidence)
            yield pd.DataFrame({"id": frame["id"], "score": scores, "predicted": (scores >= min_score).astype(np.int32), "worst": names, "sentence": sentences})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, score double, predicted int, worst string, sentence string")
    return found.withColumnRenamed("id", id_col)
