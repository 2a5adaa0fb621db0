"""Quality classifier: interpolated modified Kneser-Ney model of character n-grams, trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, rows_among

ORDER = 4
BITS = 12
#: Characters below DIRECT have a code of their own, others are spelled with two of the last DIGITS codes.
DIGITS = 1056
DIRECT = (1 << BITS) - 1 - DIGITS
LANG_BITS = 10
#: In a tagged key, from here on: the order of an n-gram, or ORDER + 1 and the length of a context.
TAG = BITS * ORDER + LANG_BITS
#: Characters that are scored at once.
AT_ONCE = 1 << 20


def codes_of(text: str) -> np.ndarray:
    """Codes of the characters, from 1: one for each below DIRECT, else two, so that no two texts have equal codes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    spelled = points >= DIRECT
    if not spelled.any():
        return points + 1
    codes = np.repeat(np.where(spelled, 1 + DIRECT + points // DIGITS, points + 1), 1 + spelled)
    codes[(np.cumsum(1 + spelled) - 1)[spelled]] = 1 + DIRECT + points[spelled] % DIGITS
    return codes


def keys_of(text: str, lang: int) -> list[np.ndarray]:
    """For k = 1..ORDER, the key of the k codes that end at each code; code 0 stands before the text."""
    codes = codes_of(text)
    padded = np.concatenate([np.zeros(ORDER - 1, dtype=np.int64), codes])
    out, key = [], np.zeros(len(codes), dtype=np.int64)
    for k in range(ORDER):
        key = key | (padded[ORDER - 1 - k : len(padded) - k] << (BITS * k))
        out.append(key | (lang << (BITS * ORDER)))
    return out


def lang_number(col: str) -> Column:
    """Ten bits of a hash of the language; NULL is a language of its own. Languages of one number share a model."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(1 << LANG_BITS))


@dataclass(frozen=True)
class Shard:
    """Sorted tagged keys and their values: the probabilities of n-grams, and the weights of the lower order after contexts."""

    tags: np.ndarray
    values: np.ndarray

    def find(self, keys: np.ndarray, code: int, missing: np.ndarray | float) -> np.ndarray:
        tags = keys | (code << TAG)
        at = np.minimum(np.searchsorted(self.tags, tags), len(self.tags) - 1)
        return np.where(self.tags[at] == tags, self.values[at], missing)

    def log_probs(self, grams: np.ndarray) -> np.ndarray:
        """Of the last character of each of the longest n-grams, after the others."""
        lang = grams >> (BITS * ORDER) << (BITS * ORDER)
        prob: np.ndarray | float = 1.0 / (1 << BITS)
        for k in range(1, ORDER + 1):
            gram = grams & ((1 << (BITS * k)) - 1)
            prob = self.find(lang | gram, k, prob * self.find(lang | (gram >> BITS), ORDER + k, 1.0))
        return np.log(prob)


@dataclass(frozen=True)
class Model:
    """All n-grams, in shards by language and last but one character, so that all an n-gram may back off to is in its shard."""

    shards: list[Broadcast[Shard]]

    def shard(self, number: int) -> Shard:
        held = self.shards[number]
        found = held.value
        if len(self.shards) > 1 and vars(held).get("_path"):  # one at a time in memory; it is read again from its file
            vars(held).pop("_value", None)
        return found

    def log_probs_of(self, grams: np.ndarray) -> np.ndarray:
        out = np.empty(len(grams))
        place = shard_number(grams >> (BITS * ORDER), (grams >> BITS) & ((1 << BITS) - 1), len(self.shards))
        for number in np.unique(place).tolist():
            some = place == number
            out[some] = self.shard(number).log_probs(grams[some])
        return out

    def log_probs(self, text: str, lang: int) -> np.ndarray:
        return self.log_probs_of(keys_of(text, lang)[-1])

    def log_sums(self, texts: Sequence[str | None], langs: Sequence[int]) -> np.ndarray:
        """Sum of the log probabilities of each text's characters; distinct n-grams of many texts are looked up once."""
        out, waiting, size = np.zeros(len(texts)), [], 0

        def add() -> None:
            grams, back = np.unique(np.concatenate([g for _, g in waiting]), return_inverse=True)
            starts = np.cumsum([0] + [len(g) for _, g in waiting[:-1]])
            np.add.at(out, [i for i, _ in waiting], np.add.reduceat(self.log_probs_of(grams)[back], starts))

        for i, (text, lang) in enumerate(zip(texts, langs)):
            grams = keys_of(text, lang)[-1] if text else np.zeros(0, dtype=np.int64)
            for at in range(0, len(grams), AT_ONCE):
                waiting.append((i, grams[at : at + AT_ONCE]))
                size += len(waiting[-1][1])
                if size >= AT_ONCE:
                    add()
                    waiting, size = [], 0
        if waiting:
            add()
        return out

    def destroy(self) -> None:
        for held in self.shards:
            held.destroy()


def shard_number(lang, code, shards: int):
    """Of numbers, arrays or columns."""
    mixed = (lang * (1 << BITS) + code) * 2654435761
    return F.pmod(F.shiftright(mixed, 16), F.lit(shards)) if isinstance(mixed, Column) else (mixed >> 16) % shards


def gram_counts(frames: Iterator[pd.DataFrame], at_once: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """(key, c) of the longest n-grams of one task's (lang, text) rows; a key may come again.

    About `at_once` n-grams and one text wait to be added up, and as many distinct ones are held, however many rows a frame has.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[np.ndarray] = []

    def add() -> None:
        held.append(np.unique(np.concatenate(waiting), return_counts=True))
        waiting.clear()
        keys, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        held[:] = [(keys, np.bincount(back, weights=np.concatenate([h[1] for h in held])).astype(np.int64))]

    size = 0
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"]):
            if not text:
                continue
            waiting.append(keys_of(text, lang)[-1])
            size += len(waiting[-1])
            if size >= at_once:
                add()
                size = 0
                if len(held[0][0]) > at_once:
                    yield pd.DataFrame({"key": held[0][0], "c": held[0][1]})
                    held.clear()
    if waiting:
        add()
    if held:
        yield pd.DataFrame({"key": held[0][0], "c": held[0][1]})


def count_grams(texts: DataFrame) -> DataFrame:
    """(key, c) of the longest n-grams of (lang, text) rows; each task adds up its own before the shuffle."""
    return texts.mapInPandas(gram_counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def fit(texts: DataFrame, shard_rows: int = 1 << 20) -> Model | None:
    """Interpolated modified Kneser-Ney over all rows (lang, text), one model for each language.

    Counts of the longest n-grams and continuation counts of the shorter are summed by key in shards; n-grams, their
    contexts and their shorter suffixes meet in joins on those keys. The discounts of each language and order come from its counts of counts,
    with 0.5, 1 and 1.5 where those are too few. The model holds every n-gram and context (12 bytes each). It goes to the
    shared folder and from there, a shard of about `shard_rows` rows at a time, to the tasks' disks. No text: None.
    """
    counts = cut_lineage(count_grams(texts))
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << (BITS * k)) - 1
        lang = F.shiftleft(F.shiftright("key", BITS * ORDER), BITS * ORDER)
        # A start of text is not predicted: grams that end in code 0 don't occur, but contexts may begin with it.
        by_order[k] = by_order[k + 1].groupBy(lang.bitwiseOR(F.col("key").bitwiseAND(F.lit(mask))).alias("key")).agg(F.count("*").alias("c"))
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        mask = F.lit((1 << (BITS * k)) - 1)
        lang = F.shiftright("key", BITS * ORDER)
        top = F.shiftleft(lang, BITS * ORDER)
        grams = by_order[k].select(
            "key", "c", lang.alias("lang"),
            top.bitwiseOR(F.shiftright(F.col("key").bitwiseAND(mask), BITS)).alias("context"),
            top.bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))).alias("suffix"),
        )
        n = [F.sum(F.when(F.col("c") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        held = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(0.5 * (i + 1) - 0.5 * (i == 1)) for i in (1, 2, 3)]
        discounts = grams.groupBy("lang").agg(*n).select("lang", *[F.least(h, F.lit(float(i))).alias(f"d{i}") for i, h in enumerate(held, 1)])
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        less = grams.join(F.broadcast(discounts), "lang").withColumn("d", d)  # at most 2 ** LANG_BITS rows
        contexts = less.groupBy("context").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        joined = less.join(contexts, "context")
        below = F.lit(1.0 / (1 << BITS))
        if lower is not None:
            joined = joined.join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix")
            below = F.col("below")
        lower = cut_lineage(joined.select("key", "c", ((F.col("c") - F.col("d") + F.col("freed") * below) / F.col("total")).alias("p")))
        weights = contexts.select(F.col("context").alias("key"), (F.col("freed") / F.col("total")).alias("w"))
        parts.append((k, lower, weights))
    rows = None
    for k, grams, weights in parts:
        for code, length, found, value in ((k, k, grams, "p"), (ORDER + k, k - 1, weights, "w")):
            # The character before the predicted one; single characters and the empty context are in all shards.
            cell = F.shiftright("key", BITS * (code == k)).bitwiseAND(F.lit((1 << BITS) - 1)) if k > 1 else F.lit(None).cast("long")
            one = found.select(F.shiftright("key", BITS * ORDER).alias("lang"), cell.alias("cell"), F.col("key").bitwiseOR(F.lit(code << TAG)).alias("tag"), F.col(value).cast("float").alias("value"))
            rows = one if rows is None else rows.unionByName(one)
    rows = cut_lineage(rows)
    shards = -(-rows.count() // shard_rows)
    out = []
    for number in range(shards):
        mine = rows.where(F.col("cell").isNull() | (shard_number(F.col("lang"), F.col("cell"), shards) == number)).select("tag", "value").toArrow()
        tags, values = mine.column("tag").to_numpy(), mine.column("value").to_numpy()
        order = np.argsort(tags)
        out.append(texts.sparkSession.sparkContext.broadcast(Shard(tags[order], values[order])))
    return Model(out) if out else None


def perplexities(rows: DataFrame, model: Model | None) -> DataFrame:
    """(id, lang, fresh, n, perplexity) of whole texts, in characters; NULL for no text or no model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [len(t) if t else 0 for t in frame["text"]]
            sums = model.log_sums(list(frame["text"]), frame["number"].tolist()) if model else None
            found = [float(np.exp(-sums[i] / n)) if n and model else None for i, n in enumerate(sizes)]
            yield pd.DataFrame({"id": frame["id"], "lang": frame["lang"], "fresh": frame["fresh"], "n": sizes, "perplexity": pd.array(found, dtype="Float64")})

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, lang string, fresh boolean, n long, perplexity double")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    trusted_col: str = "quality",
    quantile: float = 0.995,
    slack: float = 1.5,
    short: int = 60,
    shard_rows: int = 1 << 20,
) -> DataFrame:
    """One row for each document: id_col, n_chars, perplexity, threshold, accepted.

    Trusted text is that of documents with label 1. Four fifths of it (by a hash of the text) train the model, whole
    and without a limit; on the rest, the language's `quantile` of perplexities times `slack` is the threshold, over
    texts of at least `short` characters. Shorter texts have `short` / n times that threshold, as few characters say
    little. A language without such held-out text takes the threshold of all languages. A document is accepted up to
    its threshold.

    Characters from code point 3,039 on (most scripts of Asia, emoji) are two codes each, so n-grams span fewer of them; none
    share a code. Perplexity is by character. Languages whose hashes agree in ten bits share a model, not a threshold.

    NULL or empty text: NULL perplexity, not accepted. NULL language: a language of its own.
    Repeated ids or labels: a document is trusted if any of its labels is 1. No trusted text: no model, NULL perplexity,
    accepted unless the text is empty. Empty table: no rows.
    """
    trusted = labels.where(F.col(trusted_col) == 1).select(F.col(id_col).cast(dict(docs.dtypes)[id_col]).alias("id")).distinct()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), lang_number(lang_col).alias("number"),
        F.col(text_col).alias("text"), (F.pmod(F.xxhash64(text_col), F.lit(5)) == 0).alias("fresh"),
    )
    learned = rows_among(rows.where("length(text) > 0 and not fresh"), trusted)
    model = fit(learned.select(F.col("number").alias("lang"), "text"), shard_rows)
    scored = cut_lineage(perplexities(rows, model))
    if model:  # the scores are in the shared folder now
        model.destroy()
    judged = scored.where(F.col("perplexity").isNotNull() & (F.col("n") >= short) & F.col("fresh")).join(trusted, "id", "left_semi")
    accuracy = 10_000
    limits = judged.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, accuracy).alias("limit"))
    overall = judged.agg(F.percentile_approx("perplexity", quantile, accuracy)).first()[0]
    threshold = F.coalesce(F.col("limit"), F.lit(overall).cast("double")) * slack * F.greatest(F.lit(1.0), short / F.greatest(F.col("n"), F.lit(1)))
    ready = scored.join(limits, "lang", "left").withColumn("threshold", threshold)
    accepted = (F.col("n") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return ready.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), "perplexity", "threshold", accepted.alias("accepted"))

