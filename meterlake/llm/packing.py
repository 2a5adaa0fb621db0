"""Mixture-controlled packing: deficit round-robin over source queues into full windows."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZER, stored

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """tiktoken over a file of ranks; the ids are those of the byte-level tokenizer file of the same vocabulary."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{TOKENIZER}.tiktoken")


@dataclass(frozen=True)
class Phase:
    """Rounds in which queue q serves tokens[q] in equal shares, from its own token first[q] and stream position start."""

    tokens: tuple[int, ...]
    first: tuple[int, ...]
    rounds: int
    start: int


def plan_phases(totals: list[int], shares: list[float] | None, window: int) -> list[Phase]:
    """Without shares one phase serves every queue by its part of all tokens. With shares a phase ends when a queue is
    empty, and the others go on with their shares scaled up."""
    left, first, start, phases = list(totals), [0] * len(totals), 0, []
    while sum(left):
        rounds, take = -(-sum(left) // window), list(left)
        if shares is not None:
            alive = sum(s for s, n in zip(shares, left) if n)
            if alive > 0:
                quota = [s / alive * window if n else 0.0 for s, n in zip(shares, left)]
                fit = min(int(n / q) for n, q in zip(left, quota) if q > 0)
                if fit:
                    rounds, take = fit, [min(n, int(q * fit)) for n, q in zip(left, quota)]
                else:  # the queue that lasts less than a round goes first
                    short = min((i for i, q in enumerate(quota) if q > 0), key=lambda i: left[i] / quota[i])
                    rounds, take = 1, [n if i == short else 0 for i, n in enumerate(left)]
        phases.append(Phase(tuple(take), tuple(first), rounds, start))
        start += sum(take)
        first = [f + t for f, t in zip(first, take)]
        left = [n - t for n, t in zip(left, take)]
    return phases


def cut_document(begin: int, n: int, queue: int, phases: list[Phase], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of the document before each piece and at its end, stream position of each piece).

    After w rounds a queue with t tokens in r rounds has served floor(t w / r): the fraction is the deficit it carries.
    """
    cuts, places = [], []
    for phase in phases:
        t, first = phase.tokens[queue], phase.first[queue]
        lo, hi = max(begin, first) - first, min(begin + n, first + t) - first
        if lo >= hi:
            continue
        r = phase.rounds
        w = np.arange(-(-(lo + 1) * r // t) - 1, -(-hi * r // t) + 1)
        kind = np.int64 if r < 3_000_000_000 else object
        w = w.astype(kind)
        tokens = np.array(phase.tokens, dtype=kind)
        whole, rest = tokens // r, tokens % r
        served = whole[:, None] * w + rest[:, None] * w // r  # queue x round boundary
        own = served[queue]
        head = served.sum(axis=0)[:-1] + (served[:queue, 1:] - served[:queue, :-1]).sum(axis=0) + phase.start
        begins, ends = np.maximum(own[:-1], lo), np.minimum(own[1:], hi)
        keep = ends > begins
        begins, ends, at = begins[keep], ends[keep], (head + begins - own[:-1])[keep]
        # A round may reach over the end of a window.
        full = (at // window + 1) * window
        over = full < at + (ends - begins)
        extra = np.flatnonzero(over)
        begins = np.insert(begins, extra + 1, begins[extra] + full[extra] - at[extra])
        at = np.insert(at, extra + 1, full[extra])
        while True:  # a round longer than a window is cut again
            ends = np.append(begins[1:], hi)
            full = (at // window + 1) * window
            extra = np.flatnonzero(full < at + (ends - begins))
            if not len(extra):
                break
            begins = np.insert(begins, extra + 1, begins[extra] + full[extra] - at[extra])
            at = np.insert(at, extra + 1, full[extra])
        cuts.append(begins + first - begin)
        places.append(at)
    starts = np.concatenate(cuts)
    return np.append(starts, n), np.concatenate(places)


def encode_queues(docs: DataFrame, id_col: str, text_col: str, queue_col: str, ranks: str, eos: int) -> DataFrame:
    """Every document's ids (16 bits each where they fit) with its place among its queue's tokens within its partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, served = encoder(ranks).encode_ordinary, {}
        for frame in frames:
            ids, begins, sizes = [], [], []
            for queue, text in zip(frame["queue"], frame["text"]):
                got = np.array([*encode(text), eos] if text else [eos], dtype="<u4")
                begin = served.get(queue, 0)
                served[queue] = begin + len(got)
                begins.append(begin)
                sizes.append(len(got))
                ids.append(got.astype("<u2").tobytes() if encoder(ranks).max_token_value < 65536 else got.tobytes())
            yield pd.DataFrame({"id": frame["id"], "queue": frame["queue"], "part": frame["part"], "begin": begins, "n": sizes, "ids": ids})

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(queue_col).cast("string"), F.lit("")).alias("queue"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.spark_partition_id().alias("part"),
    )
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(run, f"id {kind}, queue string, part int, begin long, n long, ids binary")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    queue_col: str = "source",
    window: int = 1024,
    shares: Mapping[str, float] | None = None,
    ranks: str | None = None,
    eos: int = 0,
    max_queues: int = 256,
) -> DataFrame:
    """Pieces (id_col, start, length, ids, doc_tokens, sequence_id, offset) of all documents, ids as little-endian uint32.

    Each document is encoded once into a table in the shared folder. Round by round every queue serves its share of a
    window and carries the fraction it couldn't serve; the rounds lie end to end and are cut each `window` tokens, so
    only the last window is padded. `shares` are the target proportions by queue, by default those of the corpus. Where
    a queue begins in a partition comes from sums by (partition, queue), so pieces are found in parallel. The driver
    holds one number for each of at most `max_queues` queues; sources beyond the largest share one queue.

    NULL or empty text: the end token alone. NULL queue: the queue ''. Repeated rows are packed each. Empty table: no rows.
    """
    ranks = ranks or ranks_path()
    rows = stored(encode_queues(docs, id_col, text_col, queue_col, ranks, eos), "pack-ids")
    parts = rows.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    largest = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "queue").limit(max_queues - 1).collect()
    names = [r["queue"] for r in largest]
    if not names:
        return docs.sparkSession.createDataFrame([], f"{id_col} {dict(rows.dtypes)['id']}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    number = F.coalesce(F.create_map(*[F.lit(x) for i, q in enumerate(names) for x in (q, i)])[F.col("queue")], F.lit(len(names)))
    based = parts.withColumn("q", number).withColumn(
        "base", F.sum("tokens").over(Window.partitionBy("q").orderBy("queue", "part").rowsBetween(Window.unboundedPreceding, -1))
    )
    total = int(parts.agg(F.sum("tokens")).first()[0])
    totals = [int(r["tokens"]) for r in largest]
    totals.append(total - sum(totals))
    given = None if shares is None else [float(shares.get(q, 0.0)) for q in names] + [sum(v for k, v in shares.items() if k not in names)]
    phases = plan_phases(totals, given, window)
    wide = encoder(ranks).max_token_value >= 65536

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {k: [] for k in ("id", "start", "length", "ids", "doc_tokens", "place")}
            for key, q, begin, n, ids in zip(frame["id"], frame["q"], frame["begin"], frame["n"], frame["ids"]):
                values = np.frombuffer(ids, dtype="<u4" if wide else "<u2").astype("<u4").tobytes()
                cuts, places = cut_document(int(begin), int(n), int(q), phases, window)
                ends = cuts.tolist()
                out["id"] += [key] * len(places)
                out["start"].append(cuts[:-1])
                out["length"].append(np.diff(cuts))
                out["ids"] += [values[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
                out["doc_tokens"].append(np.full(len(places), n))
                out["place"].append(places)
            columns = {k: v if k in ("id", "ids") else np.concatenate(v).astype(np.int64) for k, v in out.items() if v or k in ("id", "ids")}
            if out["id"]:
                yield pd.DataFrame(columns)

    kind = dict(rows.dtypes)["id"]
    placed = rows.join(based.select("queue", "part", "q", F.coalesce("base", F.lit(0)).alias("base")), ["queue", "part"])
    pieces = placed.select("id", "q", (F.col("begin") + F.col("base")).alias("begin"), "n", "ids").mapInPandas(
        run, f"id {kind}, start long, length long, ids binary, doc_tokens long, place long"
    )
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens",
        F.floor(F.col("place") / window).cast("long").alias("sequence_id") if window & (window - 1) else F.shiftright("place", window.bit_length() - 1).alias("sequence_id"),
        (F.col("place") % window).alias("offset"),
    )
