"""Language identification by compression with per-language raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


def learn_dictionaries(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = 96 * 1024, piece_chars: int = 1500
) -> dict[str, bytes]:
    """Raw dictionary content for each language: pieces of at most `piece_chars` characters of a bounded sample of texts.

    The sample bound is `dictionary_bytes` a language. Texts come in the order of their own hash, so equal texts count
    once and the ids play no part. Rows of NULL text or language are left out; no such row: no dictionaries.
    """
    wanted = max(8, 8 * dictionary_bytes // piece_chars)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and length(text) > 0")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, wanted / n))])[F.col("lang")]
    hashed = rows.withColumn("h", F.xxhash64("text"))
    some = hashed.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    some = some.select("lang", "h", F.substring("text", 1, piece_chars).alias("piece")).dropDuplicates(["lang", "h"])
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= wanted)
    found: dict[str, bytes] = {}
    for r in ranked.orderBy("lang", "r").collect():
        have = found.get(r["lang"], b"")
        if len(have) < dictionary_bytes:
            found[r["lang"]] = have + r["piece"].encode("utf-8", "replace") + b"\n"
    return {k: v[:dictionary_bytes] for k, v in found.items()}


def identify(
    docs: DataFrame, dictionaries: Mapping[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.004, level: int = 6, piece_chars: int = 16_384
) -> DataFrame:
    """One row for each document: id_col, lang_pred, score, margin, accepted.

    The whole text is compressed with every language's dictionary, in pieces of `piece_chars` characters that each start
    from the dictionary alone: it saves a fixed number of bytes at the start of what is compressed, so the margin of one
    long piece would shrink with its length. The smallest sum of sizes wins, the alphabetically first of equals. margin is how much smaller it is than the second, as a part of the second; score = margin / (margin + 0.02).
    accepted is false where the margin is under `min_margin`. NULL text, or no letter in it: `und`, 0, not accepted. One
    language only: margin 1. Repeated rows: each by itself. Work is by row, without a shuffle; the dictionaries' size is
    bounded by their number times `dictionary_bytes`.
    """
    names, contents = sorted(dictionaries), dict(dictionaries)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers = []
        for name in names:
            content = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            packers.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_checksum=False, write_content_size=False))
        for frame in frames:
            langs, scores, margins = [], [], []
            for text in frame["text"]:
                if not names or not text or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN), scores.append(0.0), margins.append(0.0)
                    continue
                pieces = [text[at : at + piece_chars].encode("utf-8", "replace") for at in range(0, len(text), piece_chars)]
                sizes = np.array([sum(len(p.compress(piece)) for piece in pieces) for p in packers])
                best = int(sizes.argmin())
                margin = 1 - sizes[best] / np.delete(sizes, best).min() if len(sizes) > 1 else 1.0
                langs.append(names[best]), margins.append(float(margin)), scores.append(float(margin / (margin + 0.02)))
            yield pd.DataFrame({"id": frame["id"], "lang_pred": langs, "score": scores, "margin": margins})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    found = rows.mapInPandas(run, f"id {kind}, lang_pred string, score double, margin double")
    accepted: Column = (F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= min_margin)
    return found.withColumn("accepted", accepted).withColumnRenamed("id", id_col)
