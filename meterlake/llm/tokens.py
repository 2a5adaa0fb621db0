"""Token counts of sections: whole documents are encoded once and their tokens joined to sections by offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoder, ranks_path

RULES = ("start", "most", "split")


def attribute(token_bytes: np.ndarray, section_bytes: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, from the byte lengths of tokens and of the sections they tile.

    The interval join is a binary search of token ends among section ends. A token within one section counts there. A
    token over several: `start` gives it to the section of its first byte, `most` to the one with most of its bytes (the
    earliest of equals), `split` to all by their parts of its bytes. A section of no bytes has no tokens.
    """
    ends, edges = np.cumsum(token_bytes), np.concatenate([[0], np.cumsum(section_bytes)])
    begins = ends - token_bytes
    first = np.searchsorted(edges, begins, "right") - 1
    last = np.searchsorted(edges, ends, "left") - 1
    counts = np.bincount(first[first == last], minlength=len(section_bytes)).astype(float)
    crossing = np.zeros(len(section_bytes), dtype=np.int64)
    for k in np.flatnonzero(first != last):
        over = np.arange(first[k], last[k] + 1)
        part = np.minimum(edges[over + 1], ends[k]) - np.maximum(edges[over], begins[k])
        crossing[over[part > 0]] += 1
        if rule == "split":
            counts[over] += part / token_bytes[k]
        else:
            counts[over[0] if rule == "start" else over[part.argmax()]] += 1
    return counts, crossing


def section_tokens(
    docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), separator: str = "\n", rule: str = "most", ranks: str | None = None
) -> DataFrame:
    """One row for each section of each document: id_col, field, section, begin, end, tokens, crossing.

    The fields are put end to end, each but the last followed by the separator, and encoded as one text. A section is a
    stretch of a field up to and including a separator; begin and end are its characters within the field (the separator
    after a field belongs to its last section but not to that span). Tokens sum to the document's tokens under any rule.
    Work is by row: no shuffle, and memory of one batch of documents.

    NULL or empty field: one section of no characters. Repeated rows: counted each. Empty table: no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is not one of {RULES}")
    ranks, names = ranks or ranks_path(), list(fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoder(ranks)
        lengths = np.zeros(codec.n_vocab, dtype=np.int64)
        for value in codec.token_byte_values():
            lengths[codec.encode_single_token(value)] = len(value)
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                texts = [x or "" for x in row[1:]]
                whole, spans = separator.join(texts), []
                for f, text in enumerate(texts):
                    at = 0
                    while (found := text.find(separator, at)) >= 0 and found + len(separator) < len(text):
                        spans.append((f, at, found + len(separator), text[at : found + len(separator)]))
                        at = found + len(separator)
                    spans.append((f, at, len(text), text[at:] + (separator if f + 1 < len(texts) else "")))
                size = np.array([len(s[3]) if s[3].isascii() else len(s[3].encode("utf-8", "replace")) for s in spans])
                tokens = lengths[np.array(codec.encode_ordinary(whole), dtype=np.int64)]
                counts, crossing = attribute(tokens, size, rule)
                before = -1
                for (f, a, b, _), n, c in zip(spans, counts.tolist(), crossing.tolist()):
                    section = 0 if f != before else section + 1
                    before = f
                    out.append((row[0], names[f], section, a, b, n, c))
            yield pd.DataFrame(out, columns=["id", "field", "section", "begin", "end", "tokens", "crossing"])

    rows = docs.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(names)])
    kind = dict(rows.dtypes)["id"]
    counted = rows.mapInPandas(run, f"id {kind}, field string, section long, begin long, end long, tokens double, crossing long")
    return counted.withColumnRenamed("id", id_col)
