"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks by source and shard, then seeded blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.skew import lookup_join

from .common import cut_lineage, numbered, stored

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, percent: int = 150, most: int = 2) -> DataFrame:
    """Adds `target` to one row per source with `weight` and `source_size`.

    The sources share `percent` of all sizes by weight; a target stops at `most` times its source's size, and what is
    above is shared again by weight until none is above. Each round fixes the sources above their limit; only the sums
    of the fixed ones come to the driver. All numbers are integers up to one last division.
    """
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    fixed = (0, 0)
    while True:
        share, parts = percent * whole[0] - 100 * most * fixed[0], 100 * (whole[1] - fixed[1])
        above = F.col("weight") * F.lit(share) > F.col("source_size") * F.lit(most * parts)
        sums = sources.where(above).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if tuple(sums) == fixed or not parts:
            break
        fixed = tuple(sums)
    own = (F.col("weight") * F.lit(share)).cast("double") / F.lit(float(parts or 1))
    limit = (F.col("source_size") * most).cast("double")
    return sources.withColumn("target", F.when(above, limit).otherwise(own) if parts else limit)


def apportion(parties: DataFrame, group: Sequence[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds `quota`: of a group's `seats`, those a party wins by the highest quotients votes / (2 s + 1), s = 0, 1, ...

    Equal quotients: the smaller party first. A divisor that leaves seats over gives each party its first seats at once,
    so that about three quotients a party are compared, whatever the number of seats. No votes: no seat.
    """
    whole = Window.partitionBy(*group)
    all_votes, k = F.sum(votes).over(whole).cast("double"), F.count("*").over(whole)
    share = F.when(all_votes > 0, F.col(votes) / all_votes).otherwise(0.0)
    first = F.floor(share * F.greatest(F.col(seats) - k / 2 - 1, F.lit(0)) + F.lit(0.5))
    begun = parties.withColumns({"_first": first.cast("long"), "_more": F.ceil(share * (k + 2)) + 2})
    begun = begun.withColumn("_left", F.col(seats) - F.sum("_first").over(whole))
    offers = begun.withColumn("_s", F.explode(F.expr("sequence(_first, _first + _more)")))
    offers = offers.withColumn("_quotient", F.col(votes) / (2 * F.col("_s") + 1))
    place = F.row_number().over(whole.orderBy(F.desc("_quotient"), party, "_s"))
    won = (place <= F.col("_left")) & (F.col("_quotient") > 0)
    return offers.withColumn("_won", won.cast("long")).groupBy(*parties.columns, "_first").agg(F.sum("_won").alias("_won")).withColumn(
        "quota", F.col("_first") + F.col("_won")
    ).drop("_first", "_won")


def blocks_of(size: Column | str, block_words: int) -> Column:
    return F.ceil((F.col(size) if isinstance(size, str) else size) / F.lit(block_words))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
    block_words: int = 32,
    shard_words: int = 4_000_000,
    seed: int = 7,
) -> DataFrame:
    """One row for each document: id_col, size (words), source_size, target (its source's), taken (words, with repeats).

    Sources in code point order, NULL last, have the `weights` in turn; see source_targets. A source's documents are dealt
    to shards of about `shard_words` words by a hash of the id, and lie in each shard end to end, cut into blocks of
    `block_words` words (the last one of a shard may be shorter). The blocks of the whole mix go to the sources by the
    highest Sainte-Laguë quotients of their targets, a source's blocks to its shards by those of their sizes. A shard with
    n blocks and a quota q takes each block q div n times and the q mod n blocks of the smallest seeded hash once more; at
    most `most` times in all. So quotas are fixed before blocks are drawn, and the same seed gives the same rows again.

    Only ids and sizes are shuffled, by source and shard, so a large source is many tasks' work.

    NULL text: size 0. NULL source: a source of its own. Size 0: taken 0. Repeated rows count each. Ties of ids are in
    order of size. Empty table: no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.concat(F.lit("s"), F.col(source_col).cast("string")).alias("source"), size.alias("size")), "mix-sizes")
    # As text after a letter, so that no source equals the one of NULL.
    rows = rows.withColumn("source", F.coalesce("source", F.lit("")))
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source") == "", F.col("source")], "number")
    turn = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = cut_lineage(source_targets(cut_lineage(sources.withColumn("weight", turn)), percent, most))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    seats = (percent * total + 50 * block_words) // (100 * block_words)
    sources = apportion(sources.select("source", "number", "source_size", "target", F.lit(seats).alias("seats"), F.lit(0).alias("mix")), ["mix"], "number", "target", "seats")
    sources = cut_lineage(sources.select(
        "source", "number", "source_size", "target", F.col("quota").alias("seats"), F.greatest(blocks_of("source_size", shard_words), F.lit(1)).alias("shards")
    ))

    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("shard"), F.lit(str(seed)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    dealt = lookup_join(rows, sources.select("source", "number", "source_size", "target", "shards"), ["source"]).withColumn("shard", hashed % F.col("shards"))
    shards = dealt.groupBy("number", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = apportion(shards.join(sources.select("number", "seats"), "number"), ["number"], "shard", "shard_size", "seats").select("number", "shard", "shard_size", "quota")
    quotas = cut_lineage(quotas)

    stream = Window.partitionBy("number", "shard")
    in_order = stream.orderBy(F.asc_nulls_last("id"), "size")
    laid = lookup_join(dealt, quotas, ["number", "shard"]).withColumns({
        "row": F.row_number().over(in_order),
        "begin": F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    n = F.greatest(blocks_of("shard_size", block_words), F.lit(1))
    block = F.when(F.col("size") > 0, F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}")))
    slices = laid.withColumn("block", F.explode_outer(block)).withColumns({
        "words": F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("begin"), F.col("block") * block_words),
        "draw": F.md5(F.concat_ws(":", F.lit("block"), F.lit(str(seed)), "number", "shard", "block")),
        "quota": F.least("quota", n * most),
    })
    # Slices of no block stand last, so that blocks have the ranks from 1.
    slices = slices.withColumn("rank", F.dense_rank().over(stream.orderBy(F.col("block").isNull(), "draw", "block")))
    times = F.floor(F.col("quota") / n) + (F.col("rank") <= F.col("quota") % n).cast("long")
    taken = slices.groupBy("number", "shard", "row").agg(
        F.first("id").alias(id_col), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.coalesce(F.sum(F.col("words") * times), F.lit(0)).alias("taken"),
    )
    return taken.select(id_col, "size", "source_size", "target", "taken")
