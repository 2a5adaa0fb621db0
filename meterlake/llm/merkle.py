"""Document fingerprints: a Merkle tree of sections, paragraphs and pieces, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: A piece: up to so many code points of a sentence, with the marks that end it.
PIECE = r"[^.!?]{1,24}[.!?]*|[.!?]+"


def pieces(text: Column) -> Column:
    """Distinct hashes of the lowest leaves. A sentence is cut from its start, so an edit doesn't move later sentences."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({PIECE})"), F.lit(1)), lambda p: F.xxhash64(p)))


def tree(text: Column) -> Column:
    """Sections (apart by blank lines), each with its digest and its paragraphs' digests; NULL is the empty text."""
    sections = F.split(F.coalesce(text, F.lit("")), r"\n[ \t]*\n")

    def section(s: Column) -> Column:
        leaves = F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256))
        return F.struct(F.sha2(F.array_join(leaves, ","), 256).alias("digest"), leaves.alias("paragraphs"))

    return F.transform(sections, section)


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), ";"), 256)


def root_of(text: Column) -> Column:
    """root(tree(text)), without keeping the tree."""
    paragraphs = lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256))
    return F.sha2(F.array_join(F.transform(F.split(text, r"\n[ \t]*\n"), lambda s: F.sha2(F.array_join(paragraphs(s), ","), 256)), ";"), 256)


def likeness(a: Column, b: Column) -> Column:
    """2 * common pieces / all pieces, 1 for two texts without any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differences(a: Column, b: Column) -> Column:
    """(section, paragraph) pairs, from 0, where two trees differ; paragraph -1 for a section that only one has.

    Only sections of unequal digests are compared below; equal roots give no pairs.
    """

    def within(i: Column) -> Column:
        left, right = F.get(a, i), F.get(b, i)
        below = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(left["paragraphs"]), F.size(right["paragraphs"])) - 1),
            lambda p: ~F.get(left["paragraphs"], p).eqNullSafe(F.get(right["paragraphs"], p)),
        )
        pairs = F.transform(below, lambda p: F.struct(i.alias("section"), p.alias("paragraph")))
        alone = F.array(F.struct(i.alias("section"), F.lit(-1).alias("paragraph")))
        return F.when(left.isNull() | right.isNull(), alone).when(left["digest"] == right["digest"], F.slice(alone, 1, 0)).otherwise(pairs)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1), within))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, fingerprint (root), tree, pieces of each row's whole text.

    Equal texts have equal roots; other texts have others, up to SHA-256 collisions. NULL text: as the empty one.
    Repeated rows: one result each. Empty table: no rows. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.length(text).cast("long").alias("n_chars"), tree(text).alias("tree"), pieces(text).alias("pieces"))
    return rows.select(id_col, "n_chars", root(F.col("tree")).alias("fingerprint"), "tree", "pieces")


def following(ids: DataFrame) -> DataFrame:
    """(id, next): the next id in ascending order, the first one after the last; distinct ids only.

    Ids are range-partitioned, and each part is ordered by itself; one row for each part links it to the next part.
    """
    ranged = cut_lineage(ids.distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    starts = ranged.groupBy("part").agg(F.min("id").alias("start"))
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = starts.select("part", F.coalesce(F.lead("start").over(Window.orderBy("part")), F.first("start").over(everything)).alias("after"))
    inner = ranged.withColumn("lead", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    return inner.join(F.broadcast(links), "part").select("id", F.coalesce("lead", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against the next and against an edited text, by fingerprints.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in ascending id, the first document following the last. near_* are `likeness` of pieces. The neighbour is
    found on ids alone; a document's predecessor asks it for a prefix of known length, so only documents once and the
    prefixes asked for are shuffled. NULL text: as the empty one. Ids are taken as distinct; of rows with a repeated id each gets each
    row of the next id. One document: it follows itself. Empty table: no rows.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = following(kept.select("id"))
    half = kept.select("id", F.floor(F.length("text") / 2).cast("int").alias("half"))
    asked = order.join(half, "id").select(F.col("id").alias("asker"), F.col("next").alias("id"), "half")
    given = kept.join(asked, "id").select(
        F.col("asker").alias("id"), F.expr("substring(text, 1, half)").alias("prefix"), pieces(F.col("text")).alias("next_pieces")
    )
    whole = kept.join(given, "id").withColumn(
        "edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), "prefix")
    )
    trees = whole.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        root_of(F.col("text")).alias("fingerprint"), root_of(F.col("edited")).alias("edited_fingerprint"),
        pieces(F.col("text")).alias("own"), pieces(F.col("edited")).alias("other"), "next_pieces",
    )
    return trees.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_pieces")).alias("near_next"),
    )
