"""Repeated-line removal over a whole corpus, with built-in functions only.

Line keys are hashed; the hashes are range-partitioned together with a salt taken from the
document, sorted by document and position behind that, and streamed once: each stretch of one
hash and salt gives its first occurrence and its number of documents. Only these heads meet by
hash, so a line that a third of all documents hold never meets in one task. What comes back for
a document is a compressed bitmap of kept lines, not text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inundata.llm.text import SPACES, cut, let, lines, lower_ascii, shuffle_width

#: Lines of one word of a bitmap.
WORD = 63


@dataclass(frozen=True)
class LineDedupParams:
    min_chars: int = 40
    min_documents: int = 5


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def long_lines(docs: DataFrame, p: LineDedupParams, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line whose key is long enough: doc, text_hash, h1, h2, pos.

    A row is known by its id and a hash of its text, so rows that share an id (or have none)
    keep their own line positions.
    """
    # a line shorter than the limit can't have a key of that length; most lines stop here
    placed = F.filter(
        F.transform(lines(F.col("_text")), lambda x, i: F.struct(x.alias("line"), i.alias("pos"))),
        lambda x: F.length(x["line"]) >= p.min_chars,
    )
    return (
        docs.select(F.col(id_col).alias("doc"), F.col(text).alias("_text"))
        .select("doc", F.xxhash64("_text").alias("text_hash"), F.explode(placed).alias("x"))
        .select("doc", "text_hash", "x.pos", line_key(F.col("x.line")).alias("key"))
        .where(F.length("key") >= p.min_chars)
        .select("doc", "text_hash", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "pos")
    )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: LineDedupParams = LineDedupParams()) -> DataFrame:
    """doc, text_hash, keep: for documents that lose lines, a map of word number to 63 keep bits.

    Words that are absent, and documents that are absent, keep everything. A key goes
    everywhere but in the largest id that holds it (all its lines stay there). Repeated rows of
    one id count as one document; a null id is smaller than any other.
    """
    spark = docs.sparkSession
    salts = shuffle_width(spark)
    placed = cut(long_lines(docs, p, id_col, text)).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)))
    parted = placed.repartitionByRange(salts, "h1", "h2", "salt").sortWithinPartitions(
        "h1", "h2", "salt", F.col("doc").desc_nulls_last(), "pos"
    )
    stretch = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc").desc_nulls_last(), "pos")
    before = F.lag(F.struct("doc")).over(stretch)
    heads = (
        parted.withColumn("new_doc", before.isNull() | ~before["doc"].eqNullSafe(F.col("doc")))
        .where("new_doc")
        .groupBy("h1", "h2", "salt")
        .agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        .where(F.col("n") >= p.min_documents)
    )
    dropped = (
        placed.join(heads, ["h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("last")))
        .select("doc", "text_hash", F.floor(F.col("pos") / WORD).cast("int").alias("word"), F.pmod("pos", F.lit(WORD)).alias("bit"))
    )
    full = F.lit((1 << WORD) - 1)
    return (
        dropped.groupBy("doc", "text_hash", "word")
        .agg(full.bitwiseXOR(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int")))).alias("bits"))
        .groupBy("doc", "text_hash")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits")))).alias("keep"))
    )


def kept_lines(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that ``keep`` leaves, as an array; a null map leaves all."""

    def of(every: Column) -> Column:
        def stays(_, i: Column) -> Column:
            word = F.try_element_at(keep, F.floor(i / WORD).cast("int"))
            return word.isNull() | (F.call_function("shiftright", word, F.pmod(i, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1)) == 1)

        return F.when(keep.isNull(), every).otherwise(F.filter(every, stays))

    return let(lines(text), of)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", p: LineDedupParams = LineDedupParams()) -> DataFrame:
    """``row`` (all input columns), ``n_lines``, ``n_dropped``, ``kept_text``.

    Null and empty texts are one empty line and stay as they are; an empty table gives an empty
    table. A very long text is split whole: its lines are rows like all others.
    """
    marks = keep_bitmaps(docs, id_col, text, p)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = whole.join(
        marks, F.col(f"row.{id_col}").eqNullSafe(F.col("doc")) & (F.xxhash64(f"row.{text}") == F.col("text_hash")), "left"
    )
    n_lines = F.length(F.coalesce(F.col(f"row.{text}"), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(f"row.{text}"), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    lost = F.aggregate(
        F.coalesce(F.map_values("keep"), F.array().cast("array<bigint>")),
        F.lit(0).cast("long"),
        lambda n, bits: n + WORD - F.bit_count(bits),
    )
    return joined.select(
        "row",
        n_lines.cast("long").alias("n_lines"),
        lost.alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col(f"row.{text}"))
        .otherwise(F.array_join(kept_lines(F.col(f"row.{text}"), F.col("keep")), "\n"))
        .alias("kept_text"),
    )
