"""A corpus pipeline of five stages, each one of the corpus operators.

Every stage takes what its predecessor kept, decides on all of it, and returns the columns of
``documents``; the last returns the encoded form. ``run`` writes each stage as Parquet and reads it
again, in the shared folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inundata.llm.linededup import dedup_lines
from inundata.llm.mixing import mix_sources
from inundata.llm.ngramjoin import identity, jaccard_groups
from inundata.llm.pieces import encode_pieces
from inundata.llm.quality import apply_quality_rules
from inundata.llm.text import shared_folder


def _with_text(frame: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """``row.*`` with a new text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return frame.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject.

    Null and empty texts fail for want of words. Repeated rows are judged alike, each for itself; ids
    and other columns, nulls too, come through as they are. A very long text is judged whole. An
    empty table stays empty.
    """
    judged = apply_quality_rules(docs)
    # a filter on the verdict would be pushed below it, and every document judged twice
    kept = judged.select("row", F.explode(F.filter(F.array("quality"), lambda q: q["kept"])).alias("quality"))
    return _with_text(kept, "quality.clean_text", docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only; documents keep their other lines.

    No row goes. The document with the largest id keeps a repeated line. Rows of one id count as one
    document and keep it alike; a missing id is smaller than any other. Null and empty texts stay as
    they are. Columns beside text and n_chars come through, whatever their names. An empty table
    stays empty.
    """
    return _with_text(dedup_lines(docs), "kept_text", docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one that names the group.

    Documents are told apart by id and text. Rows that have both in common are one document, of
    which one row stays; a document without an id stays unless it is a near duplicate of another.
    """
    names = jaccard_groups(docs).where("component = doc").select("doc").distinct()
    known = docs.withColumn("doc", identity(F.col("doc_id"), F.col("text"))).dropDuplicates(["doc"])
    return known.join(names, "doc", "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the mix takes them.

    Rows with the same id, text and source share their copies, as evenly as these can be dealt.
    """
    taken = (
        mix_sources(docs)
        .groupBy(F.struct("row.doc_id", "row.source", "text_hash").alias("doc"))
        .agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
        .where("total > 0")
    )
    known = docs.withColumn("doc", F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("doc"))
    copies = (F.floor(F.col("total") / F.col("rows")) + (place <= F.pmod("total", F.col("rows"))).cast("int")).cast("int")
    return (
        known.join(taken, "doc")
        .withColumn("copies", copies)
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*docs.columns)
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts.

    A row per row, repeated ones too; null texts are empty. Ids come through as they are, and no other
    column is read. An empty table gives an empty one.
    """
    import public_tokenizers

    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_dedup),
    ("source mix", mix),
    ("sentencepiece encoding", encode),
]

#: SQL can express neither the join nor the encoder; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each on what the one before has written; an empty table runs through."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
