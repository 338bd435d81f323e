"""A training corpus from raw documents, in five stages; each one works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelkit.llm import minhash, mixing, packing, quality, suffix, tokens
from parcelkit.llm.common import table, written
from parcelkit.llm.queries import tokenizer


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, written once so that it stays, and that column's name: none that ``docs`` has."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier samples; each row by itself, also where ids repeat or are null."""
    rows, row = keyed(docs)
    told = quality.importance_sample(rows, table(spark, sf_dir, "labels"), row_col=row)
    return rows.join(told.where("kept").select(row).hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 or more), that of the smallest id (null last, then by a hash of the row).

    Each row is a document, also where ids repeat or are null. Texts without words are copies of nothing; of rows equal in all columns one stays.
    """
    rows, row = keyed(docs.dropDuplicates())
    order = rows.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), F.col(row).alias("row")).alias("order"))
    found = minhash.near_duplicates(rows, width=5, id_col=row).join(order, row)
    first = found.groupBy("component_id").agg(F.min("order")["row"].alias(row))
    return rows.join(first.select(row).hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand anywhere else too; documents left empty go.

    Rows are told apart by id and text; equal rows are copies of each other, so both lose what they share. A character goes only as a whole. Null and empty
    texts stay as they are, all other columns too, but n_chars, which follows the text.
    """
    out = suffix.remove_repeats(docs, whole_characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    left = out.withColumn("text", text).where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the null source is one too. Null texts and others without words have size 0 and go by their source's rate; equal rows get equal copies."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan: where each piece of each document (every copy) stands. Null texts are empty: one piece of one id. Null and repeated ids are packed as others."""
    return packing.pack(tokens.pieces(docs, tokenizer()), key=["doc_id", "piece", "length", "ids_crc32"])


STAGES = [("quality classifier", classify), ("minhash near-dedup", drop_near_copies), ("suffix-array dedup", drop_repeats), ("source mixing", mix_sources), ("best-fit packing", pack_sequences)]

#: Hashed models, sketches and a linear program have no SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
