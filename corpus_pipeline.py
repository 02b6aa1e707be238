"""A training corpus in five stages, each a Parquet table that the next one reads.

Language ID (documents without letters go), MinHash near-dedup (one document of
each group stays), substring dedup (repeated passages are cut out, documents
that have no word left go), benchmark decontamination (contaminated documents
go), byte-level BPE (ids of what is left).  Rows that share a doc_id are one
document.  A row without one is a document of its own, apart from equal texts
without ids, of which one stays, and no document goes as its copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orderloom.llm import byte_bpe, decontaminate as decon, language_id, near_dedup, substring_dedup
from orderloom.llm.queries import remainder, table
from orderloom.scratch import settle

#: Stands in for the id of a row that has none, above all ids.
NO_ID = 2**62
ROW = "_row"


def keyed(docs: DataFrame) -> DataFrame:
    """With a key per document: its id, or one by its text that is larger than every id; equal texts without ids become one row."""
    own = F.lit(NO_ID) + F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(NO_ID))
    rows = docs.withColumn(ROW, F.coalesce(F.col("doc_id").cast("long"), own))
    return rows.where("doc_id is not null").unionByName(rows.where("doc_id is null").dropDuplicates([ROW]))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told keep the told one in lang."""
    profiles = language_id.learn_profiles(docs.where(remainder("doc_id", 4) != 2))
    told = language_id.identify(docs, profiles).where("lang_pred <> 'und'")
    return told.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are near copies (five-word shingles, 0.8) of one with a smaller id."""
    rows = keyed(docs)
    gone = settle(near_dedup.near_duplicates(rows, id_col=ROW, shingle_words=5, percent=80).where("not kept").select(F.col("doc_id").alias(ROW)).distinct())
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a smaller id has too; n_chars follows."""
    cut = substring_dedup.remove_repeats(docs, window=50).where("n_words > n_removed")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(new.get(c, F.col(f"extra.`{c}`")).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    rows = keyed(docs)
    judged = decon.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=ROW)
    gone = settle(judged.where("contaminated").select(F.col("doc_id").alias(ROW)).distinct())
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes."""
    import public_tokenizers

    coded = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontaminate),
    ("byte_bpe", tokens),
]

#: SQL can't express language ID and BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
