"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes what the stage before it kept, as a table with the columns of ``documents`` (or more;
they stay), and writes its own. Ids are integers. The last one returns the pieces and their places in the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitlake.llm import near, packing, quality, suffixes, templates
from nitlake.session import prepare, stored


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, of id and text: rows that repeat an id are not one document."""
    return docs.withColumn("_row", F.xxhash64("doc_id", F.sha2("text", 256)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity bands keep.

    Rows that repeat an id are judged each by its own text; a null or empty text fails the rules. An
    empty table stays empty.
    """
    prepare(spark)
    keyed = _keyed(docs)
    kept = quality.quality(keyed, "_row").where("kept").select("_row").distinct()
    return keyed.join(kept, "_row", "left_semi").drop("_row")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts 0.8 similar over five-word shingles, the document with the smallest id.

    A null id is the smallest; of rows of one id the one whose key is the smallest stays, and rows that
    repeat id and text are one. Texts without words are one class.
    """
    prepare(spark)
    keyed = _keyed(docs).withColumn("_key", F.struct("doc_id", "_row"))
    first = near.similar(keyed, "_key").where("_key = component_id").select(F.col("_key._row").alias("_row")).distinct()
    return keyed.join(first, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row", "_key")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what they share with an earlier text or place; a text of which nothing is left goes.

    A null text stays. Null ids come first; texts that share an id are documents of their own, that
    with the smaller SHA-256 before the others, and rows that repeat id and text are one.
    """
    prepare(spark)
    kept = suffixes.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where(
        F.coalesce(F.col("text") != "", F.lit(True))
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, not even with other numbers or names in it.

    Rows that repeat an id are judged each by its own text; null and empty texts leak nothing.
    """
    prepare(spark)
    keyed = _keyed(docs)
    found = templates.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_row")
    return keyed.join(found.select("_row").distinct(), "_row", "left_anti").drop("_row")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and where they lie in sequences; a null text has its end id alone."""
    prepare(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

#: SQL expresses neither the language model nor the fingerprints; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
