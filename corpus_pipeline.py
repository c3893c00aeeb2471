"""A training corpus from the table of documents: language, near-duplicates, secrets, mix, tokens.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have the columns of
the table. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import bpe, langid, mixing, neardup, secret_scan
from thalweg.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is beyond doubt, with that language in ``lang``; texts that are null,
    without a letter, or closer than the operator's margin to two languages go."""
    model = langid.fit(docs)
    found = langid.classify(docs.select(*COLUMNS), model, keep_text=True)
    return found.filter("accepted").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8): that of the
    smallest id. Rows without an id stay."""
    rows, _ = neardup.near_duplicates(docs, 5, 80)
    kept = rows.filter("id is not null and id = component_id").groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    held = docs.select(*COLUMNS).join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"))
    once = held.filter("_n = 1").select(*COLUMNS)
    repeated = held.filter("_n > 1").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return once.unionByName(repeated).unionByName(docs.select(*COLUMNS).filter("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents as often and as far as their slots take them, each partition in the order of
    the slots."""
    taken = mixing.mixed_documents(docs.select(*COLUMNS))
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row of the mix."""
    coded = bpe.encode(docs, keep=("lang", "source"), decoded=False)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixture), ("tokens", tokens)]

#: SQL can't express compression, MinHash or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
