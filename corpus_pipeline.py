"""A corpus from ``documents`` to packed training sequences, stage by stage.

Every stage works on all that the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontamination, jaccard_join, packing, secret_scan, toxicity
from pulsegrid.llm.queries import read, tokenizer
from pulsegrid.session import materialise

#: SQL has no form for learned scores, edit matching or token packing; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts count as texts without hits, null ids and repeated rows are judged like any."""
    return toxicity.learn(docs, read(spark, sf_dir, "labels")).reject(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id stays (of equal ids the one of the smaller text hash), once if its row is repeated.

    Rows are told apart by id and text: an id that stands for several texts loses only the linked ones.  Rows without a
    word, or without an id, are linked with nothing and stay; no row gives no row; columns may have any names.
    """
    found = materialise(jaccard_join.link(docs, detail=True).select("doc_id", "text_hash", "group_id").where("group_id is not null"), "near-duplicates")
    groups = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("stays"), F.count("*").alias("rows")).where("rows > 1")
    others = F.struct("doc_id", "text_hash") != F.col("stays")
    gone = found.join(groups, "group_id").where(others).select("doc_id", "text_hash").distinct()
    repeated = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "text_hash")
    # Only keys of rows travel; a text is shuffled where its row is repeated, or where the keys are too many to broadcast.
    key = _unused(docs, "text_hash")
    hashed = docs.withColumn(key, F.xxhash64("text"))
    named = lambda keys: keys.withColumnRenamed("text_hash", key)
    left = hashed.join(named(gone), ["doc_id", key], "left_anti")
    once = left.join(named(repeated), ["doc_id", key], "left_anti").select(*map(quoted, docs.columns))
    again = left.join(named(repeated), ["doc_id", key], "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*map(quoted, docs.columns)), "source").alias(key + "_row"))
    return once.unionByName(again.select(*[F.col(key + "_row").getField(c).alias(c) for c in docs.columns]))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unused(docs: DataFrame, name: str) -> str:
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and no item leaves all."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; ``n_chars`` follows.  Null texts stay, with a null ``n_chars``."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece, with its ids and its place.  Null texts are empty documents; repeated rows are packed as often as they occur."""
    return packing.pack(docs, tokenizer(), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
