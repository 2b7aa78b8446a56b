"""From raw documents to packed training sequences: rules, classifier, near-dedup, pseudonyms, packing.

Each stage takes the session, the documents its predecessor kept and the folder of the tables, and
returns a DataFrame; all but the last return the columns of documents.

Null and empty texts have no words, so the rules reject them; repeated rows are judged alike, and
near-dedup keeps one of them; a null id stays and counts as no id; an empty table gives an empty table
after each stage; further columns stay as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.llm import ordinal, packing, pii, rules, simhash
from granulon.llm.common import drop_folder, shared_folder
from granulon.llm.queries import GRADE, TOP_GRADE, WORD_VOCABULARY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the isolation forest doesn't set apart."""
    return rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely of the top grade (well written, not toxic) than not."""
    model = ordinal.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.expr(GRADE), TOP_GRADE)
    return ordinal.select(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at 4 or fewer differing bits."""
    return simhash.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    done = pii.pseudonymise(docs, pii.secret(spark), found_col="_found")
    found = done.columns[-1]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_VOCABULARY), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("pii", pseudonyms),
    ("best_fit_packing", pack),
]

#: No SQL: forest, regression, hashed pseudonyms and tokens are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents; what a stage kept is written below `folder` and read again.

    Without a folder: a new one in the shared folder. A stage's files go when the next stage's are whole; those of
    the last but one stay, since the result is read from them, until the caller drops the folder.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if i:
                drop_folder(spark, f"{folder}/{STAGES[i - 1][0]}")
    return docs
