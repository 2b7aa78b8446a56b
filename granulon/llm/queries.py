"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.llm import bpe, collocations, html, licenses, ordinal, packing, pii, rules, sharding, simhash, spotsigs, tokenfile, whitening

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"), size=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(_read(spark, sf_dir, "documents"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), capacity=2048, end_id=0)


def op5_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(_read(spark, sf_dir, "documents"), pii.secret(spark))
    return done.select("doc_id", "text", F.size("pii_found").cast("bigint").alias("n_replaced"), F.array_join("pii_found", " ").alias("kinds"))


def op6_bit_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), end_id=1)


#: Documents have no paths, so they stand in directories of their source and the places of their ids: four levels, in which
#: every 8th document is its directory's licence file by its name, and every 64th that of the directory above.
PATH = (
    "concat(source, '/p', CAST(FLOOR(doc_id / 4096) AS BIGINT), CASE WHEN doc_id % 64 = 0 THEN '/LICENSE-' ELSE concat('/q', CAST(FLOOR(doc_id / 256) AS BIGINT), "
    "CASE WHEN doc_id % 8 = 0 THEN '/LICENSE-' ELSE concat('/r', doc_id % 2, '/') END) END, doc_id, '.txt')"
)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), F.expr(PATH))


def op8_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


#: The graded rating of a labelled document: 0 poor, 1 well written but toxic, 2 well written and clean.
GRADE, TOP_GRADE = "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 2 END", 2


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return ordinal.rate(docs, ordinal.fit(docs, _read(spark, sf_dir, "labels"), F.expr(GRADE), TOP_GRADE))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), most=16)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_read(spark, sf_dir, "documents"), least=30, share=80, most=2000)


def op13_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_read(spark, sf_dir, "documents"), [1.0] * 24, [1.0] * 25)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_simhash": op2_simhash,
        "op3_spotsigs": op3_spotsigs,
        "op4_best_fit": op4_best_fit,
        "op5_feistel_pii": op5_feistel_pii,
        "op6_bit_packed": op6_bit_packed,
        "op7_license_scan": op7_license_scan,
        "op8_isolation_rules": op8_isolation_rules,
        "op9_block_rules": op9_block_rules,
        "op10_ordinal_quality": op10_ordinal_quality,
        "op11_whitening": op11_whitening,
        "op12_collocations": op12_collocations,
        "op13_rendezvous": op13_rendezvous,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL: libraries' tokens, XXH64 (op2, op3), forests, regressions, Feistel networks, parsing of HTML, packing,
    eigenvectors, CRC32 (op13)."""
    return {"op7_license_scan": licenses.oracle_sql(PATH), "op12_collocations": collocations.oracle_sql()}
