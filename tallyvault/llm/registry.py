"""The queries of this package: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvault.llm import fingerprint, knn, language, lines, merkle, mixing, near, oracles, overwrite, packing, pii, secrets, tokens, toxicity
from tallyvault.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of a document in the temperature mix of the sources, by block and position (see `mixing.mixed`)."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op1_source_mixing_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix with its last rounds filled, as the pipeline has it; op1_source_mixing is as its SQL has it."""
    return mixing.mixed(table(spark, sf_dir, "documents"), fill=True)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of a document in its sequence of at most 1024 tokens (see `packing.packed`)."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's toxicity, learned from the labels of ids whose remainder is not 0; a null id is not held out (see `toxicity.score`)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    out = toxicity.score(docs, machine)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets' spans in each text (see `secrets.secrets`)."""
    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each text (see `tokens.token_counts`)."""
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20 (see `knn.nearest`)."""
    return knn.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's language, learned from documents whose remainder is not 2; a null id is not held out (see `language.predict`)."""
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.fit(docs.filter(fold(F.col("doc_id"), 4) != 2)))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "phrases", "chars")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data's spans in each text (see `pii.personal_data`)."""
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near duplicates, its links and copies (see `near.near_duplicates`)."""
    return near.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", "copies")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text, and how alike they are (see `fingerprint.fingerprints`)."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each text loses that ten documents share, and the digest of what stays (see `lines.marked`)."""
    return lines.digests(table(spark, sf_dir, "documents"))


def op12_late_arrival_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the sales by day after late rows have overwritten the days they change (see `overwrite.overwritten`)."""
    return overwrite.digests(table(spark, sf_dir, "sales"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, roots and proof, and whether it verifies when some tell a wrong length (see `merkle.manifest`)."""
    return merkle.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"pipeline": corpus_pipeline.run} | {
        f.__name__: f
        for f in (
            op1_source_mixing, op1_source_mixing_filled, op2_best_fit_packing, op3_toxicity, op4_secret_scans, op5_token_counts,
            op6_nearest_neighbours, op7_language_id, op8_pii, op9_ngram_jaccard_join, op10_document_fingerprints, op11_line_dedup, op12_late_arrival_overwrite, op13_merkle_manifest,
        )
    }


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; tests/llm has brute force for the others."""
    return dict(oracles.ORACLES)
