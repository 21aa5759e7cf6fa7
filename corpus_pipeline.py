"""From raw documents to packed training sequences: five stages over the operators of terradelta.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terradelta.llm import lines, mixing, packing, simhash, toxicity
from terradelta.llm.common import table
from terradelta.sources.staging import scratch, shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labels, scores 0.3 or more go. Null and empty texts match
    nothing and stay; repeated rows are judged alike; without labels the grammar's own weights judge."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted from texts; every document stays, if with an empty text. Null
    texts stay null, and null doc_ids come last."""
    return lines.without_repeats(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id, nulls last. Links are those of
    op7_simhash (fingerprints at 2 or fewer bits, by ball hashing) and, beyond its radius, a similarity of 0.8 in
    five-word shingles. All texts without words, null ones too, are one group; of repeated rows one stays."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=0.8, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights. A null source is one of its own;
    texts without words take part but weigh nothing; rows that share a doc_id share out its copies."""
    return mixing.emit(docs, mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1,024. Null and empty texts are the one end id; an empty table has no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near dedup", dedup_near), ("mixing", mix_sources), ("packing", pack)]

#: No SQL expresses the learned grammar, the fingerprints or the packing; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each but the last written and read again; what a stage staged within goes."""
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        path = shared_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return last(spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
