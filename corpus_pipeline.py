"""The training-corpus pipeline: five operators in a row over `documents`.

Each stage takes all rows its predecessor kept and its decisions take effect: rejected and contaminated documents go,
boilerplate lines leave the texts, one document of each near-duplicate group stays, and the last stage gives the mix.
All stages but the last return the columns of `documents`, and any more that `documents` has.

Null ids and texts pass: a null text is an empty one that holds no line, word or n-gram. Empty texts are kept by the
classifier, are near-duplicates of each other (one stays), and take no part in the mix but have a row in its result.
Repeated rows are near-duplicates. Ties go to the smallest id. An empty table gives empty tables. Texts of any length
are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontam, linededup, mixing, quality, simhash
from sluice.llm.common import cut, remove_folder, shared_folder, table


#: A line of this share of a source's documents, and of 4 of them, is boilerplate. Hosts of the corpus are large: passages
#: and licence lines that repeat thousands of times in it stand on under a hundredth of a host's documents.
BOILERPLATE_RATIO = 0.001


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_selected(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(docs, host_col="source", max_ratio=BOILERPLATE_RATIO, min_pages=4).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_similar(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document doc_id, size, source_size, target, taken, n_pieces, first_shard and last_shard (`mixing.mixed_texts`
    gives the shards' texts)."""
    return mixing.mix(docs, block=128, budget=1.5, repeat=2.0)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: SQL has neither the hash of the fingerprints nor the classifier's draw; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written to the shared folder and read as the next one's input.

    A stage's table goes when the next one's is written, the last when the result is checkpointed.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove_folder(spark, before)
    return out
