"""From raw documents to token files: language, near-duplicates, benchmark leaks, source mix, ids.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets, written as Parquet and read again between
them. All but the last return the columns of documents.

Nulls: a null or empty text has no language and goes with the first stage; null ids, languages and sources are kept (a
null source is a source of the mix, a null language becomes the one found). Very long texts are worked off whole. Ties
and repeated rows: of rows that repeat an id and its text one stays. Empty table: an empty result. Further columns of the
input are carried along to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweave.llm import decontaminate, language_id, mixing, near_dedup, token_counts, token_files
from bitweave.session import Staging, fresh_path, stage, table

#: Parts of the mix are texts that no SQL here cuts alike, and the ids are a tokenizer's: tested by brute force instead.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: no letter, or no language clearly ahead."""
    return language_id.keep(docs, language_id.training_sample(docs, "doc_id", "text", "lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id, once; of rows that repeat an id and its text, one.

    Rows without an id stay. Ids that repeat are rare: those alone are compared by text.
    """
    with Staging(spark) as own:
        about = near_dedup.groups(docs).where("doc_id is not null")
        odd = about.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    odd = stage(odd, "dropped")
    own.sweep(odd)  # else all of it is still there while the texts are shuffled
    single = docs.join(odd.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = odd.where("kept").select("doc_id")
    if repeated.isEmpty():
        return single
    return single.unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the amounts of the mix: repeated, cut or left out; n_chars follows the text."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they say of each document."""
    folder = fresh_path(spark, "token-files")
    files = token_files.write(docs, folder, token_counts.tokenizer_path("word_bpe_49k.json"))
    return token_files.read(spark, folder, files, digests=True)


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("mix_sources", source_mix),
    ("token_files", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scopes: list[Staging] = []
    for n, (name, step) in enumerate(STAGES):
        with Staging(spark) as own:
            docs = step(spark, docs, sf_dir)
            if n + 1 < len(STAGES):
                docs = stage(docs, name)
        if n + 1 < len(STAGES):
            own.sweep(docs)  # what the stage itself wrote on the way
            for s in scopes:
                s.sweep()  # what the stages before it handed on
            scopes.append(own)
    return docs
