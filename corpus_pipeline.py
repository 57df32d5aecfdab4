"""Training text from raw documents, in five stages that each work on all the one before has kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custspark.llm import bpe, disclosure, fertility, fmindex, jaccard
from custspark.llm.common import table
from custspark.session import collected, discard, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates share this percentage of their shingles of so many words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _counted(docs: DataFrame) -> DataFrame:
    """The characters counted anew, as texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and their language's fertility bands keep."""
    return fertility.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id."""
    return jaccard.first_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without the passages of the benchmark."""
    return _counted(fmindex.cleaned(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with personal data replaced by labels, and terms that reveal it."""
    return _counted(disclosure.cleaned(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256 of each text that is left."""
    coded = bpe.digests(docs, keep=("doc_id", "lang", "source"))
    return coded.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256")


#: Folders that the stages called last have made for themselves.
_held: list[str] = []


def _after_the_others(stage: Stage) -> Stage:
    """The stage, which first deletes what the one before has made for itself.

    A stage's result must be stored before the next stage is called, as ``run`` does: then nothing
    reads its intermediate tables any more, and they would only fill the shared folder.
    """

    @wraps(stage)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _held)
        with collected() as folders:
            out = stage(spark, docs, sf_dir)
        _held[:] = folders
        return out

    return called


STAGES = [
    ("quality rules", _after_the_others(quality_rules)),
    ("n-gram Jaccard join", _after_the_others(near_duplicates)),
    ("benchmark decontamination", _after_the_others(decontamination)),
    ("PII", _after_the_others(personal_data)),
    ("BPE encoding and decoding", _after_the_others(encoding)),
]

#: Fertility, disclosure and byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
