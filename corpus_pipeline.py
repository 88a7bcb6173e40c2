"""Corpus preparation as stages, each written and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtape.llm import bpe, mixing, similar, suffix_dedup, toxicity
from fluxtape.llm.scratch import materialize, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of a repeated string that goes: fewer than nearly all passages of over 50 words have.
PASSAGE = 256


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Null and empty texts score the model's bias alone and stay; repeated rows are judged
    alike; an empty table stays empty, and other columns are only carried.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels).where("predicted = 0").select("doc.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash links and others, all of a similarity
    of 0.8 or more of five-word shingles.

    It is the one of the smallest doc_id, null ones last; a doc_id on several rows counts each of
    its texts by itself, and repeated rows stay once.  Null and wordless texts are one group.
    An empty table stays empty, and other columns are only carried.
    """
    return similar.one_of_each(docs, shingle_words=5, similarity=0.8, max_bits=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated strings of PASSAGE bytes; emptied ones stay.

    A null text becomes the empty one, characters that are cut in two go whole, and n_chars follows the
    text.  Rows of equal texts lose them both; an empty table stays empty, and other
    columns are only carried.
    """
    done = suffix_dedup.remove_repeats(docs, length=PASSAGE, as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return done.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with flattened shares of source, language and topic.

    Null sources and languages are members of their own, null texts count as empty ones, rows of one
    doc_id are drawn alike within a cell; an empty table stays empty, and other columns are only carried.
    """
    return mixing.mixed(docs).where("drawn_").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the count and digest of its token ids, and the digest of the bytes they decode to.

    A null text has no tokens; every row gives one, and an empty table none.
    """
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokens),
]

#: A trained scorer, fingerprints and suffix sorting are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            release(before)
        before = docs
    return docs
