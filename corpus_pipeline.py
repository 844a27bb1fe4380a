"""From raw documents to token rows: five stages, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows it
keeps.  All but the last return the columns of ``documents``; the last returns token ids.

Columns that ``documents`` does not define travel through a stage in one struct, so that none of them, whatever its
name, meets the columns that an operator adds.  Empty tables pass every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structscreen.llm import bpe, mixing, quality, simhash, substrings
from structscreen.llm.common import shared_dir
from structscreen.llm.queries import MIX_FRACTION, MIX_TARGETS, vocabulary_path, with_topic

#: No SQL form: fingerprints and BPE have none; tests/llm checks the stages on small tables.
ORACLE_SQL = None

_OWN = ("doc_id", "text", "lang", "source", "n_chars")
_CARRIED = "_carried_columns"


def _carried(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of documents and all others in one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in _OWN]
    return docs.select(*[c for c in docs.columns if c in _OWN], *([F.struct(*others).alias(_CARRIED)] if others else []))


def _unpacked(kept: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order, of a table made from ``_carried``."""
    return kept.select(*[F.col(c) if c in _OWN else F.col(_CARRIED)[c].alias(c) for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rule table."""
    return _unpacked(quality.keep_good(_carried(docs), lang_col="lang"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least id; rows with null or repeated ids are judged like any other."""
    return _unpacked(simhash.one_per_class(_carried(docs)), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in an earlier one; untouched texts stay as they are."""
    found = substrings.drop_repeats(_carried(docs))
    cut = F.col("n_removed") > 0
    found = found.withColumns({
        "text": F.when(cut, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")),
    })
    return _unpacked(found, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the calibrated probabilities of their source, language and form.

    The form of a text is the topic; a column ``topic`` of the input is carried along and not looked at.
    """
    mixed = mixing.mix(with_topic(_carried(docs)), MIX_TARGETS, "n_tokens", MIX_FRACTION)
    return _unpacked(mixed.where("sampled"), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and their number, beside the document's id and origin.

    The decoded text must be the text; a row that fails the round trip raises.
    """
    coded = bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), vocabulary_path())
    checked = F.when(F.col("decoded") == F.coalesce("text", F.lit("")), F.col("ids")).otherwise(F.raise_error(F.concat(F.lit("no round trip: "), F.col("doc_id").cast("string"))))
    return coded.select("doc_id", "lang", "source", "n_tokens", checked.alias("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
