"""A training corpus from raw documents, in five stages.

Each stage takes what the one before kept, written to the shared folder as Parquet and
read again, so a lost executor costs tasks of one stage only. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm import langid, linededup, mixing, neardup, pieces
from mnemo.llm.common import packed, read_table, staged, unpacked
from mnemo.llm.queries import piece_model

#: Languages are told apart by far higher scores; below this a text is of none of them.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages: those that are undetermined (null texts,
    texts without letters) or score below ``MIN_SCORE`` go. With nothing to learn from, all go."""
    net = langid.learn(docs)
    found = langid.identify(packed(docs, ["doc_id", "text"]), net)
    good = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return unpacked(good, docs.columns, ["doc_id", "text"])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without chunks of lines that came before; ``n_chars`` follows."""
    out = unpacked(linededup.remove_repeated(packed(docs, ["doc_id", "text"])), docs.columns, ["doc_id", "text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 80 %)."""
    return unpacked(neardup.keep_one(packed(docs, ["doc_id", "text"])), docs.columns, ["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the 5:2:1 mix at 150 % takes them."""
    own = packed(docs, ["doc_id", "text", "source"])
    return unpacked(mixing.emit_mix(own), docs.columns, ["doc_id", "text", "source"])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the token ids of each document, with an end id."""
    coded = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"), piece_model(), outputs=("ids",))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("identify_language", identify_language), ("dedup_lines", dedup_lines),
          ("near_duplicates", drop_near_duplicates), ("mix_sources", mix_sources), ("encode_pieces", encode)]

#: SQL has no network and no tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
