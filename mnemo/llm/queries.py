"""Queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm import alignment, audit, fingerprint, forest, langid, linededup, lm, mixing, neardup, pages, personal, pieces, secrets
from mnemo.llm.common import read_table, staged

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn
    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


@query("op1_mix_sources", mixing.ORACLE_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of the 5:2:1 mix at 150 % of all words."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    lean = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = mixing.mix_sources(lean, size=F.col("size"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_fingerprint")
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how like they are to each
    other and to the next document's."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    f = staged(fingerprint.fingerprint_edits(docs), "fingerprints")  # read twice below
    following = f.select(F.col("doc_id").alias("next_id"), F.col("own").alias("next_own"))
    return f.join(following, "next_id").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.to_hex(F.col("own")).alias("fingerprint"),
        fingerprint.to_hex(F.col("edited")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        fingerprint.likeness(F.col("own"), F.col("next_own")).alias("near_next"))


#: The vocabulary file, found by the installed package of public tokenizers.
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path(PIECE_MODEL)


@query("op7_encode_pieces")
def op7_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return pieces.digest(pieces.encode_pieces(docs, piece_model()))


@query("op6_scan_secrets")
def op6_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every whole text."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return secrets.digest(secrets.scan_secrets(docs))


@query("op9_score_language_model")
def op9_score_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and Kneser-Ney scores of every whole text, learnt from nine tenths of them."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumn(
        "held_out", lm.remainder(F.col("doc_id"), 10) == 0)
    model = lm.train(docs.where("NOT held_out"))
    return lm.score(docs, model).drop("text")


@query("op4_near_duplicates", neardup.ORACLE_SQL)
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles are 80 % alike or more."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return neardup.near_duplicates(docs, neardup.Settings(width=2))


@query("op2_identify_language")
def op2_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every whole text, learnt from documents not held out."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    net = langid.learn(docs)
    return langid.identify(docs.select("doc_id", "text"), net).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op10_dedup_lines", linededup.ORACLE_SQL)
def op10_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) without repeated chunks of lines."""
    return linededup.remove_repeated(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op8_near_vectors", forest.ORACLE_SQL)
def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at cosine 0.95 or more."""
    return forest.near_duplicates(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


@query("op3_extract_pages")
def op3_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars): the article of every page."""
    table = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    net = pages.learn(table)
    return pages.extract(table, net).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The byte-level vocabulary that documents are aligned with.
BYTE_MODEL = "byte_bpe_50k.json"


def both_tokenizers() -> alignment.Tokenizers:
    import public_tokenizers
    return alignment.load(public_tokenizers.path(BYTE_MODEL), piece_model())


@query("op11_align_tokens")
def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers' tokens of every whole text, as counts and digests."""
    whole = alignment.Alignment(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), both_tokenizers())
    return whole.digests(whole.pair_counts())


@query("op12_audit_filters", audit.ORACLE_SQL)
def op12_audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every part, order and step."""
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    counts = audit.count_masks(spark, f"{sf_dir.rstrip('/')}/documents.parquet", "doc_id long, text string, lang string", labels)
    return audit.audit(counts)


@query("op13_find_personal")
def op13_find_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the personal data in every whole text."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return personal.digest(personal.find_personal(docs, outputs=("found",)))
