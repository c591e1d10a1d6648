"""Line dedup by content-defined chunks of lines.

Every line has a hash, and a rolling hash runs over each line and the one before it. A
chunk ends after a line whose rolling hash is a local minimum, so borders depend on the
lines around them alone: lines put in front of a passage, or taken away, move no border
inside it, and two borders are never next to each other. Chunks of two lines or more that
occur again anywhere are compared byte for byte with their first occurrence (least
doc_id, then place) and removed if they are equal.

All of it is column expressions and joins. Counting needs hashes only; the text of a
chunk travels only if its hash occurs again. The first occurrence is found by a minimum
that map tasks take beforehand, and the copies meet it in a join whose hot keys can be
split, so a passage that a third of all documents share is no group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import WORD, fresh, staged

MIN_LINES = 2
#: Chunks of fewer words repeat by chance.
MIN_WORDS = 10


def _held(value: Column) -> Column:
    """A value worked out once here: what reads it below is not merged with its making."""
    return F.explode(F.array(value))


def _rolling(hashes: Column) -> Column:
    return F.transform(hashes, lambda h, i: (h * 31 + F.coalesce(F.get(hashes, i - 1), F.lit(0)) * 17) % F.lit(2147483647))


def with_chunks(texts: DataFrame) -> DataFrame:
    """Add ``lines`` and ``starts`` (the first line of each chunk, from 0) to rows with ``text``."""
    keep = texts.columns
    line_hash = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")
    return (texts.select(*keep, _held(F.split("text", "\n", -1)).alias("lines"))
            .select(*keep, "lines", _held(F.transform("lines", line_hash)).alias("hashes"))
            .select(*keep, "lines", _held(_rolling(F.col("hashes"))).alias("rolling"))
            # a line starts a chunk if the line before it is a minimum; the first line always does
            .select(*keep, "lines", _held(F.filter(
                F.sequence(F.lit(0), F.size("lines") - 1),
                lambda i: (i == 0) | F.coalesce((F.get("rolling", i - 1) < F.get("rolling", i - 2))
                                                & (F.get("rolling", i - 1) <= F.get("rolling", i)), F.lit(False)))).alias("starts")))


def _chunks(cut: DataFrame, keep: list[str]) -> DataFrame:
    """A row per chunk: ``keep``, first_line, n_lines and body."""
    size = F.size("lines")
    return (cut.select(*keep, "lines", "starts", F.posexplode("starts").alias("chunk", "first_line"))
            .withColumn("n_lines", F.coalesce(F.get("starts", F.col("chunk") + 1), size) - F.col("first_line"))
            .select(*keep, "first_line", "n_lines",
                    F.array_join(F.slice("lines", F.col("first_line") + 1, F.col("n_lines")), "\n").alias("body")))


def remove_repeated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated chunks, and ``n_lines`` and ``n_removed``
    (lines before, lines removed).

    docs has doc_id and text; other columns are kept. A null text stays null, with 0
    lines; an empty text is one empty line. Rows with the same doc_id and text are one
    document: they are treated alike and are no copies of each other. A null doc_id comes
    after all others. A text that was all repeated chunks is empty. An empty table gives none.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, mark, lines, gone_ = (fresh(docs, x) for x in ("_key", "_mark", "_lines", "_gone"))
    identity = [F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).alias(key), F.xxhash64("text").alias(mark)]
    texts = docs.where("text IS NOT NULL").select(*identity, "text")
    long_enough = (F.col("n_lines") >= min_lines) & (F.regexp_count("body", F.lit(WORD)) >= min_words)

    # hashes only: where does each chunk come first, and does it come again?
    brief = staged(_chunks(with_chunks(texts), [key, mark]).where(long_enough)
                   .select(key, mark, "first_line", "n_lines", F.xxhash64("body").alias("hash"), F.length("body").alias("size"))
                   .distinct(), "chunk_hashes")
    again = (brief.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, mark, "first_line")).alias("first"))
             .where("n > 1").select("hash", "size", "first"))
    members = (brief.join(again, ["hash", "size"])
               .select(key, mark, F.struct("first_line", "n_lines", "hash", "size",
                                           (F.struct(key, mark, "first_line") == F.col("first")).alias("is_first")).alias("m")))
    per_doc = staged(members.groupBy(key, mark).agg(F.collect_list("m").alias("members")), "repeated_chunks")

    # the bodies of those chunks, and the byte comparison. Either join with the texts is
    # planned as at full size, where nothing beside the texts is small
    bodies = (texts.join(per_doc.hint("merge"), [key, mark])
              .select(key, mark, F.explode(F.array(F.split("text", "\n", -1))).alias("lines"), "members")
              .select(key, mark, "lines", F.explode("members").alias("m"))
              .select(key, mark, "m.*", F.array_join(F.slice("lines", F.col("m.first_line") + 1, F.col("m.n_lines")), "\n").alias("body")))
    firsts = bodies.where("is_first").select("hash", "size", F.col("body").alias("first_body")).dropDuplicates(["hash", "size"])
    copies = bodies.where("NOT is_first").join(firsts, ["hash", "size"]).where(F.col("body") == F.col("first_body"))
    gone = staged(copies.groupBy(key, mark).agg(F.collect_set(F.struct("first_line", "n_lines")).alias("gone")), "removed_chunks")

    out = (docs.select(*names, *identity).join(gone.withColumnRenamed("gone", gone_).hint("merge"), [key, mark], "left")
           .select(*names, F.explode(F.array(F.split("text", "\n", -1))).alias(lines), gone_))
    left = F.filter(lines, lambda x, i: ~F.exists(gone_, lambda g: (i >= g["first_line"]) & (i < g["first_line"] + g["n_lines"])))
    removed = F.coalesce(F.aggregate(gone_, F.lit(0), lambda s, g: s + g["n_lines"]), F.lit(0))
    text = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in names],
                      F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), removed.alias("n_removed"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, (h * 31 + coalesce(lag(h) OVER w, 0) * 17) % 2147483647 AS r FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, CASE WHEN r < lag(r) OVER w AND r <= lead(r) OVER w THEN 1 ELSE 0 END AS cut FROM r
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM c),
b AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n FROM k GROUP BY doc_id, chunk),
d AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, chunk) AS nth FROM b
      WHERE n >= 2 AND len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) >= 10),
x AS (SELECT k.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE coalesce(nth, 1) = 1) AS text,
             count(*)::INT AS n_lines, (count(*) FILTER (WHERE nth > 1))::INT AS n_removed
      FROM k LEFT JOIN d ON d.doc_id = k.doc_id AND d.chunk = k.chunk GROUP BY k.doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text,
       coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed
FROM documents LEFT JOIN x ON x.doc_id = documents.doc_id
"""
