"""File scans and sinks with explicit schemas (nothing is inferred)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.functions.text import py_strip

# Reference input layouts.
ITEMS_SCHEMA = "MovieID LONG, Title STRING"
INTERACTIONS_SCHEMA = "UserID LONG, MovieID LONG, RowIndex LONG"
USERS_HEADER = ["UserID", "Gender", "Age", "Occupation", "Zip-code"]
TEST_NOHEADER_SCHEMA = "UserID LONG, MovieID LONG, Interact STRING"

# Python csv.writer behaviour: quotes doubled, whitespace kept, empty string written empty.
_CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
              "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}
_CSV_READ = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false", "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Header CSV scan; a missing path raises (AnalysisException: PATH_NOT_FOUND)."""
    return (spark.read.schema(schema).options(**_CSV_READ).option("header", str(header).lower())
            .option("sep", sep).csv(path))


def with_file_order(df: DataFrame, out_col: str) -> DataFrame:
    """Add the 0-based position of each row over all files: by file name, then as the
    rows stand in the file. ``df`` is a file scan; splits of a file keep their order."""
    from mnemo.operators.positions import global_index
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_row")).drop("_metadata")
    return global_index(tagged, ["_file", "_block", "_row"], out_col).drop("_file", "_block", "_row")


def read_named(spark: SparkSession, path: str, wanted: dict[str, str], sep: str = ",", order_col: str | None = None) -> DataFrame:
    """The ``wanted`` columns (name -> type) of CSV files with a header line, whatever their
    order and whatever other columns there are. All files must have the same header; a
    missing column, a value of another type and a missing path raise. ``order_col`` adds
    the row's position in the files."""
    header = spark.read.option("header", "true").option("sep", sep).options(**_CSV_READ).csv(path).columns
    if missing := [c for c in wanted if c not in header]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    schema = ", ".join(f"`{c}` {wanted.get(c, 'STRING')}" for c in header)
    df = (spark.read.schema(schema).options(**_CSV_READ).option("header", "true").option("enforceSchema", "false")
          .option("sep", sep).csv(path))
    if order_col:
        tagged = df.select(*wanted, "_metadata")
        return with_file_order(tagged, order_col).drop("_metadata")
    return df.select(*wanted)


def read_items(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """(MovieID, Title), with ``order`` also ItemPos, from any header CSV that has these columns."""
    return read_named(spark, path, {"MovieID": "LONG", "Title": "STRING"}, order_col="ItemPos" if order else None)


def read_interactions(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """(UserID, MovieID), with ``order`` also RowIndex: the parser prunes the other columns."""
    return read_named(spark, path, {"UserID": "LONG", "MovieID": "LONG"}, order_col="RowIndex" if order else None)


def read_users(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """(UserID, Gender, Age, Occupation, Zip_code), with ``order`` also RowIndex."""
    types = dict(zip(USERS_HEADER, ("LONG", "STRING", "INT", "INT", "STRING")))
    df = read_named(spark, path, types, order_col="RowIndex" if order else None)
    return df.withColumnRenamed("Zip-code", "Zip_code")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return read_csv(spark, path, schema, header=header, sep="\t")


def read_test_noheader(spark: SparkSession, path: str) -> DataFrame:
    """Headerless TSV (UserID, MovieID, Interact); the first two columns are kept."""
    return read_tsv(spark, path, TEST_NOHEADER_SCHEMA, header=False).select("UserID", "MovieID")


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**_CSV_WRITE).option("header", str(header).lower()).option("sep", sep).csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    write_csv(df, path, header=header, sep="\t")


def ingest_delimited(spark: SparkSession, path: str, header: Sequence[str],
                     columns_to_keep: Sequence[int] | None = None, sep: str = "::") -> tuple[DataFrame, DataFrame]:
    """Raw ``::``-separated text -> (accepted, rejects).

    Each line is stripped and split on the literal separator; quotes are data.
    With ``columns_to_keep`` a line too short for a kept index is rejected and
    extra fields are ignored; without it every line passes: the header's columns (null
    where the line is too short) and what lies beyond them as one text, ``extra``.
    """
    lines = spark.read.text(path)
    parts = F.split(py_strip(F.col("value")), "\\Q" + sep + "\\E", -1)
    with_parts = lines.select("value", parts.alias("_p"))
    if columns_to_keep is None:
        rest = F.slice("_p", len(header) + 1, F.greatest(F.size("_p") - len(header), F.lit(0)))
        named = [F.get("_p", F.lit(i)).alias(h) for i, h in enumerate(header)]
        extra = F.when(F.size("_p") > len(header), F.array_join(rest, sep)).alias("extra")
        return with_parts.select(*named, extra), with_parts.filter(F.lit(False)).select("value")
    need = max(columns_to_keep) + 1
    ok = F.size("_p") >= need
    accepted = with_parts.filter(ok).select(*[F.col("_p")[i].alias(header[i]) for i in columns_to_keep])
    return accepted, with_parts.filter(~ok).select("value")


def decode_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines in UTF-8 or ISO-8859-1, decided per line: valid UTF-8 stays, anything
    else is decoded from its raw bytes as Latin-1 (no whole-file sampling)."""
    v = F.col("value")
    return spark.read.text(path).select(
        F.when(F.is_valid_utf8(v), v).otherwise(F.decode(v.cast("binary"), "ISO-8859-1")).alias("value"))


def write_latin1_lines(df: DataFrame, text_col: str, latin1: F.Column, path: str) -> None:
    """Fixture writer: lines where ``latin1`` holds are written as ISO-8859-1 bytes."""
    raw = F.when(latin1, F.encode(F.col(text_col), "ISO-8859-1").cast("string")).otherwise(F.col(text_col))
    df.select(raw.alias("value")).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """One text file at ``path``, a line per report row in ``ord`` order.

    A curve has a line per item, so the lines are written by as many tasks as they need,
    as parts beside the file; then the parts are put together in order and the whole takes
    its place by a rename. A report of before stays until then, and a reader never sees a half.
    """
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    report.orderBy("ord").select("line").write.text(parts)
    _join_parts(report.sparkSession, parts, path)


def _join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of ``folder``, in the order of their names, as the file ``path``. Where
    the file system can join files it does (no byte is read); elsewhere they are copied one
    after the other through a buffer."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    parts = [x.getPath() for x in sorted(fs.listStatus(at), key=lambda x: x.getPath().getName())
             if x.getPath().getName().startswith("part-") and x.getLen() > 0]
    whole = hadoop.fs.Path(f"{folder}/whole")
    rest = spark.sparkContext._gateway.new_array(hadoop.fs.Path, max(len(parts) - 1, 0))
    for i, p in enumerate(parts[1:]):
        rest[i] = p
    try:
        if parts:
            if len(parts) > 1:
                fs.concat(parts[0], rest)
            whole = parts[0]
        else:
            fs.create(whole).close()
    except Py4JJavaError as e:
        if "UnsupportedOperationException" not in e.java_exception.getClass().getName():
            raise
        out = fs.create(whole)
        for p in parts:
            source = fs.open(p)
            hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
        out.close()
    fs.delete(target, True)
    if not fs.rename(whole, target):
        raise OSError(f"could not write {path}")
    fs.delete(at, True)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line): the lines of a report, numbered from 1."""
    lines = with_file_order(spark.read.text(path).select("value", "_metadata"), "ord")
    return lines.select((F.col("ord") + 1).alias("ord"), F.col("value").alias("line"))
