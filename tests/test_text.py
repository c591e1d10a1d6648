from pyspark.sql import functions as F

from mnemo.functions import text as T


def one(spark, col_fn, value):
    return spark.createDataFrame([(value,)], "x string").select(col_fn(F.col("x")).alias("y")).first().y


def test_clean_title(spark):
    assert one(spark, T.clean_title, "Harry Potter (2008)") == "Harry Potter"
    assert one(spark, T.clean_title, "x (a(b) c)") == "x c)"


def test_normalizers(spark):
    assert one(spark, T.normalize_title_clean, "Misérables, Les (1995)") == "misérables les"
    assert one(spark, T.normalize_title_plain, "Misérables, Les (1995)") == "misérables les 1995"
    assert one(spark, T.normalize_title_plain, "x² y") == "x² y"


def test_strip_matches_python(spark):
    cases = [" a ", "\t\x0b a\x1c\x85", "　b ", "", "   ", "a​b ", "\xa0x\xa0"]
    for c in cases:
        assert one(spark, T.py_strip, c) == c.strip(), repr(c)


def test_split_lines_matches_python(spark):
    s = "a\r\nb\rc\x0bd\x1ce f\n"
    got = spark.createDataFrame([(s,)], "x string").select(T.split_lines("x").alias("y")).first().y
    assert [p for p in got if p] == [p for p in s.splitlines() if p]


def test_parse_ranked_list(spark):
    from mnemo.operators.recommend import parse_ranked_list
    text = "1. A\n 2. B b \n\nnoise\n10.C  3.  D\n0. Zero"
    df = spark.createDataFrame([(1, text)], "UserID long, output string")
    recs, rejects = parse_ranked_list(df)
    got = [(r.Rank, r.Title) for r in recs.orderBy("line_no").collect()]
    assert got == [(1, "A"), (2, "B b"), (10, "C  3.  D")]
    assert [(r.Rank, r.Title) for r in rejects.collect()] == [(0, "Zero")]


def test_record_and_sentinels(spark):
    df = spark.createDataFrame([(1, None), (2, "content_filter_high"), (3, " 3::x ")], "k long, o string")
    got = {r.k: r.a for r in df.select("k", T.response_text("o", T.ERROR_TEXT, key="k").alias("a")).collect()}
    assert got == {1: "Error", 2: "Azure Content Filter Error", 3: "x"}


def test_raw_line_keeps_quotes_and_rejects_short(spark, tmp_path):
    from mnemo.sources.files import ingest_delimited
    p = tmp_path / "u.dat"
    p.write_text('2::"Q" Toy::A::B::C\n3::short\n')
    ok, bad = ingest_delimited(spark, str(p), ["a", "b", "c", "d", "e"], [0, 1, 2, 3, 4])
    assert [tuple(r) for r in ok.collect()] == [("2", '"Q" Toy', "A", "B", "C")]
    assert [r.value for r in bad.collect()] == ["3::short"]


def test_latin1_lines(spark, tmp_path):
    from mnemo.sources.files import decode_lines
    p = tmp_path / "l.txt"
    p.write_bytes("Misérables\n".encode("latin-1") + "Müller\n".encode("utf-8"))
    assert [r.value for r in decode_lines(spark, str(p)).collect()] == ["Misérables", "Müller"]
