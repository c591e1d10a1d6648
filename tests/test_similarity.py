import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemo.functions.similarity import indel_ratio_py, lcs_length


def dp_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_hand_cases():
    assert round(indel_ratio_py("small ring", "smal rings"), 2) == 90.0
    assert round(indel_ratio_py("kitten", "sitting"), 2) == 61.54
    assert indel_ratio_py("", "") == 100.0
    assert indel_ratio_py("abc", "") == 0.0
    assert indel_ratio_py(None, "abc") == 0.0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ü", max_size=40), st.text(alphabet="abcé ü", max_size=40))
def test_properties(a, b):
    r = indel_ratio_py(a, b)
    assert 0.0 <= r <= 100.0
    assert r == indel_ratio_py(b, a)
    assert (r == 100.0) == (a == b)
    assert lcs_length(a, b) == dp_lcs(a, b)


def test_spark_udf_matches_python(spark):
    from mnemo.functions.similarity import indel_ratio, similarity
    rnd = random.Random(7)
    pairs = [("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 30))),
              "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 30)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", indel_ratio("a", "b").alias("r"), similarity("a", "b").alias("s")).collect()
    for row in got:
        assert row.r == indel_ratio_py(row.a, row.b)
        assert abs(row.s - round(indel_ratio_py(row.a, row.b), 2)) < 1e-9


def test_bag_signature_loses_no_match(spark):
    """Signatures of two strings differ in no more bits than their indel distance."""
    import random

    from pyspark.sql import functions as F

    from mnemo.functions.similarity import bag_bound_ok, bag_signature, indel_ratio_py
    r = random.Random(6)
    letters = "abcde 12é😀日"
    rows = []
    for _ in range(1500):
        a = "".join(r.choice(letters) for _ in range(r.randrange(30)))
        b = list(a)
        for _ in range(r.randrange(9)):
            if b and r.random() < 0.5:
                b.pop(r.randrange(len(b)))
            else:
                b.insert(r.randrange(len(b) + 1), r.choice(letters))
        rows.append((a, "".join(b)))
    rows += [("", ""), ("a" * 300, "a" * 290 + "b"), ("x" * 70, "x" * 64)]
    df = spark.createDataFrame(rows, "a string, b string")
    differ = sum(F.bit_count(bag_signature("a")[w].bitwiseXOR(bag_signature("b")[w])) for w in range(4))
    ok = [bag_bound_ok(bag_signature("a"), bag_signature("b"), F.length("a"), F.length("b"), t).alias(f"t{t}") for t in (80, 85, 90)]
    dropped = 0
    for x in df.select("a", "b", differ.alias("differ"), *ok).collect():
        ratio = indel_ratio_py(x.a, x.b)
        assert x.differ <= round((len(x.a) + len(x.b)) * (1 - ratio / 100))
        for t in (80, 85, 90):
            assert x[f"t{t}"] or ratio < t
            dropped += not x[f"t{t}"]
    assert dropped > 500  # and it does rule pairs out


def test_strings_of_several_words_equal_brute_force():
    import random

    from mnemo.functions.similarity import lcs_batch, lcs_length

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(9)
    for letters in ("ab", "abcdefgh 12", "日本語é😀a"):
        a, b = [], []
        for n in (1, 63, 64, 65, 66, 127, 128, 129, 190, 256, 300, 511, 512, 513, 700):
            for m in (1, 64, 65, n, n + 1, 2 * n, 600):
                x = "".join(r.choice(letters) for _ in range(n))
                a.append(x)
                b.append("".join(r.choice(letters) for _ in range(m)) if r.random() < 0.5 else "".join(c for c in x if r.random() < 0.8)[:m])
        assert lcs_batch(a, b).tolist() == [lcs_length(x, y) for x, y in zip(a, b)]
        some = r.sample(range(len(a)), 12)
        assert [lcs_length(a[i], b[i]) for i in some] == [plain(a[i], b[i]) for i in some]
    long = ["".join(r.choice("abc ") for _ in range(2000)) for _ in range(4)]
    assert lcs_batch(long[:2], long[2:]).tolist() == [lcs_length(x, y) for x, y in zip(long[:2], long[2:])]
