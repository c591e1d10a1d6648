import math
import random

import pytest

from mnemo.operators import coverage as C


def ranked(spark, flags):
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(flags)], "rank long, ErrorFlag int")


def lines(df):
    return [r.line for r in df.orderBy("ord").collect()]


def brute_percentiles(flags, percentiles, head="Coverage at {p}th percentile: "):
    """Straightforward restatement of the report rules, used as a brute-force oracle."""
    n, out = len(flags), []
    for p in percentiles:
        if p < 0 or p > 100:
            out.append(f"Invalid percentile value: {p}. Must be between 0 and 100.")
            continue
        cp = max(1, int((p / 100) * n))
        e = sum(flags[:cp])
        cov = float(round((cp - e) / cp * 100 * 100) / 100) if False else float(__import__("numpy").rint((cp - e) / cp * 100 * 100) / 100)
        out.append(head.format(p=p) + f"{cov}% | Errors: {e} | Correct: {cp - e} | Total: {cp}")
    e = sum(flags)
    cov = float(__import__("numpy").rint((n - e) / n * 100 * 100) / 100)
    out.append(f"Total Coverage: {cov}% | Total Errors: {e}")
    return out


def test_hand_case(spark):
    got = lines(C.coverage_percentiles(ranked(spark, [0, 1, 0, 0, 1]), [1, 10, 50, 100]))
    assert got == ["Coverage at 1th percentile: 100.0% | Errors: 0 | Correct: 1 | Total: 1",
                   "Coverage at 10th percentile: 100.0% | Errors: 0 | Correct: 1 | Total: 1",
                   "Coverage at 50th percentile: 50.0% | Errors: 1 | Correct: 1 | Total: 2",
                   "Coverage at 100th percentile: 60.0% | Errors: 2 | Correct: 3 | Total: 5",
                   "Total Coverage: 60.0% | Total Errors: 2"]


def test_cut_truncation_and_invalid(spark):
    flags = [0] * 100
    got = lines(C.coverage_percentiles(ranked(spark, flags), [29, 101]))
    assert got[0].endswith("Total: 28")
    assert got[1] == "Invalid percentile value: 101. Must be between 0 and 100."


def test_random_against_brute_force(spark):
    rnd = random.Random(3)
    flags = [rnd.randint(0, 1) for _ in range(137)]
    ps = [0, 1, 7, 33, 50, 99, 100]
    assert lines(C.coverage_percentiles(ranked(spark, flags), ps)) == brute_percentiles(flags, ps)


def test_curve_total_equals_total(spark):
    flags = [1, 0, 0, 1, 1, 0, 0]
    rep = C.coverage_curve(ranked(spark, flags)).orderBy("ord").collect()
    assert len(rep) == len(flags) + 1
    assert rep[-2].errors == rep[-1].errors == sum(flags)
    assert rep[-1].line.endswith(f"| Total Items: {len(flags)}")


def test_buckets_by_size(spark):
    flags = [0] * 13
    got = lines(C.coverage_buckets(ranked(spark, flags), bucket_size=5))
    assert [g.split("]")[0] for g in got[:-1]] == ["Coverage for items [1..5", "Coverage for items [6..10",
                                                   "Coverage for items [11..13"]
    assert got[-1] == "Total Coverage (all 13 items): 100.0% | Total Errors: 0"


def test_bucket_ends():
    assert C.bucket_ends(10, None, 5, [0.2, 0.6, 1.0]) == [2, 6, 10]
    assert C.bucket_ends(10, None, 5, [0.2, 0.8]) == [2, 10]
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            C.bucket_ends(10, None, 5, [bad])


def test_bucket_errors_sum_to_total(spark):
    rnd = random.Random(5)
    flags = [rnd.randint(0, 1) for _ in range(97)]
    rep = C.coverage_buckets(ranked(spark, flags), item_counts=[10, 5, 40, 200, 97]).orderBy("ord").collect()
    last, want = 0, []
    for c in [10, 5, 40, 200, 97]:          # brute force: slices [last:c] of the valid ends
        if 1 <= c <= 97:
            want.append(sum(flags[last:c]))
            last = c
        else:
            want.append(None)
    assert [r.errors for r in rep[:-1]] == want
    asc = C.coverage_buckets(ranked(spark, flags), item_counts=[10, 40, 97]).orderBy("ord").collect()
    assert sum(r.errors for r in asc[:-1]) == sum(flags) == asc[-1].errors
    assert rep[1].size == 0 and rep[1].coverage == 0.0           # non-ascending end: empty slice
    assert rep[3].line == "Invalid item count: 200. Must be between 1 and 97."


def test_many_cuts_use_prefix_table(spark):
    rnd = random.Random(9)
    flags = [rnd.randint(0, 1) for _ in range(300)]
    counts = list(range(1, 301, 3))
    rep = C.coverage_curve(ranked(spark, flags), counts).orderBy("ord").collect()
    for r, c in zip(rep, counts):
        assert r.errors == sum(flags[:c])
    assert math.isclose(rep[-1].coverage, float(__import__("numpy").rint((300 - sum(flags)) / 300 * 100 * 100) / 100))
