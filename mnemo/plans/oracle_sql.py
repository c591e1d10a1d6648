"""DuckDB SQL for the correctness gate: the derived tables as CTEs plus helpers.

Each oracle query is ``WITH RECURSIVE <needed CTEs> <body>`` over the driver's
pre-registered views. The CTE texts follow FIXTURES.md. Similarity is computed
with a recursive CTE carrying the LCS dynamic-programming row, an independent
implementation of the kernel the Spark side runs.
"""

from __future__ import annotations

from mnemo.functions import text as T

WS = T.WS
STRIP = T.STRIP
PUNCT = T.PUNCT

# name -> (dependencies, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "items": ((), """SELECT CAST(p_partkey AS BIGINT) AS MovieID,
       concat(p_name, ' ', p_brand, ' (', CAST(1950 + p_partkey % 70 AS VARCHAR), ')') AS Title
FROM part"""),
    "items_ordered": (("items",), """SELECT MovieID, Title,
       CAST(row_number() OVER (ORDER BY MovieID) - 1 AS BIGINT) AS ItemPos FROM items"""),
    "interactions": ((), """SELECT CAST(o_custkey AS BIGINT) AS UserID, CAST(l_partkey AS BIGINT) AS MovieID,
       CAST(row_number() OVER (ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS RowIndex
FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""),
    "users": ((), """SELECT CAST(c_custkey AS BIGINT) AS UserID, substr(c_mktsegment, 1, 1) AS Gender,
       CAST(c_nationkey AS INTEGER) AS Age, CAST(c_custkey % 21 AS INTEGER) AS Occupation,
       lpad(CAST((c_custkey * 37) % 100000 AS VARCHAR), 5, '0') AS Zip_code,
       CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS RowIndex
FROM customer"""),
    "title_responses": (("items",), """SELECT MovieID,
       CASE MovieID % 7 WHEN 0 THEN 'Unknown'
                        WHEN 1 THEN Title
                        WHEN 2 THEN concat(CAST(MovieID AS VARCHAR), '::', Title)
                        WHEN 3 THEN upper(Title)
                        WHEN 4 THEN substr(Title, 1, length(Title) - 2)
                        WHEN 5 THEN substr(Title, 1, length(Title) - 7)
                        ELSE NULL END AS output
FROM items"""),
    "interaction_responses": (("interactions",), """SELECT RowIndex,
       CASE RowIndex % 4 WHEN 0 THEN concat(CAST(UserID AS VARCHAR), '::', CAST(MovieID AS VARCHAR))
                         WHEN 1 THEN concat(CAST(UserID AS VARCHAR), '::', CAST(MovieID + 1 AS VARCHAR))
                         WHEN 2 THEN 'Unknown'
                         ELSE 'content_filter_high' END AS output
FROM interactions"""),
    "user_responses": (("users",), """SELECT RowIndex,
       CASE RowIndex % 3 WHEN 0 THEN concat(CAST(UserID AS VARCHAR), '::', Gender, '::', CAST(Age AS VARCHAR), '::', CAST(Occupation AS VARCHAR), '::', Zip_code)
                         WHEN 1 THEN concat(CAST(UserID AS VARCHAR), '::', Gender, '::', CAST(Age AS VARCHAR), '::', CAST(Occupation AS VARCHAR), '::00000')
                         ELSE 'Unknown' END AS output
FROM users"""),
    "rec_lines": (("interactions", "items"), """SELECT u.UserID AS UserID, CAST(t.r AS INTEGER) AS r,
       CASE WHEN (u.UserID + t.r) % 97 = 0 OR i.Title IS NULL
            THEN concat('Lost Film ', CAST(t.r AS VARCHAR), ' (', CAST(1960 + u.UserID % 50 AS VARCHAR), ')')
            ELSE i.Title END AS Title
FROM (SELECT DISTINCT UserID FROM interactions WHERE UserID % 25 <> 3) u
CROSS JOIN range(1, 51) AS t(r)
LEFT JOIN items i ON i.MovieID = (u.UserID * 31 + t.r * 17) % (SELECT count(*) FROM part)
WHERE t.r <= CASE WHEN u.UserID % 10 = 0 THEN 30 ELSE 50 END"""),
    "rec_responses": (("rec_lines", "interactions"), """SELECT UserID, concat('Here is the list', chr(10), chr(10),
       string_agg(concat(CAST(r AS VARCHAR), '. ', Title), chr(10) ORDER BY r),
       CASE WHEN UserID % 40 = 1 THEN concat(chr(10), '0. No such rank', chr(10), '99999999999999999999. Beyond any rank',
                                             chr(10), '7. ', min(Title)) ELSE '' END) AS output
FROM rec_lines GROUP BY UserID
UNION ALL SELECT DISTINCT UserID, CAST(NULL AS VARCHAR) FROM interactions WHERE UserID % 25 = 3"""),
    "popularity": (("interactions",), """SELECT MovieID, PopularityScore,
       CAST(row_number() OVER (ORDER BY PopularityScore DESC, MovieID) AS BIGINT) AS PopRank
FROM (SELECT MovieID, count(DISTINCT UserID) AS PopularityScore FROM interactions GROUP BY MovieID)"""),
    "activity": (("interactions",), """SELECT UserID, count(DISTINCT MovieID) AS InteractionCount
FROM interactions GROUP BY UserID"""),
}


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{STRIP}', '', 'g')"


def clean_title(expr: str) -> str:
    return strip(f"regexp_replace({expr}, '{T.PARENS_RE2}', '', 'g')")


def normalize_plain(expr: str) -> str:
    return f"regexp_replace({strip(f'lower({expr})')}, '{PUNCT}', '', 'g')"


def normalize_clean(expr: str) -> str:
    return f"regexp_replace({strip(f'lower({clean_title(expr)})')}, '{PUNCT}', '', 'g')"


def response_text(output: str, on_error: str, key: str | None = None) -> str:
    cleaned = strip(f"replace({output}, CAST({key} AS VARCHAR) || '::', '')") if key else strip(output)
    return (f"CASE WHEN {output} IS NULL THEN '{on_error}' "
            f"WHEN {output} = '{T.CONTENT_FILTER_STATUS}' THEN '{T.CONTENT_FILTER_TEXT}' ELSE {cleaned} END")


def rint2(expr: str) -> str:
    return f"(round_even(CAST({expr} AS DOUBLE) * 100.0, 0) / 100.0)"


def coverage(correct: str, size: str) -> str:
    return f"(CASE WHEN {size} > 0 THEN {rint2(f'(CAST({correct} AS DOUBLE) / CAST({size} AS DOUBLE)) * 100.0')} ELSE 0.0 END)"


def lcs_ctes(name: str, pairs_sql: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """CTEs computing ``{name}(a, b, lcs)`` for the distinct non-null pairs of ``pairs_sql``."""
    return {
        f"{name}_p": ((), f"SELECT DISTINCT a, b FROM ({pairs_sql}) WHERE a IS NOT NULL AND b IS NOT NULL"),
        f"{name}_r(a, b, i, row)": ((f"{name}_p",), f"""SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: CAST(0 AS BIGINT)) FROM {name}_p
  UNION ALL
  SELECT a, b, i + 1,
         list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]),
                     lambda acc, j: list_append(acc, CASE WHEN substr(a, i + 1, 1) = substr(b, j[1], 1)
                                                          THEN row[j[1]] + 1
                                                          ELSE greatest(row[j[1] + 1], acc[len(acc)]) END),
                     [CAST(0 AS BIGINT)])
  FROM {name}_r WHERE i < length(a)"""),
        name: ((f"{name}_r(a, b, i, row)",), f"SELECT a, b, row[len(row)] AS lcs FROM {name}_r WHERE i = length(a)"),
    }


def ratio_expr(a: str, b: str, lcs: str) -> str:
    """Unrounded indel similarity from an LCS length."""
    t = f"(length({a}) + length({b}))"
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {t} = 0 THEN 100.0 "
            f"ELSE (1.0 - CAST({t} - 2 * {lcs} AS DOUBLE) / {t}) * 100.0 END)")


def sim_expr(a: str, b: str, lcs: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 100.0 ELSE {rint2(ratio_expr(a, b, lcs))} END)"


def build(body: str, *needs: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``WITH RECURSIVE`` + the needed CTEs in dependency order + ``body``."""
    defs = dict(CTES)
    if extra:
        defs.update(extra)
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in defs[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    parts = [f"{n} AS (\n{defs[n][1]}\n)" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


# --------------------------------------------------------------------------- reports

def lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


REPORT_COLS = "ord, first_item, last_item, errors, correct, size, coverage, line"


def _row_line(head_sql: str) -> str:
    return (f"concat({head_sql}, CAST(coverage AS VARCHAR), '% | Errors: ', CAST(errors AS VARCHAR), "
            f"' | Correct: ', CAST(correct AS VARCHAR), ' | Total: ', CAST(size AS VARCHAR))")


def percentile_report(src: str, percentiles, popularity: bool) -> tuple[dict, str]:
    """CTEs + body for analyze_results / analyze_results_popularity over ``src(rank, ErrorFlag)``."""
    from mnemo.functions import report as R
    head = (R.POPULARITY_LINE if popularity else R.PERCENTILE_LINE)[0]
    rows = []
    for i, p in enumerate(percentiles, start=1):
        valid = 0 <= p <= 100
        msg = None if valid else R.INVALID_PERCENTILE.format(p=R.py_number(p))
        rows.append(f"({i}, {lit(R.py_number(p))}, CAST({float(p)!r} AS DOUBLE), {str(valid).upper()}, {lit(msg)})")
    extra = {
        "rep_n": ((), f"SELECT count(*) AS n, CAST(coalesce(sum(ErrorFlag), 0) AS BIGINT) AS e FROM {src}"),
        "rep_e": ((), f"SELECT * FROM (VALUES {', '.join(rows)}) v(ord, label, p, valid, msg)"),
        "rep_c": (("rep_n", "rep_e"), """SELECT ord, label, valid, msg,
       CASE WHEN valid THEN greatest(1, CAST(floor((p / 100.0) * n) AS BIGINT)) END AS cut FROM rep_e, rep_n"""),
        "rep_v": (("rep_c",), f"""SELECT c.*, CAST((SELECT coalesce(sum(ErrorFlag), 0) FROM {src} s WHERE s.rank <= c.cut) AS BIGINT) AS errors
FROM rep_c c"""),
        "rep_r": (("rep_v",), f"""SELECT CAST(ord AS BIGINT) AS ord, CASE WHEN valid THEN CAST(1 AS BIGINT) END AS first_item,
       cut AS last_item, errors, cut - errors AS correct, cut AS size, label, valid, msg FROM rep_v"""),
    }
    head_sql = f"replace({lit(head)}, '{{p}}', label)"
    body = f"""SELECT ord, first_item, last_item,
       CASE WHEN valid THEN errors END AS errors, CASE WHEN valid THEN correct END AS correct,
       CASE WHEN valid THEN size END AS size, CASE WHEN valid THEN coverage END AS coverage,
       CASE WHEN valid THEN {_row_line(head_sql)} ELSE msg END AS line
FROM (SELECT *, {coverage('correct', 'size')} AS coverage FROM rep_r)
UNION ALL
SELECT CAST((SELECT count(*) FROM rep_e) + 1 AS BIGINT), CAST(1 AS BIGINT), n, e, n - e, n, {coverage('n - e', 'n')},
       concat('Total Coverage: ', CAST({coverage('n - e', 'n')} AS VARCHAR), '% | Total Errors: ', CAST(e AS VARCHAR))
FROM rep_n"""
    return extra, body


def curve_report(src: str, item_counts=None) -> tuple[dict, str]:
    """analyze_results_aggregate_popularity over ``src(rank, ErrorFlag)``."""
    extra = {"rep_n": ((), f"SELECT count(*) AS n, CAST(coalesce(sum(ErrorFlag), 0) AS BIGINT) AS e FROM {src}")}
    total = f"""SELECT CAST({'n + 1' if item_counts is None else f'{len(item_counts) + 1}'} AS BIGINT), CAST(1 AS BIGINT), n, e, n - e, n,
       {coverage('n - e', 'n')},
       concat('Total Coverage: ', CAST({coverage('n - e', 'n')} AS VARCHAR), '% | Total Errors: ', CAST(e AS VARCHAR),
              ' | Total Items: ', CAST(n AS VARCHAR))
FROM rep_n"""
    line = ("concat('Coverage at ', CAST(size AS VARCHAR), ' items: ', CAST(coverage AS VARCHAR), '% | Errors: ', "
            "CAST(errors AS VARCHAR), ' | Correct: ', CAST(correct AS VARCHAR), ' | Total: ', CAST(size AS VARCHAR))")
    if item_counts is None:
        extra["rep_p"] = ((), f"""SELECT CAST(rank AS BIGINT) AS k,
       CAST(sum(ErrorFlag) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS errors
FROM {src}""")
        body = f"""SELECT ord, first_item, last_item, errors, correct, size, coverage, {line} AS line FROM (
  SELECT k AS ord, CAST(1 AS BIGINT) AS first_item, k AS last_item, errors, k - errors AS correct, k AS size,
         {coverage('k - errors', 'k')} AS coverage FROM rep_p)
UNION ALL
{total}"""
        return extra, body
    rows = ", ".join(f"({i}, {int(c)})" for i, c in enumerate(item_counts, start=1))
    extra["rep_e"] = ((), f"SELECT * FROM (VALUES {rows}) v(ord, k)")
    extra["rep_v"] = (("rep_e", "rep_n"), f"""SELECT CAST(ord AS BIGINT) AS ord, CAST(k AS BIGINT) AS k, n, (k >= 1 AND k <= n) AS valid,
       CAST((SELECT coalesce(sum(ErrorFlag), 0) FROM {src} s WHERE s.rank <= k) AS BIGINT) AS errors FROM rep_e, rep_n""")
    body = f"""SELECT ord, first_item, last_item, errors, correct, size, coverage,
       CASE WHEN valid THEN {line} ELSE concat('Invalid item count: ', CAST(k AS VARCHAR), '. Must be between 1 and ', CAST(n AS VARCHAR), '.') END AS line
FROM (SELECT ord, valid, k, n, CASE WHEN valid THEN CAST(1 AS BIGINT) END AS first_item, CASE WHEN valid THEN k END AS last_item,
             CASE WHEN valid THEN errors END AS errors, CASE WHEN valid THEN k - errors END AS correct,
             CASE WHEN valid THEN k END AS size, CASE WHEN valid THEN {coverage('k - errors', 'k')} END AS coverage FROM rep_v)
UNION ALL
{total}"""
    return extra, body


def bucket_report(src: str, item_counts=None, bucket_size: int = 5, percentile_buckets=None) -> tuple[dict, str]:
    """analyze_results_by_(popularity_)buckets over ``src(rank, ErrorFlag)``."""
    extra = {"rep_n": ((), f"SELECT count(*) AS n, CAST(coalesce(sum(ErrorFlag), 0) AS BIGINT) AS e FROM {src}")}
    line = ("concat('Coverage for items [', CAST(first_item AS VARCHAR), '..', CAST(last_item AS VARCHAR), ']: ', "
            "CAST(coverage AS VARCHAR), '% | Errors: ', CAST(errors AS VARCHAR), ' | Correct: ', CAST(correct AS VARCHAR), "
            "' | Group Size: ', CAST(size AS VARCHAR))")
    if percentile_buckets:
        m = len(percentile_buckets)
        rows = ", ".join(f"({i}, CAST({float(p)!r} AS DOUBLE))" for i, p in enumerate(percentile_buckets, start=1))
        extra["rep_e"] = ((), f"SELECT * FROM (VALUES {rows}) v(ord, p)")
        extra["rep_k"] = (("rep_e", "rep_n"), f"""SELECT ord, CASE WHEN ord = {m} THEN n
       ELSE least(greatest(CAST(ceil(n * p) AS BIGINT), 1), n) END AS k, n FROM rep_e, rep_n""")
        n_rows = m
    elif item_counts is not None:
        rows = ", ".join(f"({i}, {int(c)})" for i, c in enumerate(item_counts, start=1))
        extra["rep_e"] = ((), f"SELECT * FROM (VALUES {rows}) v(ord, k)")
        extra["rep_k"] = (("rep_e", "rep_n"), "SELECT ord, CAST(k AS BIGINT) AS k, n FROM rep_e, rep_n")
        n_rows = len(item_counts)
    else:
        s = int(bucket_size)
        extra["rep_b"] = ((), f"""SELECT CAST(ceil(rank / {s}.0) AS BIGINT) AS ord, CAST(sum(ErrorFlag) AS BIGINT) AS errors,
       count(*) AS size FROM {src} GROUP BY 1""")
        body = f"""SELECT ord, first_item, last_item, errors, correct, size, coverage, {line} AS line FROM (
  SELECT ord, (ord - 1) * {s} + 1 AS first_item, least(ord * {s}, n) AS last_item, errors, size - errors AS correct, size,
         {coverage('size - errors', 'size')} AS coverage FROM rep_b, rep_n)
UNION ALL
SELECT CAST(ceil(n / {s}.0) AS BIGINT) + 1, CAST(1 AS BIGINT), n, e, n - e, n, {coverage('n - e', 'n')},
       concat('Total Coverage (all ', CAST(n AS VARCHAR), ' items): ', CAST({coverage('n - e', 'n')} AS VARCHAR), '% | Total Errors: ', CAST(e AS VARCHAR))
FROM rep_n"""
        return extra, body
    extra["rep_v"] = (("rep_k",), """SELECT ord, k, n, (k >= 1 AND k <= n) AS valid FROM rep_k""")
    extra["rep_l"] = (("rep_v",), """SELECT ord, k, n, valid,
       coalesce(last_value(CASE WHEN valid THEN k END IGNORE NULLS) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
FROM rep_v""")
    extra["rep_s"] = (("rep_l",), f"""SELECT CAST(ord AS BIGINT) AS ord, valid, k, n, lo,
       CASE WHEN k > lo THEN CAST((SELECT coalesce(sum(ErrorFlag), 0) FROM {src} s WHERE s.rank > lo AND s.rank <= k) AS BIGINT) ELSE 0 END AS errors,
       greatest(k - lo, 0) AS size FROM rep_l""")
    body = f"""SELECT ord, first_item, last_item, errors, correct, size, coverage,
       CASE WHEN valid THEN {line} ELSE concat('Invalid item count: ', CAST(k AS VARCHAR), '. Must be between 1 and ', CAST(n AS VARCHAR), '.') END AS line
FROM (SELECT ord, valid, k, n, CASE WHEN valid THEN lo + 1 END AS first_item, CASE WHEN valid THEN k END AS last_item,
             CASE WHEN valid THEN errors END AS errors, CASE WHEN valid THEN size - errors END AS correct,
             CASE WHEN valid THEN size END AS size, CASE WHEN valid THEN {coverage('size - errors', 'size')} END AS coverage FROM rep_s)
UNION ALL
SELECT CAST({n_rows + 1} AS BIGINT), CAST(1 AS BIGINT), n, e, n - e, n, {coverage('n - e', 'n')},
       concat('Total Coverage (all ', CAST(n AS VARCHAR), ' items): ', CAST({coverage('n - e', 'n')} AS VARCHAR), '% | Total Errors: ', CAST(e AS VARCHAR))
FROM rep_n"""
    return extra, body
