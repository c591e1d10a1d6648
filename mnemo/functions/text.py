"""String column expressions with Python ``str`` semantics.

Java regexes differ from Python's in what counts as whitespace, a word
character and a line break, so the classes are spelled out once here. The same
classes are valid RE2 (DuckDB), which the oracle SQL reuses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() / str.strip() treat as whitespace.
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_CLASS}]"
# The line boundaries of Python's str.splitlines().
LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
# Python r'[^\w\s]' on str: anything but a letter, a number, '_' or whitespace.
PUNCT = rf"[^\p{{L}}\p{{N}}_{WS_CLASS}]"
# Python r'\s*\(.*?\)' ('.' stops only at '\n'); Java needs UNIX_LINES for that.
PARENS_JAVA = rf"(?d){WS}*\(.*?\)"
PARENS_RE2 = rf"{WS}*\(.*?\)"
STRIP = rf"^{WS}+|{WS}+$"
# Python re.match(r"(\d+)\.\s*(.+)", line) on a stripped line (ASCII digits).
RANKED_LINE_RE2 = rf"^([0-9]+)\.{WS}*(.+)"

# Failure sentinels written in place of a model answer.
CONTENT_FILTER_STATUS = "content_filter_high"
CONTENT_FILTER_TEXT = "Azure Content Filter Error"
ERROR_TEXT = "Error"
TITLE_ERROR_TEXT = ""
UNKNOWN_TITLE = "Unknown"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The same whitespace as single characters, for a cheap first/last-character test.
WS_CHARS = (["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0", "\u1680"]
            + [chr(c) for c in range(0x2000, 0x200B)] + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"])


def py_strip(col) -> Column:
    """``str.strip()``: removes all leading/trailing Unicode whitespace. ``trim`` with
    an explicit character set does exactly that, without a regex and without
    repeating its argument (nested normalisers stay linear expressions)."""
    return F.trim(_c(col), F.lit("".join(WS_CHARS)))


def clean_title(col) -> Column:
    """Drop every parenthesised part (lazy, first ')' wins) and strip."""
    c = _c(col)
    return py_strip(F.when(F.instr(c, "(") > 0, F.regexp_replace(c, PARENS_JAVA, "")).otherwise(c))


def normalize_title_plain(col) -> Column:
    """lower -> strip -> delete punctuation; parenthesised text is kept."""
    return F.regexp_replace(py_strip(F.lower(_c(col))), PUNCT, "")


def normalize_title_clean(col) -> Column:
    """clean_title -> lower -> strip -> delete punctuation (no strip afterwards)."""
    return F.regexp_replace(py_strip(F.lower(clean_title(col))), PUNCT, "")


def strip_key_echo(output, key) -> Column:
    """Remove every ``"<key>::"`` the model echoed back, then strip."""
    return py_strip(F.replace(_c(output), F.concat(_c(key).cast("string"), F.lit("::")), F.lit("")))


def record_string(*cols) -> Column:
    """``"a::b::..."``; a null part makes the whole record null (concat, not concat_ws,
    which would silently skip it)."""
    return F.concat(*sum(([F.lit("::"), _c(c).cast("string")] for c in cols), [])[1:])


def split_lines(col) -> Column:
    return F.split(_c(col), LINE_BREAKS)


def split_record(col, index: int) -> Column:
    """``text.split('::')[index]`` (0-based); '' when the record is shorter."""
    return F.split_part(_c(col), F.lit("::"), F.lit(index + 1))


def model_slug(col) -> Column:
    return F.replace(_c(col), F.lit("/"), F.lit("_"))


def response_text(output, on_error: str, key=None) -> Column:
    """Answer text for a raw model output: failure sentinels, else the stripped
    output (with the echoed key removed when ``key`` is given)."""
    out = _c(output)
    cleaned = strip_key_echo(out, key) if key is not None else py_strip(out)
    return (F.when(out.isNull(), F.lit(on_error))
            .when(out == F.lit(CONTENT_FILTER_STATUS), F.lit(CONTENT_FILTER_TEXT))
            .otherwise(cleaned))


def last_message(messages) -> Column:
    """Answer of a chat output: ``output[-1]['content']``."""
    return F.element_at(_c(messages), -1).getField("content")


def rint2(col) -> Column:
    """numpy's ``round(x, 2)`` = rint(x*100)/100 (half-even on the scaled double)."""
    return F.rint(_c(col).cast("double") * 100.0) / 100.0
