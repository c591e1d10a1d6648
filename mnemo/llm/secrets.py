"""Secret scans by assignment-aware lexing.

Lines that bind something are lexed like source code or configuration: names, quoted
literals (of one line or in triple quotes), marks (=, :, :=, =>, ->) and the rest. Marks are
then read with what stands around them: indexes and type annotations left of them, several
names at once, and on their right literals joined by + or side by side, bare words, calls,
and indented blocks; tags bind their attributes, a key attribute its value, and an
element its text. That gives name-literal pairs. A name on the right passes on what was
last bound to it in the same text, so a secret that goes through constants is found where it
is written. A value made of others keeps references to them, its length and how often each
character occurs, never the joined text of any length, and each literal is told its best
target in one pass back over the bindings: the work follows the text's length, not
the length of what its constants would spell. A literal is scored by how sensitive its target
name is and by how random its characters look; literals over the threshold are spans.

Three plain pattern kinds are always reported beside these pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm.common import fresh

# fixed values: the base patterns and their least lengths
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "literal")

#: How much a word of a target name adds to the score; a name's words are split at
#: case changes, digits and punctuation.
SENSITIVE = {"password": 4.0, "passwd": 4.0, "pwd": 4.0, "passphrase": 4.0, "secret": 4.0, "credential": 4.0,
             "credentials": 4.0, "token": 3.5, "apikey": 4.0, "privatekey": 4.0, "accesskey": 4.0, "auth": 2.5,
             "bearer": 3.0, "key": 2.0, "private": 2.0, "api": 1.5, "access": 1.5, "signing": 1.5, "encryption": 1.5,
             "salt": 1.5, "jwt": 3.0, "session": 1.0, "client": 0.5}
#: Words that make a name public after all, and literals that only stand for one.
PUBLIC = {"public": -3.0, "id": -1.0, "name": -2.0, "file": -2.0, "path": -2.0, "url": -2.0, "count": -3.0, "length": -3.0}
STAND_IN = re.compile(r"(?i)changeme|example|placeholder|dummy|your[_-]|xxx|\*\*\*|todo|<[^>]*>|\$\{|\{\{|^(?:true|false|null|none)$")
THRESHOLD = 5.0

_ASSIGN = re.compile(f"(?ai:{ASSIGN[:ASSIGN.index(')') + 1]}){ASSIGN[ASSIGN.index(')') + 1:]}")
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run that is long enough; shorter runs fail anyway

#: Characters up to which a value made of several literals is kept as text.
KEPT = 256
#: Functions that fetch a value by its name: their arguments are no secrets.
FETCH = re.compile(r"(?i)get|load|read|fetch|find|lookup|env|from|input|prompt|open|path|join|format|print|log")

_BINDS = re.compile(r"[=:]|->")
_TOKEN = re.compile(r"""
    (?P<triple>(?<!\w)[rbufRBUF]{0,2}(?P<q3>\"{3}|'{3})(?:(?!(?P=q3))[\s\S])*(?P=q3))
    |(?P<string>(?<!\w)[rbufRBUF]{0,2}(?P<q>["'`])(?:\\.|(?!(?P=q))[^\\\n])*(?P=q))
    |(?P<name>(?<![\w$])[A-Za-z_$][\w$]*(?:[.-]+[\w$]+)*)
    |(?P<mark>:=|=>|->|[=!<>]=|=|:(?!:))
    |(?P<newline>\n)
    |(?P<other>[^\s])
""", re.X)
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]&|<>]+")
_KEY = re.compile(r"[\w.$ -]+\Z")
_TYPE = frozenset(".[]<>|?*&,")
_TAG = re.compile(r"""<([A-Za-z][\w:.-]*)((?:\s+[\w:.-]+\s*=\s*(?:"[^"<>\n]*"|'[^'<>\n]*'))+)\s*/?>""")
_ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"<>\n]*)"|'([^'<>\n]*)')""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w:.-]*)>([^<>\s]+)</\1>")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_score(name: str) -> float:
    """Sensitivity of a target name: of its words and of neighbouring words joined."""
    words = [w.lower() for w in _WORDS.findall(name)]
    score = sum(SENSITIVE.get(w, 0.0) + PUBLIC.get(w, 0.0) for w in words)
    return score + sum(max(0.0, SENSITIVE.get(a + b, 0.0) - SENSITIVE.get(a, 0.0) - SENSITIVE.get(b, 0.0))
                       for a, b in zip(words, words[1:]))


class Value:
    """A literal, or several in a row: its parts (places in the list of all values, or the
    span of a literal), and what its score takes."""

    __slots__ = ("parts", "span", "length", "counts", "text", "blank", "stands", "ends")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None):
        self.parts: list[Value] = []
        self.span, self.text, self.length = span, text, len(text)
        self.counts = Counter(text)
        self.blank = any(c.isspace() for c in text)
        self.stands = bool(STAND_IN.search(text))
        self.ends = text[:16], text[-16:]

    @staticmethod
    def of(parts: list[Value]) -> Value:
        if len(parts) == 1:
            return parts[0]
        out = Value()
        out.parts, out.length = parts, sum(p.length for p in parts)
        out.blank = any(p.blank for p in parts)
        for p in parts:
            out.counts.update(p.counts)
        if out.length <= KEPT:
            out.text = "".join(p.text for p in parts)
            out.stands = bool(STAND_IN.search(out.text))
        else:  # a part that stands for a secret, or what meets where two parts do
            out.stands = any(p.stands for p in parts) or any(STAND_IN.search(a.ends[1] + b.ends[0]) for a, b in zip(parts, parts[1:]))
        joined = "".join(p.ends[0] for p in parts)[:16], "".join(p.ends[1] for p in parts)[-16:]
        out.ends = (out.text[:16], out.text[-16:]) if out.length <= KEPT else joined
        return out

    def score(self) -> float:
        """How random it looks: bits per character, kinds of characters, length."""
        n = self.length
        if n < 8 or self.stands or self.blank:
            return -math.inf
        bits = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        kinds = len({"a" if c.islower() and c.isascii() else "A" if c.isupper() and c.isascii() else "0" if c in "0123456789" else "-"
                     for c in self.counts})
        return bits / 2 + 0.4 * (kinds - 1) + min(n, 40) / 40


class Lexer:
    """The bindings of one text, in order: (target name, value)."""

    def __init__(self, text: str):
        self.text = text
        self.bindings: list[tuple[str, Value]] = []
        self.made: list[Value] = []  # values of several parts, each after its parts
        self.known: dict[str, Value] = {}
        at = 0
        while m := _BINDS.search(text, at):
            at = self._line(max(at, text.rfind("\n", at, m.start()) + 1))
        if "<" in text:
            self._tags()

    def _bind(self, name: str, value: Value) -> None:
        self.known[name] = self.known[name.rpartition(".")[2]] = value
        self.bindings.append((name, value))

    def _inner(self, token: re.Match) -> tuple[int, int]:
        """The span between the quotes of a literal."""
        quote = token["q3"] or token["q"]
        return token.start() + token[0].index(quote) + len(quote), token.end() - len(quote)

    def _lines(self, start: int, end: int) -> list[Value]:
        """A literal of several lines: each line's text without what surrounds it."""
        out = []
        for m in re.finditer(r"[^\n]+", self.text[start:end]):
            body = m[0].strip()
            if body:
                at = start + m.start() + m[0].index(body)
                out.append(Value(body, (at, at + len(body))))
        return out

    def _line(self, start: int) -> int:
        """Read the line at ``start``, or more where a literal goes on; where the next begins."""
        text, tokens, at = self.text, [], start
        while m := _TOKEN.search(text, at):
            if m.lastgroup == "newline":
                break
            tokens.append(m)
            at = m.end()
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        left: dict[int, list[str]] = {}  # names that a later mark binds, past an annotation
        skip = 0
        for i, t in enumerate(tokens):
            if t.lastgroup != "mark" or i < skip or t[0] in ("!=", "<=", ">="):
                continue
            names = left.get(i) or self._names(tokens, i)
            if not names:
                continue
            if t[0] == ":" and (j := self._annotation(tokens, i + 1)):
                left[j] = names
                continue
            if t[0] == ":" and i + 1 < len(tokens) and re.match(r"[|>][+-]?[ \t]*(?:\n|\Z)", text[tokens[i + 1].start():end + 1]):
                block = self._block(start, end)
                if parts := self._lines(end, block):
                    self._bind(names[-1], self._joined(parts))
                return block
            values, skip = self._values(tokens, i + 1)
            if len(names) == 1 and values:
                values = values[:1]
            for name, value in zip(names, values):
                if value is not None:
                    self._bind(name, value)
        return end + 1

    def _names(self, tokens: list[re.Match], i: int) -> list[str]:
        """The name left of the mark at ``i``, or several if a statement begins with them."""
        while i > 1 and tokens[i - 1][0] == "?":
            i -= 1
        if not i:
            return []
        t = tokens[i - 1]
        if t.lastgroup == "string":
            key = self.text[slice(*self._inner(t))]
            return [key] if _KEY.match(key) else []
        if t[0] == "]" and i > 2 and tokens[i - 3][0] == "[" and tokens[i - 2].lastgroup in ("string", "name"):
            key = tokens[i - 2]
            return [self.text[slice(*self._inner(key))] if key.lastgroup == "string" else key[0]]
        if t.lastgroup != "name":
            return []
        j = i - 1
        while j > 1 and tokens[j - 1][0] == "," and tokens[j - 2].lastgroup == "name":
            j -= 2
        if j < i - 1 and (j == 0 or tokens[j - 1][0] in (";", "(") or tokens[j - 1].lastgroup == "name"):
            return [x[0] for x in tokens[j:i:2]]
        return [t[0]]

    def _annotation(self, tokens: list[re.Match], i: int) -> int | None:
        """The ``=`` behind a type that begins at ``i``, if nothing but a type stands there."""
        j = i
        while j < len(tokens) and (tokens[j].lastgroup == "name" or tokens[j][0] in _TYPE):
            j += 1
        return j if i < j < len(tokens) and tokens[j][0] == "=" else None

    def _block(self, start: int, end: int) -> int:
        """The end of the lines after ``end`` that are indented deeper than the line at ``start``."""
        deep = len(self.text[start:end]) - len(self.text[start:end].lstrip(" \t-"))
        at = end + 1
        while at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            line = self.text[at:stop]
            if line.strip() and len(line) - len(line.lstrip(" \t")) <= deep:
                break
            at = stop + 1
        return min(at, len(self.text))

    def _joined(self, parts: list[Value]) -> Value:
        value = Value.of(parts)
        if len(parts) > 1:
            self.made.append(value)
        return value

    def _values(self, tokens: list[re.Match], i: int) -> tuple[list[Value | None], int]:
        """The values right of a mark, one for each comma, and the token after what they consumed."""
        out: list[Value | None] = []
        while True:
            value, i = self._value(tokens, i)
            out.append(value)
            if value is None or i >= len(tokens) or tokens[i][0] != ",":
                return out, i
            i += 1

    def _value(self, tokens: list[re.Match], i: int) -> tuple[Value | None, int]:
        parts: list[Value] = []
        while i < len(tokens):
            t = tokens[i]
            if t.lastgroup == "string":
                a, b = self._inner(t)
                parts.append(Value(self.text[a:b], (a, b)))
            elif t.lastgroup == "triple":
                parts += self._lines(*self._inner(t))
            elif t.lastgroup == "name" and i + 1 < len(tokens) and tokens[i + 1][0] == "(" and tokens[i + 1].start() == t.end():
                # a call: its literals, unless they only say what to fetch
                j = i + 2
                while j < len(tokens) and tokens[j][0] != ")":
                    if tokens[j].lastgroup == "string" and not FETCH.search(t[0]):
                        a, b = self._inner(tokens[j])
                        parts.append(Value(self.text[a:b], (a, b)))
                    j += 1
                i = j
            elif t.lastgroup == "name" and (known := self.known.get(t[0]) or self.known.get(t[0].rpartition(".")[2])):
                parts.append(known)
            elif not parts and t[0] == "(":
                i += 1
                continue
            elif t[0] in ("[", "{"):
                break  # what is inside binds by itself
            elif not parts and t.lastgroup != "mark" and (m := _BARE.match(self.text, t.start())):
                body = m[0].rstrip(".:")
                if not body:
                    break
                parts.append(Value(body, (m.start(), m.start() + len(body))))
                while i < len(tokens) and tokens[i].start() < m.end():
                    i += 1
                i -= 1
            else:
                break
            i += 1
            if i < len(tokens) and tokens[i][0] == "+":
                i += 1
            elif not (i < len(tokens) and tokens[i].lastgroup == "string" and tokens[i - 1].lastgroup == "string"):
                break
        parts = [p for p in parts if p.length]
        return (self._joined(parts) if parts else None), i

    def _tags(self) -> None:
        for m in _TAG.finditer(self.text):
            at = m.start(2)
            named = {a[1].lower(): (a[2] if a[2] is not None else a[3], at + (a.start(2) if a[2] is not None else a.start(3)))
                     for a in _ATTRIBUTE.finditer(m[2])}
            key = next((named[k][0] for k in ("key", "name", "id") if k in named), None)
            value = next((named[v] for v in ("value", "content") if v in named), None)
            if key and value and value[0]:
                self.bindings.append((key, Value(value[0], (value[1], value[1] + len(value[0])))))
        for m in _ELEMENT.finditer(self.text):
            self.bindings.append((m[1], Value(m[2], m.span(2))))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain patterns, leftmost and non-overlapping within a kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, str, float]]:
    """("literal", start, end, target name, score) of the literals over the threshold; of
    several targets of a literal the one of the highest score."""
    lexer = Lexer(text)
    best: dict[int, tuple[float, str]] = {}  # by value
    spans: dict[tuple[int, int], tuple[float, str]] = {}

    def told(value: Value, found: tuple[float, str]) -> None:
        held = spans if value.span else best
        key = value.span or id(value)
        if key not in held or found[0] > held[key][0]:
            held[key] = found

    for name, value in lexer.bindings:
        named = name_score(name)
        if named > 0 and (score := named + value.score()) >= threshold:
            told(value, (score, name))
    for value in reversed(lexer.made):  # from values to their parts, which were made before
        if found := best.get(id(value)):
            for part in value.parts:
                told(part, found)
    return [("literal", a, b, n, s) for (a, b), (s, n) in sorted(spans.items())]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("stop", T.IntegerType()), T.StructField("name", T.StringType()),
                     T.StructField("score", T.DoubleType())])


def scan_secrets(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``found``: an array of (kind, start, stop, name, score) by start, then kind;
    code points, ``stop`` exclusive; name and score only for kind ``literal``.

    A null or empty text has none. Other columns are kept. Names and literals are bound
    within a text only.
    """
    key = fresh(docs, "_text")
    src = docs.withColumn(key, F.coalesce(F.col(text), F.lit(""))).drop(
        *[c for c in docs.columns if c.lower() == "found"])
    schema = T.StructType([*src.drop(key).schema.fields, T.StructField("found", T.ArrayType(SPAN))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                               ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n for n in batch.schema.names if n != key]
            found = []
            for t in batch.column(batch.schema.get_field_index(key)):
                t = t.as_py()
                all_ = [(*x, None, None) for x in base_spans(t)] + literal_spans(t, threshold)
                all_.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                found.append([dict(zip(("kind", "start", "stop", "name", "score"), x)) for x in all_])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in keep], pa.array(found, kind)],
                names=[*keep, "found"])

    return src.mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans beside the id of each document."""
    def of(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def told(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")

    base = F.filter("found", lambda x: x["kind"] != "literal")
    return scanned.select("doc_id", of("assign"), of("access"), of("hex"), of("literal"),
                          F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
                          told(F.col("found")).alias("spans"))
