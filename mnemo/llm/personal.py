"""Personal data by anchor expansion.

An Aho-Corasick automaton goes over a text once and reports anchors, without which no
entity of a kind can be: at-signs, plus signs, digits, schemes and identifier cues. At
each anchor a small deterministic parser expands to the left and right, finds the exact
borders and validates what it has read. Parsers never look again at what one of their
kind has consumed, so the time is linear in the text whatever it holds.

Base kinds have the borders of a leftmost, non-overlapping pattern search:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Added kinds: ``url`` (addresses of a person behind a scheme: mailto, sip, tel, and
locations with user information) and ``account`` (identifiers behind a cue: IBANs with
their check number, social security, passport, tax and account numbers).
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemo.llm.common import fresh

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")

_DIGITS = frozenset(string.digits)
_ALNUM = frozenset(string.ascii_letters + string.digits)
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_PHONE = _DIGITS | frozenset(" ().-")
#: Characters of a location behind a scheme, and those of its user part.
_AUTHORITY = _ALNUM | frozenset("-._~%!$&'*+,;=:@[]")
_USER = _AUTHORITY - {"@", "[", "]", ":"}

#: Schemes whose address is a person's, and those whose location may name a user.
PERSON_SCHEMES = ("mailto:", "sip:", "sips:", "xmpp:", "tel:")
USER_SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "smb://")
#: Cues and the rule of the identifier behind them: its least and most characters
#: (without separators) and whether letters may stand in it.
CUES = {"iban": (15, 34, True), "ssn": (9, 9, False), "social security": (9, 9, False), "passport": (6, 9, True),
        "account": (6, 17, False), "acct": (6, 17, False), "tax id": (8, 12, True), "sort code": (6, 6, False),
        "routing": (9, 9, False), "konto": (6, 17, False), "kontonummer": (6, 17, False), "compte": (6, 23, False),
        "cuenta": (6, 20, False), "ausweis": (6, 10, True), "passeport": (6, 9, True), "pasaporte": (6, 9, True)}
#: Words that may stand between a cue and its identifier.
LINKS = ("number", "numéro", "numero", "número", "nummer", "num", "no", "nr", "n°", "id", "is", "ist", "est", "es")

Span = tuple[str, int, int]


def _run(text: str, i: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters that begins at ``i``."""
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def luhn(digits: list[int]) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban(value: str) -> bool:
    """Country letters, check digits and the remainder 1 modulo 97."""
    if not (value[:2].isalpha() and value[2:4].isdigit()):
        return False
    number = "".join(str(int(c, 36)) for c in value[4:] + value[:4])
    return int(number) % 97 == 1


def social_security(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


class Scanner:
    """The parsers over one text; each keeps the place up to which it has consumed."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[Span] = []
        self.done = dict.fromkeys(KINDS, 0)
        self.chain = 0  # dotted numbers are read up to here
        self.cards = 0  # and numbers with separators up to here

    def _keep(self, kind: str, start: int, end: int) -> None:
        self.done[kind] = end
        self.spans.append((kind, start, end))

    def at_sign(self, p: int) -> None:
        """An address around the at-sign: the local part grows to the left, labels to the right."""
        text, start = self.text, p
        least = self.done["email"]
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        end = _run(text, p + 1, _LABEL)
        if start == p or end == p + 1:
            return
        labels = 0
        while text[end:end + 1] == "." and (stop := _run(text, end + 1, _LABEL)) > end + 1:
            end, labels = stop, labels + 1
        if labels:
            self._keep("email", start, end)

    def digit(self, p: int) -> None:
        """Dotted quads and card numbers that begin at the digit."""
        text = self.text
        if p >= self.chain:
            ends = [_run(text, p, _DIGITS)]
            while len(ends) < 4 and text[ends[-1]:ends[-1] + 1] == "." and text[ends[-1] + 1:ends[-1] + 2] in _DIGITS:
                ends.append(_run(text, ends[-1] + 1, _DIGITS))
            self.chain = ends[-1]
            if len(ends) == 4:
                parts = text[p:ends[-1]].split(".")
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts):
                    self._keep("ip", p, ends[-1])
        if p >= self.cards:
            end, n = p, len(text)
            digits: list[int] = []
            count = 0
            while True:
                stop = _run(text, end, _DIGITS)
                if count < 20:  # beyond 19 digits only the border matters
                    digits += map(int, text[end:min(stop, end + 20)])
                count += stop - end
                if stop + 1 < n and text[stop] in " -" and text[stop + 1] in _DIGITS:
                    end = stop + 1
                else:
                    break
            self.cards = stop
            if 13 <= count <= 19 and luhn(digits):
                self._keep("card", p, stop)

    def plus(self, p: int) -> None:
        """A number in international form: all that may stand in it, back to its last digit."""
        text = self.text
        if p < self.done["phone"] or text[p + 1:p + 2] not in _DIGITS or p + 1 >= len(text):
            return
        end = _run(text, p + 2, _PHONE)
        while end > p + 2 and text[end - 1] not in _DIGITS:
            end -= 1
        if end < p + 4:  # nothing between the first and the last digit
            return
        self.done["phone"] = end
        if 9 <= sum(c in _DIGITS for c in text[p:end]) <= 15:
            self._keep("phone", p, end)

    def person(self, start: int, p: int) -> None:
        """``scheme:address`` that begins at ``start``, its address at ``p``."""
        text = self.text
        if start < self.done["url"] or start and text[start - 1] in _ALNUM:
            return
        if text[start:p].lower() == "tel:":
            end = _run(text, p + (text[p:p + 1] == "+"), _PHONE - {" "})
            while end > p and text[end - 1] not in _DIGITS:
                end -= 1
            good = 5 <= sum(c in _DIGITS for c in text[p:end]) <= 15
        else:
            at = _run(text, p, _USER)
            end = _run(text, at + 1, _LABEL | {"."}) if text[at:at + 1] == "@" else at
            while end > at + 1 and text[end - 1] in ".-":
                end -= 1
            good = at > p and end > at + 1
        if good:
            self._keep("url", start, end)

    def location(self, start: int, p: int) -> None:
        """``scheme://user[:password]@host[:port]``; without a user it is nobody's."""
        text = self.text
        if start < self.done["url"] or start and text[start - 1] in _ALNUM:
            return
        end = _run(text, p, _AUTHORITY)
        at = text.rfind("@", p, end)
        self.done["url"] = max(p, end)
        while end > p and text[end - 1] in ".,;:!'":
            end -= 1
        if p < at < end - 1:
            self._keep("url", start, end)

    def cue(self, start: int, p: int, rule: tuple[int, int, bool]) -> None:
        """The identifier behind the cue at ``start``, which ends at ``p``."""
        text = self.text
        if start < self.done["account"] or start and text[start - 1].isalnum() or text[p:p + 1].isalpha():
            return
        least, most, letters = rule
        for _ in range(3):  # link words and marks between the cue and its identifier
            i = p
            while i < len(text) and i < p + 3 and text[i] in " \t:=#.-":
                i += 1
            word = next((w for w in LINKS if text[i:i + len(w)].lower() == w and not text[i + len(w):i + len(w) + 1].isalnum()), None)
            p = i
            if word is None:
                break
            p += len(word)
        allowed, end, value = _ALNUM if letters else _DIGITS, p, ""
        while len(value) <= most:
            stop = _run(text, end, allowed)
            group = text[end:min(stop, end + most + 1)]
            if value and letters and not any(c in _DIGITS for c in group):
                break  # the next word of the sentence
            value, last = value + group, stop
            if not group or text[stop:stop + 1] not in (" ", "-") or text[stop + 1:stop + 2] not in allowed or not text[stop + 1:stop + 2]:
                break
            end = stop + 1
        if not value or not least <= len(value) <= most or text[last:last + 1].isalnum() or sum(c in _DIGITS for c in value) < 5:
            return
        if least == 15 and not iban(value.upper()) or least == most == 9 and not social_security(value):
            return
        self._keep("account", p, last)


def anchors():
    """The automaton over all anchors: each reports what it is and its length."""
    import ahocorasick
    made = ahocorasick.Automaton()

    def add(word: str, kind: str, rule=None) -> None:
        for form in {word, word.upper(), word.capitalize(), word.title()}:
            made.add_word(form, (kind, len(form), rule))

    add("@", "at")
    add("+", "plus")
    for d in sorted(_DIGITS):
        add(d, "digit")
    for s in PERSON_SCHEMES:
        add(s, "person")
    for s in USER_SCHEMES:
        add(s, "location")
    for c, rule in CUES.items():
        add(c, "cue", rule)
    made.make_automaton()
    return made


def spans(text: str, automaton) -> list[Span]:
    """(kind, start, end) in code points, end exclusive, by kind as listed, then start."""
    s = Scanner(text)
    for last, (kind, n, rule) in automaton.iter(text):
        if kind == "digit":
            s.digit(last)
        elif kind == "at":
            s.at_sign(last)
        elif kind == "plus":
            s.plus(last)
        elif kind == "cue":
            s.cue(last + 1 - n, last + 1, rule)
        elif kind == "person":
            s.person(last + 1 - n, last + 1)
        else:
            s.location(last + 1 - n, last + 1)
    return sorted(s.spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def masked(text: str, found: list[Span]) -> str:
    """The text with ``[KIND]`` in place of each span; of overlapping spans the first counts
    and the others go with it."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("stop", T.IntegerType())])
OUTPUTS = {"found": T.ArrayType(SPAN), "masked": T.StringType()}


def find_personal(docs: DataFrame, text: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """Add ``found`` (spans by kind as listed in ``KINDS``, then start; code points, ``stop``
    exclusive) and ``masked`` (the text without them) to ``docs``, or those in ``outputs``.

    A null or empty text has no spans; its masked text is empty. Other columns are kept,
    but for any that are called like an output. Repeated rows are scanned each by itself.
    """
    key = fresh(docs, "_text")
    out = list(outputs)
    src = docs.withColumn(key, F.coalesce(F.col(text), F.lit(""))).drop(*[c for c in docs.columns if c.lower() in out])
    schema = T.StructType([*src.drop(key).schema.fields, *[T.StructField(n, OUTPUTS[n]) for n in out]])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            keep = [n for n in batch.schema.names if n != key]
            found, hidden = [], []
            for t in batch.column(batch.schema.get_field_index(key)):
                t = t.as_py()
                got = spans(t, automaton)
                found.append([dict(zip(("kind", "start", "stop"), x)) for x in got])
                if "masked" in out:
                    hidden.append(masked(t, got))
            made = {"found": lambda: pa.array(found, kind), "masked": lambda: pa.array(hidden, pa.string())}  # noqa: B023
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in keep], *[made[n]() for n in out]], names=[*keep, *out])

    return src.mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans beside the id of each document."""
    def told(spans_):
        return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")

    def of(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return scanned.select("doc_id", *map(of, KINDS), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
                          told(F.col("found")).alias("spans"))
