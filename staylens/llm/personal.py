"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs (plain, full-width, or
spelled out as ``[at]``), scheme marks, plus signs, digits, and cue words that announce
an account or identity number in four languages.  From each anchor a local parser expands to both
sides and validates what it finds; it never goes back behind its last finding, so a text
is read in time linear in its length.

* ``email``, ``ip``, ``card``, ``phone``: the base kinds.  Findings are leftmost, longest
  from their start, and do not overlap within a kind; one that fails its check (parts
  above 255, number of digits, Luhn) is dropped and reading goes on behind it.
* ``email_alt``: an address with letters beyond ASCII, a full-width or spelled-out
  at-sign, and spelled-out dots, where the base kind finds none.
* ``login``: scheme, user and host of an address that carries a user's name.
* ``iban``: behind its cue, the longest run of 15 to 34 characters that passes mod 97.
* ``account``: behind its cue, a number of 5 to 34 digits and capitals, 5 digits at least.

Positions are code points, ends exclusive.  Cues count in lower, capitalised and upper
case, and only as whole words.

Defined cases: a null text is empty and has no spans (:func:`redact` leaves it null); an
empty table gives no rows; each row is read alone, so repeated rows and null or repeated
ids give a row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import map_arrow, rows_of, whole_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_alt", "login", "iban", "account")

# Words that announce an account or identity number.
CUES = """
account|account no|account number|acct|bank account|passport|passport no|passport number
ssn|social security|social security number|tax id|routing number|driver license
konto|kontonummer|kontonr|reisepass|reisepassnummer|steuernummer|ausweisnummer
compte|numéro de compte|passeport|numéro fiscal|sécurité sociale
cuenta|número de cuenta|pasaporte|número fiscal|seguridad social
""".replace("\n", "|").strip("|").split("|")
# Spelled-out at-signs.
AT_SIGNS = ("＠", "[at]", "(at)", "{at}", " [at] ", " (at) ", " {at} ", "&#64;", "%40")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}").match
_DIGITS = re.compile(r"[0-9]++").match
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++").match
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_ALT_DOMAIN = re.compile(
    r"[\w-]{1,63}+(?:(?:\.| ?[\[({]dot[\])}] ?)[\w-]{1,63}+)++", re.IGNORECASE).match
_USER = re.compile(r"[^\s/?#@<>\"'\\]++@[\w.-]*\w").match
_JOINER = re.compile(r"\s{0,3}(?:(?:no|nr|number|num|nummer|numéro|número|n°|id|is|est|es|ist)"
                     r"\b\.?)?[\s:#=.]{0,4}", re.IGNORECASE).match
_NUMBER = re.compile(r"[A-Z]{0,3}[0-9](?:[ /-]?[0-9A-Z]){4,33}+(?!\w)").match
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+").match


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an IBAN's check digits hold."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    """The automaton over all anchors; a value is (parser, length)."""
    found = {"@": "at", "+": "plus", "://": "scheme", **{str(d): "digit" for d in range(10)}}
    found |= {form(a): "alt" for a in AT_SIGNS for form in (str.lower, str.upper)}
    for cue, parser in [("iban", "iban"), *((c, "cue") for c in CUES)]:
        found |= {form: parser for form in (cue, cue.capitalize(), cue.title(), cue.upper())}
    out = ahocorasick.Automaton()
    for text, parser in found.items():
        out.add_word(text, (parser, len(text)))
    out.make_automaton()
    return out


class SpanFinder:
    """Spans of one text: (kind number, start, end), by kind and start."""

    def __init__(self):
        self._iter = _anchors().iter
        self._parsers = {"at": self._email, "alt": self._alt, "plus": self._phone,
                         "digit": self._digit, "scheme": self._login, "iban": self._iban,
                         "cue": self._account}

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        self.spans: set[tuple[int, int, int]] = set()
        self.behind = dict.fromkeys((*KINDS, "chain"), 0)     # where each parser goes on
        for last, (parser, length) in self._iter(text):
            self._parsers[parser](text, last + 1 - length, last + 1)
        return sorted(self.spans)

    def _keep(self, kind: str, start: int, end: int, valid: bool = True) -> None:
        self.behind[kind] = end
        if valid:
            self.spans.add((KINDS.index(kind), start, end))

    def _email(self, text: str, at: int, after: int) -> None:
        start, least = at, self.behind["email"]
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN(text, after) if start < at else None
        if domain:
            self._keep("email", start, domain.end())
        else:
            self._alt(text, at, after)

    def _alt(self, text: str, at: int, after: int) -> None:
        start, least = at, max(self.behind["email_alt"], at - 64)
        while start > least and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
            start -= 1
        domain = _ALT_DOMAIN(text, after) if start < at else None
        if domain and text[domain.end() - 1].isalpha():
            self._keep("email_alt", start, domain.end())

    def _digit(self, text: str, at: int, after: int) -> None:
        if at >= self.behind["ip"]:
            if four := _IP(text, at):
                self._keep("ip", at, four.end(), all(map(_octet, four[0].split("."))))
            else:
                self.behind["ip"] = _DIGITS(text, at).end()
        if at >= self.behind["card"] and (chain := _CHAIN(text, at)):
            digits = chain[0].replace(" ", "").replace("-", "")
            self._keep("card", at, chain.end(), 16 <= len(digits) <= 19 and luhn(digits))

    def _phone(self, text: str, at: int, after: int) -> None:
        if at >= self.behind["phone"] and (number := _PHONE(text, at)):
            digits = sum(c.isdigit() for c in number[0])
            self._keep("phone", at, number.end(), 8 <= digits <= 15)

    def _login(self, text: str, at: int, after: int) -> None:
        start, least = at, max(self.behind["login"], at - 32)
        while start > least and text[start - 1].isalnum() and text[start - 1].isascii():
            start -= 1
        user = _USER(text, after) if start < at else None
        if user:
            self._keep("login", start, user.end())

    def _value(self, text: str, at: int, after: int) -> int:
        """Where the value behind a cue starts; -1 if the cue is part of a longer word."""
        if at and text[at - 1].isalnum() or text[after:after + 1].isalnum():
            return -1
        return _JOINER(text, after).end()

    def _iban(self, text: str, at: int, after: int) -> None:
        start = self._value(text, at, after)
        run = _IBAN(text, start) if start >= 0 else None
        for end in range(run.end() if run else 0, start + 14, -1):
            code = text[start:end].replace(" ", "")
            if text[end - 1] != " " and 15 <= len(code) <= 34 and mod97(code):
                return self._keep("iban", start, end)

    def _account(self, text: str, at: int, after: int) -> None:
        start = self._value(text, at, after)
        if start >= self.behind["account"] and (number := _NUMBER(text, start)):
            if sum(c.isdigit() for c in number[0]) >= 5:
                self._keep("account", start, number.end())


_SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                  ("end", pa.int32())]))


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and ``spans``, an array of (kind, start, end) in the
    order of KINDS, then of the start."""
    names = pa.array(KINDS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = SpanFinder()
        for batch in batches:
            found = [finder(text) for (text,) in rows_of([batch], "text")]
            flat = np.array([s for spans in found for s in spans], dtype=np.int32).reshape(-1, 3)
            spans = pa.StructArray.from_arrays(
                [names.take(pa.array(flat[:, 0])), pa.array(flat[:, 1]), pa.array(flat[:, 2])],
                fields=list(_SPANS_TYPE.value_type))
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), spans)],
                names=["doc_id", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return map_arrow(texts, find,
                     "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by its kind in
    square brackets; other columns, names and order stay."""
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = SpanFinder()
        for batch in batches:
            out = []
            for (text,) in rows_of([batch], "text"):
                parts, end = [], 0
                for start, stop, kind in sorted((s, e, k) for k, s, e in finder(text or "")):
                    if start >= end:
                        parts += [text[end:start], f"[{KINDS[kind]}]"]
                    end = max(end, stop)
                out.append(None if text is None else "".join(parts) + text[end:])
            yield batch.set_column(at, "text", pa.array(out, batch.schema.field(at).type))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, cut, fields)


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def span_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, numbers of base findings by kind, ``base_sha256`` of
    the base findings' ``kind:start:end``, and ``spans``, all findings written that way."""
    base = "filter(spans, s -> s.kind in ('{}'))"
    return find_spans(docs).select(
        "doc_id",
        *(F.expr(f"cast(size({base.format(k)}) as long)").alias(f"n_{k}") for k in BASE),
        F.sha2(F.expr(_joined(base.format("', '".join(BASE)))), 256).alias("base_sha256"),
        F.expr(_joined("spans")).alias("spans"))
