"""Personal data by anchor expansion.

One Aho-Corasick pass over a text, with its digits made equal and A-Z lower-cased,
finds the anchors: at-signs, schemes, names of identifiers, and the pairs of
characters that every number of interest holds. From an anchor a local parser of
its kind finds the two boundaries and validates what lies between:

=========  =========================  ==============================================================
kind       anchor                     what the parser takes
=========  =========================  ==============================================================
email      ``@``                      ASCII local part and dotted labels on both sides
ip         digit, dot, digit          four numbers of 255 at most
card       digits side by side, or    13 to 19 digits with a right Luhn sum
           one blank or hyphen apart
phone      ``+`` and a digit          9 to 15 digits
mailbox    ``@``                      an address with letters beyond ASCII, where no email is found
address    ``scheme://``, ``mailto:`` an address that holds a user's name
account    a name like ``iban``       the identifier behind it: IBAN by its check digits, or 6 to 17
                                      digits that are not all equal
=========  =========================  ==============================================================

The first four kinds equal the leftmost matches, without overlaps, of the patterns
in ``PATTERNS``; matches that fail their validation are dropped. Parsers go on from
where the last span of their kind ended, so a text is read a fixed number of times,
whatever it holds. A mailbox never overlaps an email; otherwise spans of different
kinds may.

Documents are independent: nothing is shuffled. Defined cases: null, empty and
blank texts have no spans; rows are treated one by one, so repeated ids and rows,
and rows without an id, give a row each; an empty table gives an empty result;
``mask`` carries other columns along.
"""

from __future__ import annotations

import functools
import itertools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.store import small_batches

# The patterns that the first four kinds equal.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "mailbox", "address", "account"]
BASE = len(PATTERNS)

# Schemes of addresses, and names that announce an identifier.
SCHEMES = ["http://", "https://", "ftp://", "ssh://", "sftp://", "smb://", "mailto:", "xmpp:", "sip:", "sips:"]
CUES = [
    "iban", "account no", "account number", "account nr", "acct", "bank account", "kontonummer", "numéro de compte",
    "número de cuenta", "passport no", "passport number", "customer no", "customer number", "customer id",
    "national id", "tax id", "social security", "ssn",
]

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DIGITS = str.maketrans(dict.fromkeys("123456789", "0") | dict(zip(string.ascii_uppercase, string.ascii_lowercase)))
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CHAIN = re.compile(PATTERNS["card"])
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+")
_WIDE_DOMAIN = re.compile(r"@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_WIDE_LOCAL = re.compile(r"[\w.%+-]")
_USER = re.compile(r"[^\s/?#@:\"'<>\[\]]{1,64}(?::[^\s/?#@\"'<>]{0,256})?@")
_HOST = re.compile(r"[^\W_](?:[\w.-]*[^\W_])?(?::[0-9]{1,5})?")
_TAIL = re.compile(r"(?:[/?#][^\s\"'<>]*[^\s\"'<>.,;:!?)])?")
_GAP = re.compile(r"(?: ?(?:no|nr|number|id|is))?[ \t]?[.:#=]{0,2}[ \t]{0,4}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![ -]?[0-9]|[A-Za-z])")


def luhn(digits: str) -> bool:
    """Whether the last digit is right: every second one from the right counts double, by its digit sum."""
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def valid_iban(text: str) -> bool:
    """15 to 34 characters whose number, the first four moved to the end and letters from 10 on, is 1 modulo 97."""
    code = text.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _small(number: str) -> bool:
    part = number.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _before(text: str, at: int, lowest: int, characters: str) -> int:
    """The first place of the run of ``characters`` that ends at ``at``, not below ``lowest``."""
    while at > lowest:
        part = text[max(lowest, at - 64) : at]
        kept = len(part.rstrip(characters))
        at -= len(part) - kept
        if kept:
            break
    return at


class _Text:
    """The spans of one text, found anchor by anchor from left to right."""

    def __init__(self, text: str):
        self.text = text
        #: Where the last match of each kind ended; matches that fail their validation count.
        self.ends = [0] * len(KINDS)
        self.spans: list[list[tuple[int, int, int]]] = [[] for _ in KINDS]

    def _take(self, kind: int, start: int, end: int, valid: bool) -> None:
        self.ends[kind] = end
        if valid:
            self.spans[kind].append((kind, start, end))

    def at_sign(self, at: int) -> None:
        text = self.text
        domain = _DOMAIN.match(text, at)
        start = _before(text, at, self.ends[0], _LOCAL) if domain else at
        if start < at:
            if start < self.ends[4]:
                self.spans[4].pop()
            self._take(0, start, domain.end(), True)
            return
        wide = _WIDE_DOMAIN.match(text, at)
        if wide is None:
            return
        start, lowest = at, max(self.ends[4], self.ends[0], at - 64)
        while start > lowest and _WIDE_LOCAL.match(text, start - 1):
            start -= 1
        name = text[start:at]
        start += len(name) - len(name.lstrip(".%+-"))
        if start < at and not text[start : wide.end()].isascii():
            self._take(4, start, wide.end(), True)

    def dotted(self, start: int) -> None:
        """Numbers joined by dots: each four are a match."""
        if start < self.ends[1]:
            return
        first = _before(self.text, start + 1, self.ends[1], string.digits)
        match = _DOTTED.match(self.text, first)
        parts = match.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            group = parts[i : i + 4]
            end = first + sum(map(len, group)) + 3
            self._take(1, first, end, all(map(_small, group)))
            first = end + 1
        # What is left holds fewer than four numbers.
        self.ends[1] = match.end()

    def digits(self, start: int) -> None:
        """Digits side by side: the first pair of a chain is where it begins."""
        if start < self.ends[2]:
            return
        match = _CHAIN.match(self.text, start)
        number = match.group().replace(" ", "").replace("-", "")
        self._take(2, start, match.end(), 13 <= len(number) <= 19 and luhn(number))

    def plus(self, start: int) -> None:
        match = _DIALLED.match(self.text, start)
        if match is None:
            return
        taken = match.group().rstrip(" ().-")
        self._take(3, start, start + len(taken), 9 <= sum(c.isdigit() for c in taken) <= 15)

    def scheme(self, start: int, end: int) -> None:
        """``scheme://user:password@host/path``, or ``mailto:user@host``."""
        text = self.text
        if start < self.ends[5] or start and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
            return
        user = _USER.match(text, end)
        host = user and _HOST.match(text, user.end())
        if host:
            self._take(5, start, _TAIL.match(text, host.end()).end(), True)

    def cue(self, start: int, end: int) -> None:
        """The identifier behind its name."""
        text = self.text
        if end < self.ends[6] or start and text[start - 1].isalnum():
            return
        at = _GAP.match(text, end).end()
        if at == end:
            return
        match = _IBAN.match(text, at)
        if match:
            found = match.group()
            # Words behind the code can look like a part of it: the longest valid one counts.
            for stop in [len(found), *(m.start() for m in reversed(list(re.finditer(" ", found))))]:
                if valid_iban(found[:stop]):
                    self._take(6, at, at + stop, True)
                    return
        match = _ACCOUNT.match(text, at)
        if match and len(set(match.group()) - set(" -")) > 1:
            self._take(6, at, match.end(), True)


@functools.cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for pair in ("00", "0 0", "0-0"):
        found.add_word(pair, (len(pair) - 1, "digits"))
    found.add_word("@", (0, "at_sign"))
    found.add_word("0.0", (2, "dotted"))
    found.add_word("+0", (1, "plus"))
    for words, parser in ((SCHEMES, "scheme"), (CUES, "cue")):
        for word in words:
            found.add_word(word, (len(word) - 1, parser))
    found.make_automaton()
    return found


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans of a text in code points, by kind, then start."""
    if not text:
        return []
    state = None
    for last, (back, parser) in _automaton().iter(text.translate(_DIGITS)):
        state = state or _Text(text)
        if parser in ("scheme", "cue"):
            getattr(state, parser)(last - back, last + 1)
        else:
            getattr(state, parser)(last - back)
    return list(itertools.chain.from_iterable(state.spans)) if state else []


def _found(batches):
    for batch in batches:
        spans = [find_spans(t.as_py()) for t in batch.column(1)]
        flat = np.array([s for found in spans for s in found], np.int64).reshape(-1, 3)
        kinds = pa.array(np.array(KINDS, object)[flat[:, 0]], pa.string())
        struct = pa.StructArray.from_arrays([kinds, pa.array(flat[:, 1]), pa.array(flat[:, 2])], ["kind", "start", "end"])
        ends = np.cumsum([0, *map(len, spans)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, struct)], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and spans (kind, start, end), in code points, by kind, then start."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_found, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def masked_text(text: str | None) -> str | None:
    """The text with ``[KIND]`` for each span; of spans that overlap, the first and longest gives its kind for all."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced; all rows and columns stay."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = pa.array([masked_text(t.as_py()) for t in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    source = docs.withColumn(text, F.col(text).cast("string"))
    return source.mapInArrow(run, source.schema)


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
