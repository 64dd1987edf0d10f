"""PII by anchor expansion."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CUES = {
    "secret": ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key"),
    "account": ("iban", "account", "acct", "ssn", "passport"),
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+\-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[^\W_]|-(?=[^\W_]|-)){0,62}\.)+[^\W\d_]{2,24}(?![^\W_])")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_HOST_END = re.compile(r"[/?#]")
_HOST = re.compile(r"(?:[\w\-]+(?:\.[\w\-]+)*|\[[0-9A-Fa-f:.]+\])(?::\d{1,5})?\Z")
_OCTETS = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_RUN = re.compile(r"\d(?:[ .\-/()+]{0,3}\d)*")
_PHONE = re.compile(r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)")
_CARD = re.compile(r"\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\w])|\d{4}[ \-]?\d{6}[ \-]?\d{5}(?![\w])")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}(?![\w\-])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AWS = re.compile(r"A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"[\"']?\s{0,3}([=:])\s{0,3}(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|([^\s\"',;]{6,}))")
_ACCOUNT_NO = re.compile(r"(?: (?:no|nr|number)\.?)?\s{0,2}[:#=]?\s{0,2}((?=[A-Z0-9\-]{0,30}\d{4})[A-Z0-9][A-Z0-9\-]{5,33})(?![A-Za-z0-9])", re.I)


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    """Anchors, in lower case, and what each starts. Digits anchor by pairs, with a dot between (addresses) or none (numbers)."""
    machine = ahocorasick.Automaton()
    machine.add_word("@", ("@", 1))
    machine.add_word("://", ("://", 3))
    machine.add_word("www.", ("www", 4))
    for cloud in ("akia", "asia"):
        machine.add_word(cloud, ("aws", 4))
    for a in "0123456789":
        for b in "0123456789":
            machine.add_word(f"{a}.{b}", ("dot", 3))
            machine.add_word(a + b, ("digits", 2))
    for kind, cues in _CUES.items():
        for cue in cues:
            machine.add_word(cue, (kind, len(cue)))
    machine.make_automaton()
    return machine


def luhn(number: str) -> bool:
    total = 0
    for i, d in enumerate(reversed([int(x) for x in number if x.isdigit()])):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _alnum(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def _email(text: str, at: int) -> tuple[int, int] | None:
    local = _LOCAL.search(text[max(0, at - 65) : at])
    domain = _DOMAIN.match(text, at + 1)
    if not local or not domain:
        return None
    name = local[0]
    if at - len(name) > 0 and len(name) == 64 and _LOCAL.match(text[at - 65]):
        return None
    start = at - len(name.lstrip("._%+-"))
    if start == at or text[at - 1] == "." or ".." in text[start:at]:
        return None
    return start, domain.end()


class _Urls:
    """Reads addresses of the web from left to right; what was found ahead is kept, so that no stretch is read once an anchor."""

    def __init__(self, text: str):
        self.text, self.end, self.host_end, self.sign = text, 0, -1, -1

    def at(self, start: int, rest: int) -> tuple[int, int] | None:
        text = self.text
        if rest >= self.end:
            match = _URL_REST.match(text, rest)
            if not match:
                return None
            self.end = match.end()
        end = self.end
        while end > rest and text[end - 1] in ".,;:!?*":
            end -= 1
        if end > rest and text[end - 1] in ")]":
            more = {c: text.count(c, rest, end) for c in "()[]"}
            while end > rest and (text[end - 1] in ".,;:!?*" or any(text[end - 1] == c and more[o] < more[c] for o, c in ("()", "[]"))):
                end -= 1
                if text[end] in more:
                    more[text[end]] -= 1
        if self.host_end < rest:
            match = _HOST_END.search(text, rest, self.end)
            self.host_end = match.start() if match else self.end
        if self.sign < rest:
            self.sign = text.find("@", rest, self.end) % (len(text) + 1)  # none: len(text)
        host_end = min(self.host_end, end)
        begin = self.sign + 1 if self.sign < host_end else rest
        host = _HOST.match(text, begin, host_end)
        return (start, end) if host and ("." in host[0] or "localhost" in host[0]) else None


def _run(text: str, at: int, done: int) -> tuple[int, int]:
    """The run of digits, with marks between, about a pair of digits; it starts at `done` at the earliest."""
    start = at
    while start > done and (text[start - 1].isascii() and text[start - 1].isdigit() or (text[start - 1] in " .-/()+" and _joins(text, start - 1))):
        start -= 1
    return start, _RUN.match(text, at).end()


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """The numbers in a run, left to right, at each place the first kind that fits: address, card, social security number, phone."""
    begin = start
    while begin < end:
        if not (begin and (_alnum(text, begin - 1) or text[begin - 1] == "." and begin > 1 and text[begin - 2].isdigit())):
            for kind, pattern, valid in _KINDS:
                match = pattern.match(text, begin)
                if match and valid(match[0]):
                    yield kind, begin, match.end()
                    begin = match.end() - 1
                    break
        begin += 1


def _joins(text: str, i: int) -> bool:
    """Whether the mark at i stands between digits, or opens a number."""
    if text[i] in "+(":
        return True
    j = i
    while j >= 0 and text[j] in " .-/()+" and i - j < 3:
        j -= 1
    return j >= 0 and text[j].isascii() and text[j].isdigit()


_KINDS = (
    ("ip", _OCTETS, lambda x: all(int(o) < 256 for o in x.split("."))),
    ("card", _CARD, lambda x: 13 <= sum(c.isdigit() for c in x) <= 19 and luhn(x) and x[0] in "23456"),
    ("ssn", _SSN, lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"),
    ("phone", _PHONE, lambda x: 9 <= sum(c.isdigit() for c in x) <= 15),
)


def _lower(text: str) -> str:
    """Lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """kind, start, end of every finding, in code points, left to right and apart from each other."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    urls = _Urls(text)
    run_end = url_end = value_end = 0
    for last, (kind, size) in _automaton().iter(_lower(text)):
        at = last + 1 - size
        if kind in ("dot", "digits"):
            if at < run_end:
                continue
            start, end = _run(text, at, run_end)
            run_end = end
            if kind == "digits" and at >= 2 and (iban := _iban_at(text, at)):
                found.append((*iban, "account"))
                run_end = start = max(end, iban[1])
            for number, a, b in _numbers(text, start, end):
                found.append((a, b, number))
                run_end = max(run_end, b)
        elif kind == "@":
            if span := _email(text, at):
                found.append((*span, "email"))
        elif kind == "://":
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (span := urls.at(start, last + 1)):
                found.append((*span, "url"))
                url_end = span[1]
        elif kind == "www":
            if at >= url_end and not _alnum(text, at - 1) and text[max(0, at - 1) : at] not in ("/", ".") and (span := urls.at(at, at)):
                found.append((*span, "url"))
                url_end = span[1]
        elif kind == "aws":
            match = _AWS.match(text, at)
            if match and not _alnum(text, at - 1):
                found.append((at, match.end(), "secret"))
        elif kind == "secret":
            match = at >= value_end and _ASSIGNED.match(text, last + 1)
            if match and not (at and text[at - 1].isalnum()):
                group = next(g for g in (2, 3, 4) if match[g])
                value_end = match.end(group)
                if group < 4 or match[1] == "=" or any(c.isdigit() for c in match[group]):
                    found.append((match.start(group), match.end(group), "secret"))
        else:
            match = _ACCOUNT_NO.match(text, last + 1)
            if match and not _alnum(text, at - 1):
                found.append((match.start(1), match.end(1), "account"))
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[tuple[str, int, int]] = []
    for start, end, kind in found:
        if not out or start >= out[-1][2]:
            out.append((kind, start, end))
    return out


def _iban_at(text: str, at: int) -> tuple[int, int] | None:
    match = _IBAN.match(text, at - 2)
    if match and not _alnum(text, at - 3) and _iban(match[0]):
        return at - 2, match.end()
    return None


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, kind, start, end, value = [], [], [], [], []
        for r, text in enumerate(batch["text"].to_pylist()):
            for k, a, b in find(text):
                row.append(r)
                kind.append(k)
                start.append(a)
                end.append(b)
                value.append(text[a:b])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.string())], names=["doc_id", "kind", "start", "end", "value"]
        )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, start, end, value of everything personal in the texts.

    One Aho-Corasick pass over a text finds anchors: at-signs, schemes and www,
    pairs of digits with and without a dot, and words that announce a secret or
    an account. A parser of each kind expands its anchor to the left and right
    and validates what it finds: email (labels of the domain), url (host), ip
    (octets), card (Luhn), ssn, phone, account (IBAN checksum, or a number after
    a cue), secret (a value of six characters or more, assigned to a cue by an
    equals sign, in quotes, or with a digit; cloud keys). Cues count in any case.

    - Findings don't overlap: the one that starts first stays; of two that start
      together, the longer. Offsets are in code points.
    - Lengths are those of the formats: 64 characters before an at-sign, 63 a label, 34 an account. Web addresses and secrets have none.
    - Null and empty texts give no rows; texts are searched whole, in time in proportion to their length.
    - Ids must be integers or cast to them.
    - Repeated rows give repeated findings; a null id is kept.
    - Extra columns are dropped first. An empty table gives no rows.

    One pass without a shuffle.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_find, "doc_id long, kind string, start int, end int, value string")
