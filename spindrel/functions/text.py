"""Text columns: clean-up, sentences, windows, letter vectors, JSON repair."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = r"(?<=[.!?])(?<!(?:^|\s)[A-Z]\.)\s+"
SPACE_BREAK = r" (?<=[.!?] )(?<!(?:^| )[A-Z]\. )"


def preprocess(text: Column) -> Column:
    """Line ends become spaces, words cut by a dash and a space are joined, white space is collapsed; no trim."""
    text = F.regexp_replace(text, r"\r?\n+", " ")
    text = F.regexp_replace(text, r"(?i)([a-z])([–-])\s+([a-z])", "$1$2$3")
    return F.regexp_replace(text, r"(?U)\s+", " ")


def sentences(text: Column, single_spaces: bool = False) -> Column:
    """Trimmed sentences that aren't empty. A single capital with a point is an abbreviation, not an end.
    single_spaces: the text comes from preprocess(), so only single spaces are looked at."""
    parts = F.transform(F.split(text, SPACE_BREAK if single_spaces else SENTENCE_BREAK), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def guard_few(segments: Column, buffer: int) -> Column:
    """Too few segments for a window become one, joined by line ends."""
    return F.when(F.size(segments) <= buffer, F.array(F.array_join(segments, "\n"))).otherwise(segments)


def windows(segments: Column, width: int) -> Column:
    """Sliding windows of `width` segments, joined by spaces; none when there are fewer."""
    spans = F.transform(F.sequence(F.lit(0), F.size(segments) - width), lambda i: F.array_join(F.slice(segments, i + 1, width), " "))
    return F.when(F.size(segments) >= width, spans).otherwise(F.array().cast("array<string>"))


def letter_counts(text: Column) -> Column:
    """A vector of 26 counts: the built-in stand-in for a model's embedding."""
    low = F.lower(text)
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in string.ascii_lowercase])


def lower_rank(values: Column, percent: float) -> Column:
    """The element at floor(percent / 100 * (n - 1)) in ascending order: never interpolated. Null when empty."""
    return F.get(F.array_sort(values), F.floor(F.lit(percent / 100) * (F.size(values) - 1)).cast("int"))


#: Characters whose upper case is several; what each becomes as one; and what stands for it meanwhile (private use).
_WIDE = [c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff" and len(c.upper()) > 1]
_WIDE_UPPER = "".join("\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _WIDE)
_WIDE_HELD = "".join(chr(0xF0000 + i) for i in range(len(_WIDE)))


def upper_by_char(text: Column) -> Column:
    """Upper case, one character for one: ß becomes ẞ, not SS, and what has no single upper case stays."""
    wide = "".join(_WIDE)
    held = F.translate(F.upper(F.translate(text, wide, _WIDE_HELD)), _WIDE_HELD, _WIDE_UPPER)
    return F.when(text.rlike(f"[{wide}]"), held).otherwise(F.upper(text))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def companion_path(path: Column, extension: str) -> Column:
    """<dir>/<stem>_qa.<extension>; the stem is 'unknown' where the path has none."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    folder = F.when(folder == "", F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("."))).otherwise(folder)
    return F.concat(folder, F.lit("/"), F.when(stem == "", "unknown").otherwise(stem), F.lit(f"_qa.{extension}"))


def has_extension(name: Column, extensions: list[str]) -> Column:
    """Lower-cased name ends with any of the given endings as they are; no endings let everything pass."""
    out = F.lit(not extensions)
    for e in extensions:
        out = out | F.lower(name).endswith(e)
    return out


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")


def sanitize_json(reply: Column, close_brace: str = "objects") -> Column:
    """JSON out of a model's reply: fences, trailing commas and line ends go; a missing last brace comes.

    close_brace "objects" appends only to what opens as an object; "always" also
    to arrays and scalars.
    """
    text = F.trim(reply)
    text = F.regexp_replace(text, r"^```(?:json)?", "")
    text = F.trim(F.regexp_replace(text, r"```\s*$", ""))
    text = F.regexp_replace(text, r",\s*([\]}])", "$1")
    text = F.trim(F.regexp_replace(text, r"[\r\n]+", " "))
    lacks = ~text.endswith("}")
    if close_brace == "objects":
        lacks = lacks & text.startswith("{")
    return F.when(lacks, F.concat(text, F.lit("}"))).otherwise(text)


def numbered(items: Column) -> Column:
    """'1. first' and so on, one per line."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def contains_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out
