"""Suffix-array dedup: repeated passages, by linear suffix sorting through grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, lookup, small_batches, unique_docs, written
from .tokens import Words, mix, signed, slices, spans_hash

LENGTH, GRAM = 50, 24
#: Words that are suffix-sorted at once, and of a group beyond which its windows are counted instead.
MOST = 1 << 17


def suffix_array(text: list[int]) -> list[int]:
    """Sorts the suffixes of a sequence of integers from 0 up, in linear time, by grouping.

    First phase: suffixes that start with the same letter are a group; groups are
    taken from the greatest down. A suffix's previous-smaller pointer goes to the
    nearest suffix before it in a lesser group. Suffixes to which k members of the
    present group point extend their common prefix k times by the group's, so
    each moves, greatest k first, into a new group just above its old one. At the
    end a group holds the suffixes with one Lyndon prefix. Second phase: from the
    least suffix on, each that is emitted puts the suffix before it, and those up
    its chain of pointers, at the front of their groups. Nothing is renamed and
    nothing recurses.
    """
    n = len(text)
    if n == 0:
        return []
    order = np.argsort(np.asarray(text, np.int64), kind="stable")
    letters = np.asarray(text, np.int64)[order]
    begin = np.concatenate([[True], letters[1:] != letters[:-1]])
    starts = np.flatnonzero(begin)
    sizes = np.diff(np.append(starts, n))
    first = np.empty(n, np.int64)
    first[order] = np.repeat(starts, sizes)
    sa, group = order.tolist(), first.tolist()  # members by group; a group's number is its place
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    size = [0] * n
    for s, z in zip(starts.tolist(), sizes.tolist()):
        size[s] = z
    prev = [-1] * n
    end = n
    while end > 0:
        g = group[sa[end - 1]]
        members = sa[g:end]
        if len(members) > 1:
            members.sort()
        points: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                points[p] = points.get(p, 0) + 1
        if points:
            most = max(points.values())
            if most == 1:
                rounds = [list(points)]
            else:
                by: dict[int, list[int]] = {}
                for p, k in points.items():
                    by.setdefault(k, []).append(p)
                rounds = [by[k] for k in sorted(by, reverse=True)]
            for moving in rounds:
                moved: dict[int, int] = {}
                for p in moving:
                    h = group[p]
                    m = moved.get(h, 0) + 1
                    moved[h] = m
                    # to the back of its group, just before those that moved already
                    to, at = h + size[h] - m, place[p]
                    other = sa[to]
                    sa[to], sa[at], place[p], place[other] = p, other, to, at
                for h, m in moved.items():
                    rest = size[h] - m
                    if rest:
                        size[h] = rest
                        new = h + rest
                        size[new] = m
                        for x in sa[new : new + m]:
                            group[x] = new
        end = g
    out = [-1] * n
    front = list(range(n))  # next free place of each group
    done = [False] * n
    # the empty suffix is the least: it puts the last suffix and its chain in place
    i = -1
    j = n - 1
    while True:
        while j >= 0 and not done[j]:
            done[j] = True
            at = front[group[j]]
            out[at] = j
            front[group[j]] = at + 1
            j = prev[j]
        i += 1
        if i == n:
            return out
        j = out[i] - 1


def common_prefixes(text: list[int], sa: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order with the one before it."""
    n = len(text)
    rank, out = [0] * n, [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    h = 0
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return out


def _stretches(length: int, gram: int):
    """Cuts every text into stretches: runs of positions whose windows of `length` words have the same
    least gram at the same place. Equal windows lie in stretches of the same least gram."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                key, at, size, least = cut(words, length, gram)
                content = spans_hash(words.hash, at, at + size + length - 1, 0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(least)), pa.array(signed(content + size.astype(np.uint64))), part["key"].take(pa.array(key)), pa.array((at - words.first[key]).astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["least", "content", "key", "at", "size"],
                )

    return stretches


def cut(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, number of positions and hash of the least gram of every stretch."""
    at, value = words.grams(gram)
    width = length - gram + 1
    if len(at) < width:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    # at is dense within a row, so a window of grams is one of the row when its ends are
    doc = words.doc[at]
    ok = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
    least = ok + sliding_window_view(value, width)[ok].argmin(axis=1)
    begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(ok) != 1)])) if len(ok) else ok
    return doc[ok[begin]], at[ok[begin]], np.diff(np.append(begin, len(ok))), value[least[begin]]


_FETCHED = "least long, content long, alone boolean, key long, at int, words array<long>, window long"


def _fetch(length: int):
    """The words of each stretch that is wanted; of those of crowded groups, one row for each window of `length` words with its hash."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                out: list[tuple] = []
                for r, wanted in enumerate(part["wanted"].to_pylist()):
                    key = part["key"][r].as_py()
                    for w in wanted:
                        a = words.first[r] + w["at"]
                        if w["crowded"]:
                            places = np.arange(a, a + w["size"])
                            windows = signed(mix(spans_hash(words.hash, places, places + length, 0xD6E8FEB86659FD93)))
                            out += [(w["least"], w["content"], w["alone"], key, w["at"] + i, None, h) for i, h in enumerate(windows.tolist())]
                        else:
                            out.append((w["least"], w["content"], w["alone"], key, w["at"], signed(words.hash[a : a + w["size"] + length - 1]), None))
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _FETCHED.split(", ")])

    return fetch


def repeated(texts: list[np.ndarray], length: int) -> list[list[tuple[int, int]]]:
    """Of each sequence, the runs of positions at which `length` words start that start elsewhere too."""
    joined = np.concatenate([np.unique(np.concatenate(texts), return_inverse=True)[1] + len(texts)] if texts else [np.zeros(0, np.int64)])
    # after each sequence a letter of its own, less than all words
    ends = np.cumsum([len(x) for x in texts])
    text = np.insert(joined, ends, np.arange(len(texts)))
    sa = suffix_array(text.tolist())
    lcp = np.asarray(common_prefixes(text.tolist(), sa))
    both = lcp >= length
    hit = both.copy()
    hit[:-1] |= both[1:]
    mark = np.zeros(len(text), bool)
    mark[np.asarray(sa)[hit]] = True
    out, a = [], 0
    for x in texts:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mark[a : a + len(x)].astype(np.int8), [0]])))
        out.append(list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())))
        a += len(x) + 1
    return out


def _sort(length: int, most: int):
    """Suffix-sorts runs of whole groups of stretches with one least gram, about `most` words at a time:
    key, lo, hi of the repeated windows of stretches that stand alone."""

    def flush(held: list[tuple[int, bool, int, int, np.ndarray]]) -> pa.RecordBatch:
        rows = [(key, at + a, at + b) for (_, alone, key, at, _), runs in zip(held, repeated([x for *_, x in held], length)) if alone for a, b in runs]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["key", "lo", "hi"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int, int, np.ndarray]] = []
        total = 0
        for batch in batches:
            offsets, flat = batch["words"].offsets.to_numpy(), batch["words"].values.to_numpy()
            for i, (least, *row) in enumerate(zip(*(batch[c].to_pylist() for c in ("least", "alone", "key", "at")))):
                if total >= most and least != held[-1][0]:
                    yield flush(held)
                    held, total = [], 0
                x = flat[offsets[i] : offsets[i + 1]]
                held.append((least, *row, x))
                total += len(x)
        if held:
            yield flush(held)

    return sort


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, start_word, end_word: every maximal stretch of a text covered by passages of `length`
    words that stand at two places or more of the corpus.

    The suffixes of the corpus are shared out by the least gram of their first
    `length` words, so that two that agree in so many meet in one group, and
    a stretch of neighbours travels as one row of 40 bytes without its words.
    Stretches whose least gram stands once in the corpus are done. Equal
    stretches are repeated as a whole, be they two or a million. Where one least
    gram has different stretches, at the edges of passages, one of each kind is
    fetched and suffix-sorted, and common prefixes of neighbours tell which of
    its positions are repeated. A group of over `most` words (a header before
    a million different texts) isn't sorted in one task: its windows of `length`
    words, at most length - gram + 1 a stretch, are counted by hash instead. The
    result is the same, and exact up to 64-bit hashes.

    - Words are compared without case and punctuation; positions count words from 0, the end excluded.
    - Null and empty texts, and those below `length` words, give no rows. Very long ones are searched whole.
    - Rows that repeat an id with the same text are one document, and no repeat. Ids must be integers or cast
      to them; documents are told apart by a 64-bit hash of id and text.
    - A passage that repeats within one text counts. A null id is kept.
    - Extra columns are dropped first. An empty table gives no rows.
    """
    docs = unique_docs(docs, id_col, text_col)
    cut_up = docs.select("key", "text").mapInArrow(_stretches(length, gram), "least long, content long, key long, at int, size int")
    with small_batches(docs.sparkSession):
        twice = written(cut_up.groupBy("least").agg(F.count("*").alias("n")).where("n > 1"), "twice")
        marked = written(cut_up.join(twice, "least"), "stretches")
    drop_written(twice)
    kinds = written(marked.groupBy("least", "content", "n").agg(F.count("*").alias("of"), F.min(F.struct("key", "at", "size")).alias("one")), "kinds")
    mixed = kinds.where("of < n")
    crowded = mixed.groupBy("least").agg((F.sum(F.col("one.size") + length - 1) > most).alias("crowded"))
    w = F.struct("least", "content", (F.col("of") == 1).alias("alone"), "crowded", "one.at", "one.size")
    wanted = written(mixed.join(crowded, "least").select("one.key", w.alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = docs.join(lookup(wanted), "key").select("key", "text", "wanted")
    with small_batches(docs.sparkSession):
        fetched = written(texts.mapInArrow(_fetch(length), _FETCHED), "fetched")
    drop_written(wanted)
    groups = fetched.where("window is null").select("least", "alone", "key", "at", "words")
    runs = groups.repartition("least").sortWithinPartitions("least").mapInArrow(_sort(length, most), "key long, lo int, hi int")
    windows = fetched.where("window is not null")
    again = windows.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window")
    single = windows.where("alone").join(again, "window").select("key", F.col("at").alias("lo"), F.col("at").alias("hi"))
    whole = marked.join(kinds.where("of > 1").select("least", "content"), ["least", "content"]).select("key", F.col("at").alias("lo"), (F.col("at") + F.col("size") - 1).alias("hi"))
    order = Window.partitionBy("key").orderBy("lo", "hi")
    covered = whole.unionByName(runs).unionByName(single).withColumn("before", F.max(F.col("hi") + length).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    islands = covered.withColumn("island", F.sum(F.when(F.col("before") >= F.col("lo"), 0).otherwise(1)).over(order))
    spans = islands.groupBy("key", "island").agg(F.min("lo").alias("start_word"), (F.max("hi") + length).alias("end_word"))
    return spans.join(docs.select("key", "doc_id"), "key").select("doc_id", "key", "start_word", "end_word")
