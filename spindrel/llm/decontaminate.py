"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, narrow, without, written
from .tokens import Words, signed, slices

N = 4
RARE_SHARE, RARE_DF = 0.5, 0.001
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BROADCAST_GRAMS = 2_000_000


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two sequences of word hashes, and start and end of its part of b.

    One row per word of a. Gaps along a row are a running maximum, so each row is
    a few vector operations. Starts travel with the scores.
    """
    n = len(b)
    steps = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for word in a:
        diagonal = row[:-1] + np.where(b == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        take = diagonal >= up
        value = np.concatenate([[0], np.where(take, diagonal, up)])
        origin = np.concatenate([[0], np.where(take, start[:-1], start[1:])])
        low = value <= 0
        value[low], origin[low] = 0, steps[low]
        # best cell to the left, less the gaps up to here; packed with its column, the nearest wins ties
        packed = np.maximum.accumulate((value - GAP * steps) * (n + 1) + steps)
        column = packed % (n + 1)
        row, start = value[column] + GAP * (steps - column), origin[column]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = int(row[top]), int(start[top]), top
    return best


def _hits(grams: np.ndarray | None, n: int):
    """Of each text: the benchmark's n-grams in it and, about them, the hashes of its words."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                at, gram = words.grams(n)
                if grams is not None:
                    i = np.searchsorted(grams, gram)
                    i[i == len(grams)] = 0
                    found = grams[i] == gram if len(grams) else np.zeros(len(gram), bool)
                    at, gram = at[found], gram[found]
                doc = words.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [part["key"].take(pa.array(doc)), part["doc_id"].take(pa.array(doc)), pa.array(signed(gram)), pa.array((at - words.first[doc]).astype(np.int32))],
                    names=["key", "doc_id", "gram", "at"],
                )

    return hits


def _cut(words: Words, part: pa.RecordBatch, row: np.ndarray, item: np.ndarray, at: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
    """Of each row and item with seeds at words `at`: the word hashes within the item's reach of any seed, run by run."""
    order = np.lexsort((at, item, row))
    row, item, at, reach = row[order], item[order], at[order], reach[order]
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(at) > reach[1:])])) if len(at) else at
    last = at[np.append(begin[1:], len(at)) - 1] if len(at) else at
    row, item, reach = row[begin], item[begin], reach[begin]
    base = words.first[row]
    lo, hi = np.maximum(at[begin] - reach, 0), np.minimum(last + reach, words.first[row + 1] - base)
    spans = [signed(words.hash[x:y]) for x, y in zip((base + lo).tolist(), (base + hi).tolist())]
    return pa.RecordBatch.from_arrays(
        [part["key"].take(pa.array(row)), part["doc_id"].take(pa.array(row)), pa.array(item, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(spans, pa.list_(pa.int64()))],
        names=["key", "doc_id", "item", "lo", "words"],
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_cut() of each text by the seed positions that come with it."""
    for batch in batches:
        for part in slices(batch, "text"):
            seeds = [(r, s["item"], s["at"], s["reach"]) for r, all_ in enumerate(part["seeds"].to_pylist()) for s in all_]
            yield _cut(Words(part["text"]), part, *np.array(seeds, np.int64).reshape(-1, 4).T)


def _seeded(grams: np.ndarray, items: np.ndarray, reach: np.ndarray, n: int):
    """_cut() of each text by the seeds found in it; grams ascend, and items[i], of reach[i], is an item that grams[i] is a seed of."""

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                at, gram = words.grams(n)
                first, end = np.searchsorted(grams, gram), np.searchsorted(grams, gram, side="right")
                hit = np.flatnonzero(end > first)
                much = (end - first)[hit]
                entry = np.repeat(first[hit] - np.cumsum(much) + much, much) + np.arange(much.sum())
                at = np.repeat(at[hit], much)
                row = words.doc[at]
                yield _cut(words, part, row, items[entry], at - words.first[row], reach[entry])

    return seeded


def _align(min_score: float):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc_id, item, item_id, lo, a, b in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "item", "item_id", "lo", "item_words", "words"))):
                score, start, end = local_alignment(np.array(a), np.array(b))
                if score >= min_score * MATCH * len(a):
                    rows.append((key, doc_id, item, item_id, score / (MATCH * len(a)), lo + start, lo + end))
            kinds = (("key", pa.int64()), ("doc_id", pa.int64()), ("item", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])

    return align


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(batch["text"])
        offsets = pa.array(words.first.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch["key"], batch["doc_id"], pa.ListArray.from_arrays(offsets, pa.array(signed(words.hash)))], names=["item", "item_id", "item_words"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = N, rare_share: float = RARE_SHARE, rare_df: float = RARE_DF, min_score: float = MIN_SCORE,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """key, doc_id, item_id, score, start_word, end_word: the best alignment of each document with each test item that it leaks.

    Seeds of an item are its word n-grams that are rare in the corpus: those in
    at most rare_df of all documents and, whatever their frequency, the rarest
    rare_share of the item's own. So an item that was leaked a million times
    keeps seeds, and phrases of the language join nothing. Every document that
    shares a seed is aligned with the item (Smith-Waterman over words, within an
    item's length of the seeds); a pair counts when the score is at least
    min_score of a perfect copy's.

    The n-grams of the benchmark are searched as one sorted array in every task
    while there are at most broadcast_grams (8 bytes each, and 16 for a seed with
    its item): the corpus is read once to count them and once to cut windows
    about the seeds, and no text is shuffled. Beyond that, all n-grams of the
    corpus join them by shuffle. Results are the same.

    - Nulls, empty texts and those below n words, on either side, match nothing.
    - Rows that repeat an id with the same text are one document, or one item. Ids must be integers or cast
      to them; documents are told apart by a 64-bit hash of id and text.
    - Very long texts are searched whole. Extra columns are dropped first.
    - Of equal scores, the first place in the document wins.
    - Null ids are kept as such. Empty tables give no rows.
    """
    docs = narrow(docs, id_col, text_col)
    items = narrow(benchmark, item_id_col, item_text_col).dropDuplicates(["key"])
    gram_type = "key long, doc_id long, gram long, at int"
    of_items = written(items.mapInArrow(_hits(None, n), gram_type).select(F.col("key").alias("item"), "gram").distinct(), "item-grams")
    size = of_items.count()
    if size <= broadcast_grams:
        grams = np.sort(of_items.select("gram").distinct().toArrow()["gram"].to_numpy().view(np.uint64))
        found = docs.mapInArrow(_hits(grams, n), gram_type)
    else:
        found = written(docs.mapInArrow(_hits(None, n), gram_type).join(of_items.select("gram").distinct(), "gram", "left_semi").select("key", "doc_id", "gram", "at").distinct(), "hits")
    df = found.select("gram", "key").distinct().groupBy("gram").agg(F.count("*").alias("df"))
    total = docs.count()
    seen = of_items.join(df, "gram")
    rank = F.percent_rank().over(Window.partitionBy("item").orderBy("df"))
    lists = written(items.mapInArrow(_item_words, "item long, item_id long, item_words array<long>"), "items")
    seeds = seen.withColumn("rank", rank).where((F.col("df") <= rare_df * total) | (F.col("rank") <= rare_share)).select("item", "gram")
    seeds = seeds.join(lists.select("item", F.size("item_words").alias("reach")), "item")
    window_type = "key long, doc_id long, item long, lo int, words array<long>"
    if size <= broadcast_grams:
        chosen = seeds.toArrow()
        gram, item, reach = chosen["gram"].to_numpy().view(np.uint64), chosen["item"].to_numpy(), chosen["reach"].to_numpy().astype(np.int64)
        order = np.lexsort((item, gram))
        pairs = docs.mapInArrow(_seeded(gram[order], item[order], reach[order], n), window_type).distinct()
    else:
        per_doc = written(found.join(seeds, "gram").groupBy("key").agg(F.collect_set(F.struct("item", "at", "reach")).alias("seeds")), "seeds")
        texts = docs.join(lookup(per_doc), "key").select("key", "doc_id", "text", "seeds")
        pairs = texts.mapInArrow(_windows, window_type).distinct()
    scored = pairs.join(lists, "item").mapInArrow(_align(min_score), "key long, doc_id long, item long, item_id long, score double, start_word int, end_word int")
    best = scored.groupBy("key", "item").agg(F.max_by(F.struct("doc_id", "item_id", "score", "start_word", "end_word"), F.struct("score", -F.col("start_word"))).alias("b"))
    return best.select("key", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs, whole, that leak no test item. Nulls, empty texts, ties and repeated rows as
    in contaminated(); with an empty benchmark everything stays."""
    leaks = written(contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **params).select("key").distinct(), "leaks")
    return without(docs, leaks, id_col, text_col)
