"""Substring dedup by collinear chaining of shared k-mer seeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, lookup, unique_docs, written
from .tokens import Words, mix, signed, slices

KMER = 7
LENGTH, IDENTITY = 50, 0.8
GAP_COST = 0.2
#: Documents of a seed that share a lead, and words of context on either side that a place carries as a mask.
GROUP, CONTEXT = 256, 20
#: Documents of a seed in a bucket, all of whose places meet before those that are still uncovered meet all.
FEW = 16
#: Places of a seed that one task compares with as many others, and words by which the two sides of a passage may be out of step.
BLOCK, DRIFT = 8192, 5
#: Seeds that stand in two documents go to the tasks as a bitmap of 8 bits each while they are at most so many (128 MB).
BITMAP_SEEDS = 1 << 27
#: Kinds of places in a run of one word, see _seeds.
INSIDE, DEEP = -1, -2
_LEVEL = 4
_DIRECT = 1 << 26


# Seeds


def _stretch(words: Words, at: np.ndarray, kmer: int) -> tuple[np.ndarray, np.ndarray]:
    """Of k-mers of one word over and over: how many more of it stand before and after; -1 of others."""
    new = np.ones(len(words.hash), bool)
    new[1:] = (words.hash[1:] != words.hash[:-1]) | (words.doc[1:] != words.doc[:-1])
    begin = np.append(np.flatnonzero(new), len(new))
    run = (np.cumsum(new) - 1)[at]
    before, after = at - begin[run], begin[run + 1] - at - kmer
    return np.where(after >= 0, before, -1), np.where(after >= 0, after, -1)


def _seeds(words: Words, kmer: int, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and kind of the k-mers whose least word (by hash) stands first or last, in texts of at
    least `length` words. The choice depends on the k-mer alone, so copies choose alike whatever stands about it.

    Of a run of one word its first k-mer counts and, with another hash, its last one: where such a run stands in two
    documents, a passage that goes on before it has the first in common, one that goes on after it the last. Within a run of
    `length` words or more every `step`-th counts too. Kind: the words of such a run at its first k-mer; INSIDE or, at
    places with more of the word on either side than an alignment sees, DEEP within it; else 0."""
    at, value = words.grams(kmer)
    if len(at):
        at_least = np.diff(words.first)[words.doc[at]] >= length
        at, value = at[at_least], value[at_least]
    if not len(at):
        return at, value, np.zeros(0, np.int32)
    least = sliding_window_view(mix(words.hash, 3), kmer)[at].argmin(axis=1)
    ends = (least == 0) | (least == kmer - 1)
    at, value = at[ends], value[ends]
    before, after = _stretch(words, at, kmer)
    many = before + after + kmer >= length
    kind = np.where(before > 0, np.where((before > length + step) & (after > length), DEEP, INSIDE), before + after + kmer) * many
    one = (before <= 0) | many & (before % step == 0) & (after > 0)
    last = after == 0
    kind = np.where(before < 0, 0, kind)
    return np.concatenate([at[one], at[last]]), np.concatenate([value[one], mix(value[last], 5)]), np.concatenate([kind[one], np.zeros(last.sum(), kind.dtype)]).astype(np.int32)


def _counted(kmer: int, length: int, step: int):
    """Each text's distinct seeds, and whether they are a run of `length` words or more in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                at, value, kind = _seeds(words, kmer, length, step)
                order = np.argsort(kind <= 0, kind="stable")
                at, value, kind = at[order], value[order], kind[order]
                once = np.unique(mix(value + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(signed(value[once])), pa.array(kind[once] > 0)], names=["seed", "run"])

    return run


def contexts(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every word a mask of 64 bits of the `size` words before it, and of those from it on; 0 where there are fewer."""
    n, docs = len(words.hash), int(words.doc[-1]) + 1 if len(words.hash) else 0
    at = np.arange(n) + size * (words.doc + 1)
    bits = np.zeros(n + size * (docs + 2), np.uint64)
    bits[at] = np.uint64(1) << (words.hash >> np.uint64(58))
    run, width = bits.copy(), 1  # run[i]: the words i..i+width-1
    while width < size:
        step = min(width, size - width)
        run[: len(run) - step] |= run[step:]
        width += step
    place = np.arange(n) - words.first[words.doc]
    left = np.where(place >= size, run[at - size], np.uint64(0))
    right = np.where(words.first[words.doc + 1] - np.arange(n) >= size, run[at], np.uint64(0))
    return left, right


_PLACES = "seed long, key long, at int, kind int, first boolean, l long, r long"


def _placed(kmer: int, length: int, context: int, bitmap: np.ndarray | None, bits: int):
    """Places of seeds; of those whose bit is set, where there is a bitmap. Of places of one seed in one
    block of `context` words of a text the first counts, and every long run; the first in the text is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                at, value, kind = _seeds(words, kmer, length, context)
                if bitmap is not None:
                    slot = value >> np.uint64(64 - bits)
                    hit = bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1
                    at, value, kind = at[hit], value[hit], kind[hit]
                doc = words.doc[at]
                place = at - words.first[doc]
                order = np.lexsort((at, value))
                v, d, p = value[order], doc[order], place[order] // context
                first, new = np.ones(len(at), bool), np.ones(len(at), bool)
                first[order[1:]] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
                new[order[1:]] = first[order[1:]] | (p[1:] != p[:-1])
                new |= kind > 0
                left, right = contexts(words, context)
                right = np.append(right, np.zeros(kmer, np.uint64))
                # the words after the seed are those of its own text, or the text is too short for them
                after = np.where(place + kmer < np.diff(words.first)[doc], right[at + kmer], np.uint64(0))
                at, doc, place, kind, first, value, after = (x[new] for x in (at, doc, place, kind, first, value, after))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(value)), part["key"].take(pa.array(doc)), pa.array(place.astype(np.int32)), pa.array(kind), pa.array(first), pa.array(signed(left[at])), pa.array(signed(after))],
                    names=["seed", "key", "at", "kind", "first", "l", "r"],
                )

    return run


def _bitmap(seeds: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bitmap of the first bits of n seeds, at least 8 bits a seed, made by chunks."""
    bits, piece = max(17, (8 * n - 1).bit_length()), 17

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch["seed"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for c in np.unique(slot >> np.uint64(piece)).tolist():
                mine = found.setdefault(c, np.zeros(1 << piece, bool))
                mine[(slot[slot >> np.uint64(piece) == c] & np.uint64((1 << piece) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in found.values()], pa.binary())], names=["chunk", "data"])

    chunk = F.shiftrightunsigned("seed", 64 - bits + piece)
    out = np.zeros(1 << bits >> 3, np.uint8)
    tasks = max(1, (1 << bits >> piece) // 64)
    for row in seeds.select("seed").repartition(min(tasks, 1024), chunk).mapInArrow(chunks, "chunk long, data binary").toArrow().to_pylist():
        a = row["chunk"] << piece >> 3
        out[a : a + (1 << piece >> 3)] = np.frombuffer(row["data"], np.uint8)
    return out, bits


# Chains


class Fenwick:
    """Prefix maxima of (score, number) over positions 0..n-1."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e300, -1)] * (n + 1)

    def add(self, at: int, score: float, number: int) -> None:
        at += 1
        item, best = (score, number), self.best
        while at < len(best):
            if best[at] < item:
                best[at] = item
            at += at & -at

    def until(self, at: int) -> tuple[float, int]:
        """Over positions below `at`."""
        found, best = (-1e300, -1), self.best
        while at > 0:
            if best[at] > found:
                found = best[at]
            at -= at & -at
        return found


def chains(a: list[int], b: list[int], kmer: int = KMER, gap_cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of matches (a[i], b[i]), best first, each match in one chain at most.

    A match scores its k-mer. One that follows in both sequences pays gap_cost
    for half the words between, so the best predecessor is a prefix maximum of
    score + gap_cost * (a + b) / 2 over lesser b: one Fenwick query.
    """
    order = sorted(range(len(a)), key=lambda i: (a[i], b[i]))
    if all(b[j] - a[j] == b[i] - a[i] and 0 < a[j] - a[i] < kmer / gap_cost for i, j in zip(order, order[1:])) and order:
        return [order]
    places = {y: r for r, y in enumerate(sorted(set(b)))}
    tree, score, back = Fenwick(len(places)), [0.0] * len(a), [-1] * len(a)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and a[order[j]] == a[order[i]]:
            m = order[j]
            found, p = tree.until(places[b[m]])
            gain = found - gap_cost * (a[m] + b[m]) / 2
            score[m], back[m] = kmer + max(0.0, gain), p if gain > 0 else -1
            j += 1
        for m in order[i:j]:
            tree.add(places[b[m]], score[m] + gap_cost * (a[m] + b[m]) / 2, m)
        i = j
    used, out = [False] * len(a), []
    for m in sorted(order, key=lambda m: -score[m]):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = back[m]
        if chain:
            out.append(chain[::-1])
    return out


def _chain(kmer: int):
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("lead", "key", "lead_at", "at")] + [batch["alone"].to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            rest = now if rest is None else np.concatenate([rest, now])
            edges = np.flatnonzero((rest[1:, 0] != rest[:-1, 0]) | (rest[1:, 1] != rest[:-1, 1])) + 1
            if len(edges):
                yield of_pairs(rest[: edges[-1]], np.concatenate([[0], edges]))
                rest = rest[edges[-1] :]
        if rest is not None and len(rest):
            yield of_pairs(rest, np.array([0, len(rest)]))

    def of_pairs(x: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            met = dict.fromkeys(zip(x[s:e, 2].tolist(), x[s:e, 3].tolist(), x[s:e, 4].tolist()))  # a run of one k-mer meets by its first and its last
            out += [(int(x[s, 0]), int(x[s, 1]), [p], [q]) for p, q, alone in met if alone]
            a, b = [p for p, _, alone in met if not alone], [q for _, q, alone in met if not alone]
            for c in chains(a, b, kmer):
                out.append((int(x[s, 0]), int(x[s, 1]), [a[m] for m in c], [b[m] for m in c]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["lead", "key", "lead_ats", "ats"])

    return chain


# Alignment


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each word of a, the bits of b at which the common subsequence grows (0) or not (1)."""
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, [full]
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b."""
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence, of any size: bit-parallel rows (64 cells a machine
    word) and the way back through them; in halves where the rows would need over 8 MB."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    out = [(i, i) for i in range(lo)]
    if x and y:
        if len(x) * len(y) > _DIRECT and len(x) > 1:
            half = len(x) // 2
            cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
            out += [(lo + i, lo + j) for i, j in common(x[:half], y[:cut])]
            out += [(lo + half + i, lo + cut + j) for i, j in common(x[half:], y[cut:])]
        else:
            rows, back, i, j = _rows(x, y), [], len(x), len(y) - 1
            while i and j >= 0:
                if rows[i] >> j & 1:  # no growth at j
                    j -= 1
                elif not rows[i - 1] >> j & 1:  # the growth was there before this word
                    i -= 1
                else:
                    i -= 1
                    back.append((lo + i, lo + j))
                    j -= 1
            out += back[::-1]
    return out + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def align(a: list[int], b: list[int], at_a: list[int], at_b: list[int], kmer: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal words, in order, of two sequences aligned along a chain of k-mers: the chain's own, a
    longest common subsequence of every gap, and of what stands before and after the chain."""
    pairs: list[tuple[int, int]] = []
    x = y = 0  # aligned up to here
    for p, q in [*zip(at_a, at_b), (len(a), len(b))]:
        skip = max(x - p, y - q, 0)
        p, q = p + skip, q + skip
        if p > x and q > y:
            pairs += [(x + i, y + j) for i, j in common(a[x:p], b[y:q])]
        n = kmer - skip
        if n > 0 and p < len(a):
            pairs += zip(range(p, p + n), range(q, q + n))
            x, y = p + n, q + n
    out = np.array(pairs, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _maximal(gains: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring stretches of a sequence of numbers, in linear time (first, last)."""
    out: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total = 0.0
    for i, g in enumerate(gains):
        before, total = total, total + g
        if g <= 0:
            continue
        now = (i, i, before, total)
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][2] >= now[2]:
                k -= 1
            if k < 0 or out[k][3] >= now[3]:
                break
            now = (out[k][0], now[1], out[k][2], now[3])
            del out[k:]
        out.append(now)
    return [(f, e) for f, e, _, _ in out]


def passages(i: np.ndarray, j: np.ndarray, length: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches of an alignment (begin and end in each sequence, identity) of at least `length` words whose words agree to `identity`.

    A column counts 1 if its words agree, else -1; the stretches of maximal
    score are passages where they are alike enough. Those that aren't, as two
    copied passages with other words between, are cut again with weights by
    which every stretch of positive score is.
    """
    if not len(i):
        return []
    gap = np.maximum(np.diff(i), np.diff(j)) - 1
    ends = np.append(np.flatnonzero(gap), len(i) - 1)
    begins = np.append(0, ends[:-1] + 1)
    size, loss = (ends - begins + 1).tolist(), gap[ends[:-1]].tolist()
    out = []

    def cut(lo: int, hi: int, match: float, miss: float, last: bool) -> None:
        gains: list[float] = [size[lo] * match]
        for r in range(lo + 1, hi + 1):
            gains += [-loss[r - 1] * miss, size[r] * match]
        for f, e in _maximal(gains):
            f, e = lo + f // 2, lo + e // 2
            s, t, u, v = int(i[begins[f]]), int(i[ends[e]]) + 1, int(j[begins[f]]), int(j[ends[e]]) + 1
            if min(t - s, v - u) < length:
                continue
            same = (int(ends[e]) - int(begins[f]) + 1) / max(t - s, v - u)
            if same >= identity - 1e-9:
                out.append((s, t, u, v, same))
            elif not last:
                cut(f, e, 1 - identity, identity, True)

    cut(0, len(size) - 1, 1.0, 1.0, False)
    return out


def _packed(hashes: np.ndarray) -> bytes:
    """24 bits of each word's hash."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :3]).tobytes()


def _unpacked(data: bytes) -> list[int]:
    x = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
    return (x[:, 0] | x[:, 1] << 8 | x[:, 2] << 16).tolist()


def _cut(margin: int, kmer: int):
    """The words of every chain's side, with a margin at either end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                pairs, sizes, ids, sides, begins, spans = [], [], [], [], [], []
                for r, wanted in enumerate(part["wanted"].to_pylist()):
                    base, n = int(words.first[r]), int(words.first[r + 1] - words.first[r])
                    for w in wanted:
                        lo, hi = max(0, w["lo"] - margin), min(n, w["hi"] + kmer + margin)
                        pairs.append(w["pair"])
                        sizes.append(w["size"])
                        ids.append(w["chain"])
                        sides.append(w["side"])
                        begins.append(lo)
                        spans.append(_packed(words.hash[base + lo : base + hi]))
                columns = [pa.array(x, t) for x, t in ((pairs, pa.int64()), (sizes, pa.int32()), (ids, pa.int64()), (sides, pa.int32()), (begins, pa.int32()), (spans, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["pair", "size", "chain", "side", "begin", "words"])

    return cut


_FOUND = "key long, start int, stop int, other long, other_start int, other_stop int, identity double"


def within(places: list[int], kmer: int, spans: list[tuple[int, int]]) -> bool:
    """Whether every k-mer lies in one of the stretches."""
    return all(any(s <= p and p + kmer <= t for s, t in spans) for p in places)


def _aligned(kmer: int, length: int, identity: float):
    """Both directions of every passage. Of a chain three rows arrive: its places, the lead's words, its own;
    two documents' chains come together, longest first. One whose every seed lies, in both, in
    passages of these two that are found already asks no further."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, mine, theirs, chain, lead = None, [], [], {}, {}
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["side"] == -1:
                    chain = x
                    if pair != (x["lead"], x["key"]):
                        pair, mine, theirs = (x["lead"], x["key"]), [], []
                elif x["side"] == 0:
                    lead = x
                elif not (within(chain["lead_ats"], kmer, mine) and within(chain["ats"], kmer, theirs)):
                    a, b, c, d = _unpacked(lead["words"]), _unpacked(x["words"]), lead["begin"], x["begin"]
                    pairs = align(a, b, [t - c for t in chain["lead_ats"]], [t - d for t in chain["ats"]], kmer)
                    for s, t, u, v, same in passages(*pairs, length, identity):
                        rows.append((pair[0], s + c, t + c, pair[1], u + d, v + d, same))
                        rows.append((pair[1], u + d, v + d, pair[0], s + c, t + c, same))
                        mine.append((s + c, t + c))
                        theirs.append((u + d, v + d))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return run


def _passages(docs: DataFrame, matches: DataFrame, length: int, identity: float, kmer: int) -> DataFrame:
    """Chains matches (lead, key, lead_at, at, alone) and aligns the chains' words; a written table, see _FOUND."""
    matches = matches.repartition("lead", "key").sortWithinPartitions("lead", "key")
    chained = matches.mapInArrow(_chain(kmer), "lead long, key long, lead_ats array<int>, ats array<int>")
    named = {"pair": F.xxhash64("lead", "key"), "size": F.size("ats"), "chain": F.xxhash64("lead", "key", "lead_ats", "ats")}
    chained = written(chained.withColumns(named), "chains")
    ends = lambda c: (F.get(c, F.lit(0)).alias("lo"), F.element_at(c, -1).alias("hi"))
    sides = [chained.select(F.col(k).alias("key"), F.struct("pair", "size", "chain", F.lit(s).alias("side"), *ends(c)).alias("w")) for s, k, c in ((0, "lead", "lead_ats"), (1, "key", "ats"))]
    wanted = written(sides[0].unionByName(sides[1]).groupBy("key").agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = docs.join(lookup(wanted), "key").select("text", "wanted")
    parts = texts.mapInArrow(_cut(length, kmer), "pair long, size int, chain long, side int, begin int, words binary")
    ready = chained.withColumn("side", F.lit(-1)).unionByName(parts, allowMissingColumns=True)
    ready = ready.repartition("pair").sortWithinPartitions("pair", F.desc("size"), "chain", "side")
    found = written(ready.mapInArrow(_aligned(kmer, length, identity), _FOUND), "passages")
    drop_written(chained, wanted)
    return found


# The whole


def _alike(x: str, y: str) -> Column:
    """Whether two places may lie in one passage. A passage of `length` words has CONTEXT of them before a
    seed or after it; the masks of these share three fifths of their bits or more."""
    both = {s: F.bit_count(F.col(f"{x}.{s}").bitwiseAND(F.col(f"{y}.{s}"))) for s in "lr"}
    least = {s: F.least(F.bit_count(f"{x}.{s}"), F.bit_count(f"{y}.{s}")) for s in "lr"}
    return (least["l"] > 0) & (both["l"] * 5 >= least["l"] * 3) | (least["r"] > 0) & (both["r"] * 5 >= least["r"] * 3)


def _of_runs(longs: DataFrame) -> DataFrame:
    """The passages of runs (seed, key, at, kind) of one word that stand in another document too, as long as
    they are or in pieces as long as the longest there; see _FOUND."""
    by_doc = longs.groupBy("seed", "key").agg(F.max(F.struct("kind", F.bitwise_not("at").alias("order"), "at")).alias("r"))
    by_doc = written(by_doc.select("seed", "key", F.struct(F.col("r.kind").alias("size"), F.bitwise_not("key").alias("order"), "key", F.col("r.at").alias("at")).alias("o")), "runs")
    best = by_doc.groupBy("seed").agg(F.max("o").alias("best"))
    second = by_doc.join(best, "seed").where("key <> best.key").groupBy("seed").agg(F.max("o").alias("second"))
    met = longs.join(best.join(second, "seed"), "seed").withColumn("o", F.when(F.col("best.key") != F.col("key"), F.col("best")).otherwise(F.col("second")))
    met = met.withColumn("size", F.least("kind", "o.size"))
    pieces = met.withColumn("off", F.explode(F.array_union(F.sequence(F.lit(0), F.col("kind") - F.col("size"), "size"), F.array(F.col("kind") - F.col("size")))))
    begin = F.col("at") + F.col("off")
    found = pieces.select("key", begin.alias("start"), (begin + F.col("size")).alias("stop"), F.col("o.key").alias("other"), F.col("o.at").alias("other_start"), (F.col("o.at") + F.col("size")).alias("other_stop"), F.lit(1.0).alias("identity"))
    found = written(found, "passages")
    drop_written(by_doc)
    return found


def _covered(found: DataFrame) -> DataFrame:
    """key, spans: each document's covered stretches, merged."""
    order = Window.partitionBy("key").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.select("key", "start", "stop").distinct().withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("key", "island").agg(F.min("start").alias("lo"), F.max("stop").alias("hi"))
    return merged.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _marked(places: DataFrame, found: DataFrame, kmer: int) -> DataFrame:
    """seed, key, at, first, fresh: whether no passage covers the place so far."""
    inside = F.exists("spans", lambda s: (s["lo"] <= F.col("at")) & (F.col("at") + kmer <= s["hi"]))
    return places.join(_covered(found), "key", "left").select("seed", "key", "at", "first", (F.col("spans").isNull() | ~inside).alias("fresh"))


def _windows(kmer: int, context: int, reach: int, length: int):
    """The wanted places of every text with their masks, and a byte for each of the `reach` words before
    (nearest first) and after; 0 where the text ends. Two more bytes: how many of the words before and after are of
    the same run of one word, of less than `length`, as the seed. `inner`: whether the place is within a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, wanted = Words(part["text"]), part["wanted"]
                doc = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
                flat = wanted.flatten()
                place = flat.field("at").to_numpy()
                at = words.first[doc] + place
                left, right = contexts(words, context)
                right = np.append(right, np.zeros(kmer, np.uint64))
                after = np.where(place + kmer < np.diff(words.first)[doc], right[at + kmer], np.uint64(0))
                code = np.concatenate([(words.hash % np.uint64(255)).astype(np.uint8) + np.uint8(1), np.zeros(1, np.uint8)])
                near = at[:, None] + np.concatenate([np.arange(-1, -reach - 1, -1), np.arange(kmer, kmer + reach)])
                near[(near < words.first[doc][:, None]) | (near >= words.first[doc + 1][:, None])] = -1
                before, more = _stretch(words, at, kmer)
                short = (before >= 0) & (before + more + kmer < length)
                run = np.where(short[:, None], np.stack([before, more], axis=1), 0).astype(np.uint8)
                spans = np.arange(len(at) + 1, dtype=np.int32) * (2 * reach + 2)
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(np.concatenate([code[near], run], axis=1)))])
                cells = [flat.field(c) for c in ("seed", "at", "fresh", "blocks")]
                yield pa.RecordBatch.from_arrays([cells[0], part["key"].take(pa.array(doc)), *cells[1:], pa.array(signed(left[at])), pa.array(signed(after)), pa.array((before > 0) & (more > 0)), data], names=["seed", "key", "at", "fresh", "blocks", "l", "r", "inner", "words"])

    return run


def _tiers(length: int, identity: float, kmer: int) -> list[tuple[int, int]]:
    """Sizes of windows about a seed (without it) and words in common that they need: a passage of w to
    v - 1 words lacks (1 - identity) * (v - 1) of them at most, so no w of its words lack more."""
    out, w = [], length
    for _ in range(6):
        v = w + max(1, -(-w * 12 // 100))
        out.append((max(0, w - kmer), max(0, w - kmer - int((1 - identity) * (v - 1) + 1e-9))))
        w = v
    return out


def agreeing(x: np.ndarray, y: np.ndarray, tiers: list[tuple[int, int]], drift: int) -> np.ndarray:
    """For pairs of places (rows of bytes, see _windows) whether in some window about the seed enough words of
    the first (see _tiers) stand in the second too, at most `drift` words off. Of a seed in a short run of one word one
    of these lies outside of the run: a passage begins and ends with words in common, and is longer than the run."""
    reach, counts, outside = tiers[-1][0], [], []
    wide = reach + drift
    runs = np.flatnonzero(x[:, 2 * wide :].any(axis=1)) if x.shape[1] > 2 * wide else np.zeros(0, np.int64)
    for k, side in enumerate((slice(0, wide), slice(wide, 2 * wide))):
        a, b = x[:, side], y[:, side]
        same = a == b
        for d in range(1, drift + 1):
            same[:, d:] |= a[:, d:] == b[:, :-d]
            same[:, :-d] |= a[:, :-d] == b[:, d:]
        same &= a > 0
        count = np.zeros((len(x), reach + 1), np.uint16)
        np.cumsum(same[:, :reach], axis=1, dtype=np.uint16, out=count[:, 1:])
        counts.append(count)
        if len(runs):
            within = np.minimum(x[runs, 2 * wide + k], reach).astype(np.int64)
            mine = count[runs]
            outside.append(mine > np.where(np.arange(reach + 1) < within[:, None], mine, mine[np.arange(len(runs)), within][:, None]))
    out, row = np.zeros(len(x), bool), np.full(len(x), -1)
    row[runs] = np.arange(len(runs))
    for size, least in tiers:
        may = np.flatnonzero(~out & (counts[0][:, size] + counts[1][:, size] >= least))
        if not len(may):
            continue
        enough = counts[0][may, : size + 1] + counts[1][may, size::-1] >= least
        if len(runs):
            of, k = row[may], np.flatnonzero(row[may] >= 0)
            enough[k] &= outside[0][of[k], : size + 1] | outside[1][of[k], size::-1]
        out[may] = enough.any(axis=1)
    return out


def _meet(tiers: list[tuple[int, int]], drift: int, pairs: int = 1 << 18, most: int = 1 << 12):
    """The pairs of places of one seed, in rows sorted by seed, i, j, block and fresh (first), of which one at
    least is fresh, that may lie in one passage: blocks i and j meet, or i itself. Those with over `most` pairs are
    compared in tiles, rows against columns; the small ones many at a time. A match within a run of one word stands
    alone: any other of the run is as good, so a chain of these would be out of step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False) for c in ("seed", "i", "j", "block", "fresh", "key", "at", "l", "r", "inner")]
            _, spans, data = batch["words"].buffers()
            begin = int(np.frombuffer(spans, np.int32)[batch["words"].offset]) if batch.num_rows else 0
            size = 2 * (tiers[-1][0] + drift) + 2
            now.append(np.frombuffer(data, np.uint8)[begin : begin + batch.num_rows * size].reshape(-1, size))
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            new = np.flatnonzero((rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1]) | (rest[2][1:] != rest[2][:-1]))
            if len(new):
                cut = int(new[-1]) + 1
                yield from of_groups([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield from of_groups(rest)

    def of_groups(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        def matches(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            ok = key[x] != key[y]
            x, y = x[ok], y[ok]
            for _ in range(2):  # enough words of either stand in the other
                good = [agreeing(words[x[c : c + 4096]], words[y[c : c + 4096]], tiers, drift) for c in range(0, len(x), 4096)]
                good = np.concatenate([*good, np.zeros(0, bool)])
                x, y = y[good], x[good]
            swap = key[x] > key[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            return pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(key[y]), pa.array(at[x]), pa.array(at[y]), pa.array(inner[x] | inner[y])], names=["lead", "key", "lead_at", "at", "alone"])

        seed, i, j, block, fresh, key, at, l, r, inner, words = rows
        l, r, n = l.view(np.uint64), r.view(np.uint64), len(seed)
        opens = np.concatenate([[True], (seed[1:] != seed[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        begins = np.flatnonzero(opens)
        group = np.cumsum(opens) - 1
        ends = np.append(begins[1:], n)
        second = (block == j) & (i != j)
        other = ends - np.bincount(group[second], minlength=len(begins))  # where the rows of block j begin
        news = np.bincount(group[second & fresh], minlength=len(begins))
        # each row's partners are the rows from..to
        row, across = np.arange(n), (i != j)
        start = np.where(across, other[group], row + 1)
        stop = np.where(across, np.where(fresh, ends[group], other[group] + news[group]), np.where(fresh, ends[group], row + 1))
        counts = np.where(second, 0, stop - start)
        large = np.bincount(group, counts, minlength=len(begins)) > most
        counts[large[group]] = 0  # these go by tiles
        # a mask shares three fifths of the bits of the lesser: thresholds; none for an empty one
        need = [np.where(m == 0, 255, (np.bitwise_count(m) * np.uint16(3) + 4) // 5).astype(np.uint8) for m in (l, r)]

        def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            ok = np.zeros(np.broadcast_shapes(x.shape, y.shape), bool)
            for m, t in zip((l, r), need):
                bits = np.bitwise_count(m[x] & m[y])
                ok |= (bits >= t[x]) | (bits >= t[y])
            return ok

        total = np.concatenate([[0], np.cumsum(counts)])
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(total, total[a] + pairs, side="right")) - 1)
            x = np.repeat(row[a:b], counts[a:b])
            y = start[x] + np.arange(len(x)) - (total[x] - total[a])
            a = b
            ok = alike(x, y)
            yield matches(x[ok], y[ok])
        for g in np.flatnonzero(large):
            b, o, e = int(begins[g]), int(other[g]), int(ends[g])
            f = b + int(fresh[b:o].sum())
            for lo, hi, first, last in ((b, f, o if across[b] else b, e), (f, o, o, o + int(news[g]))):
                step = max(1, pairs // max(1, last - first))
                for c in range(lo, hi if last > first else lo, step):
                    x, y = row[c : min(c + step, hi), None], row[None, first if across[b] else c + 1 : last]
                    ok = alike(x, y)
                    if not across[b]:
                        ok &= x < y
                    p, q = np.nonzero(ok)
                    yield matches(x[p, 0], y[0, q])

    return run


def _met(docs: DataFrame, marked: DataFrame, length: int, identity: float, kmer: int, block: int, few: int | None = None) -> DataFrame:
    """lead, key, lead_at, at, alone: every fresh place with every place of its seed, in other documents, that may lie
    in one passage with it: by the masks, and by the words about them (see _tiers; a passage of up to twice
    `length` words has as much in common about every seed, but for sides more than DRIFT out of step).
    few: with those of its bucket only, of about so many documents by their hash."""
    tiers = _tiers(length, identity, kmer)
    # of few: powers of two, so that two documents in one bucket of a seed share those of all seeds in as many documents or fewer
    texts_of = F.sum(F.col("first").cast("int"))
    blocks = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(texts_of / few) - 1e-9))) if few else F.ceil(F.count("*") / block)
    seeds = marked.groupBy("seed").agg(F.count("*").alias("n"), F.max("fresh").alias("any"), blocks.cast("int").alias("blocks")).where("any and n > 1")
    wanted = marked.join(seeds.select("seed", "blocks"), "seed")
    wanted = written(wanted.groupBy("key").agg(F.collect_list(F.struct("seed", "at", "fresh", "blocks")).alias("wanted")), "wanted")
    texts = docs.join(lookup(wanted), "key").select("key", "text", "wanted")
    seen = texts.mapInArrow(_windows(kmer, CONTEXT, tiers[-1][0] + DRIFT, length), "seed long, key long, at int, fresh boolean, blocks int, l long, r long, inner boolean, words binary")
    columns = ("block", "fresh", "key", "at", "l", "r", "inner", "words")
    if few:
        mine = seen.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        pairs = mine.select("seed", F.col("block").alias("i"), F.col("block").alias("j"), *columns)
    else:
        mine = seen.withColumn("block", F.pmod(F.xxhash64("key", "at"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = mine.select("seed", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns)
    pairs = pairs.repartition("seed", "i", "j").sortWithinPartitions("seed", "i", "j", "block", F.desc("fresh"))
    met = written(pairs.mapInArrow(_meet(tiers, DRIFT), "lead long, key long, lead_at int, at int, alone boolean"), "met")
    drop_written(wanted)
    return met


def fuzzy_passages(
    docs: DataFrame, length: int = LENGTH, identity: float = IDENTITY, kmer: int = KMER, group: int = GROUP, bitmap_seeds: int = BITMAP_SEEDS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start_word, end_word, other_id, other_start, other_end, identity: every stretch of a document
    covered by passages of at least `length` words that stand, edited or not, in another document too,
    with the longest such passage of it: the other document, the place there, and the share of words that agree.

    Seeds are k-mers of words whose least word stands first or last. Those in
    one document alone go at once. A place carries masks of the words about it, so pairs
    that share little more than a phrase go before anything is chained or aligned.

    0. Runs of one word over and over are covered by the longest such run of another document. Else a run has two places,
       its ends, with other seeds for either; those within long runs ask only where no other document has one.
    1. Every place meets its group's lead (groups of at most about `group` documents of a seed, by a hash), so a
       passage in a million documents makes a million matches, not their square.
    2. Every place that no passage covers so far meets all places of its seed in a bucket of about FEW documents;
       those go on that may lie in one passage with it (see _met).
    3. Every place that is uncovered even then meets all places of its seed in all other documents, by blocks
       of `block` places. Nothing is capped, so this costs the square of a seed's places where few are covered.

    The matches of two documents are chained (Fenwick tree, gap costs), the chains'
    words fetched with `length` words at either end, and aligned: gaps of any
    size by a longest common subsequence. Passages are cut where too little agrees.

    - Words are compared without case and punctuation; positions count words from 0, the end excluded.
    - Null and empty texts, and those below `length` words, give no rows.
    - Ids must be integers or cast to them. Null ids are kept. Rows that repeat an id with the same text are one
      document. Documents are told apart by a 64-bit hash of id and text.
    - A passage that repeats within one document alone doesn't count; in a document with other copies each of its places does.
    - Of passages found of a stretch, the longest is shown (covered places ask no further, so longer ones may stand elsewhere); of equal ones that with the least (hash of the) other document.
    - Runs of one word, of `length` words or more, in two documents cover each other at once, without seeds (step 0): a run as
      long as the longest elsewhere or in pieces as long as that. Texts that repeat several words in turn have no such way.
    - Very long texts are searched whole. Extra columns are dropped first. An empty table gives no rows.
    - Approximate by its seeds: a passage needs one in common, and words about it alike enough (see
      _alike, _tiers). Of a seed that repeats within CONTEXT words one place a block counts. A covered stretch
      grows by passages that have a seed outside it.
    """
    docs = unique_docs(docs, id_col, text_col)
    counted = docs.select("text").mapInArrow(_counted(kmer, length, CONTEXT), "seed long, run boolean")
    repeated = written(counted.groupBy("seed").agg(F.count("*").alias("g"), F.count_if("run").alias("runs")).where("g > 1"), "repeated")
    n = repeated.count()
    bitmap = _bitmap(repeated, n) if n <= bitmap_seeds else (None, 0)
    # buckets of a seed: 1 up to `group` documents, then 16, 256, ...
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("g") / group) / _LEVEL - 1e-9)).cast("int") * _LEVEL
    found_at = docs.select("key", "text").mapInArrow(_placed(kmer, length, CONTEXT, *bitmap), _PLACES).join(repeated, "seed")
    # where two documents have long runs of a word, these are covered: their inner places only wait for others
    found_at = found_at.where((F.col("kind") != DEEP) | (F.col("runs") < 2)).withColumn("kind", F.when((F.col("kind") > 0) & (F.col("runs") < 2), 0).otherwise(F.col("kind")))
    bucket = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(xxhash64(key), 64 - depth)"))
    places = written(found_at.withColumn("depth", depth).withColumn("bucket", bucket).select("seed", "bucket", "key", "at", "kind", "first", "l", "r"), "places")
    first = places.where("first")
    lead = written(first.groupBy("seed", "bucket").agg(F.min(F.struct("key", "at", "l", "r")).alias("y"), F.count("*").alias("n")).where("n > 1").select("seed", "bucket", "y"), "leads")
    found = [_of_runs(places.where("kind > 0"))]
    star = places.where("kind >= 0").select("seed", "bucket", F.struct("key", "at", "l", "r").alias("x")).join(lead, ["seed", "bucket"]).where((F.col("x.key") != F.col("y.key")) & _alike("x", "y"))
    found.append(_passages(docs, star.select(F.col("y.key").alias("lead"), F.col("x.key").alias("key"), F.col("y.at").alias("lead_at"), F.col("x.at").alias("at"), F.lit(False).alias("alone")), length, identity, kmer))
    marked = written(_marked(places, reduce(DataFrame.unionByName, found), kmer), "marked")
    drop_written(places, lead, repeated)
    for few in (FEW, None):
        met = _met(docs, marked, length, identity, kmer, block, few)
        found.append(_passages(docs, met, length, identity, kmer))
        drop_written(met)
        if few:
            before, marked = marked, written(_marked(marked, reduce(DataFrame.unionByName, found), kmer), "marked")
            drop_written(before)
    drop_written(marked)
    every = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("key").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    longest = F.struct((F.col("stop") - F.col("start")).alias("size"), "identity", (-F.col("other")).alias("order"), "other", "other_start", "other_stop")
    spans = islands.groupBy("key", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.max(longest).alias("o"))
    ids = docs.select("key", "doc_id")
    out = spans.join(ids, "key").select("doc_id", "start_word", "end_word", F.col("o.other").alias("key"), F.col("o.other_start").alias("other_start"), F.col("o.other_stop").alias("other_end"), F.col("o.identity").alias("identity"))
    return out.join(ids.withColumnRenamed("doc_id", "other_id"), "key").select("doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "identity")
