"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, fresh, narrow, row_key, without, written
from .tokens import Words, distinct, mix, signed, slices

BITS = 256
RADIUS = 40
#: Segments whose counts embed a fingerprint; nodes that the grid is made from (those of least hash).
COUNTS, SAMPLE = 8, 8192
#: Widest segment of a cell's tables and the reach of most; nodes of a cell at most; cells at least, once there are FEW nodes for each.
WIDTH, REACH = 19, 2
BLOCK, LEAST_BLOCKS, FEW = 400_000, 6, 10_000


_LANES = mix(np.arange(BITS, dtype=np.uint64), 7) | np.uint64(1)
_PIECE, _FEW = 8192, 40_000


def _weights(features: np.ndarray) -> np.ndarray:
    """Weights by feature and bit, from the feature's whole hash: random signs, magnitudes of a heavy tail (stability 1/2).

    With such weights the sign of a sum follows the few largest, so that the
    share of bits that differ grows in proportion to the share of words that
    were edited; with weights of plus or minus one it grows as its square root.
    """
    out = np.empty((len(features), BITS), np.float32)
    for a in range(0, len(features), 64):
        x = features[a : a + 64, None] * _LANES
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(32)
        u = (x.astype(np.uint32).view(np.int32) | 1).astype(np.float32)  # the sign, and a uniform magnitude of 31 bits
        out[a : a + 64] = np.copysign(np.float32(2.0**62) / (u * u), u)
    return out


def _prints(words: Words, n: int) -> np.ndarray:
    """n x 4 words of 64 bits, of each text's distinct words."""
    features, number = np.unique(words.hash, return_inverse=True)
    pair = distinct(words.doc * max(len(features), 1) + number)
    doc, feature = pair // max(len(features), 1), pair % max(len(features), 1)
    first = np.searchsorted(doc, np.arange(n + 1))
    table = _weights(features) if len(features) <= _FEW else None
    bits = np.zeros((n, BITS), bool)
    for d in np.unique(doc):
        # features ascend and pieces are the text's own, so that equal sets of words give equal sums, to the last bit
        total = np.zeros(BITS)
        for a in range(first[d], first[d + 1], _PIECE):
            b = min(a + _PIECE, first[d + 1])
            total += (_weights(features[feature[a:b]]) if table is None else table[feature[a:b]]).sum(axis=0, dtype=np.float64)
        bits[d] = total > 0
    return np.packbits(bits, axis=1).view(np.uint64)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part["text"])
            keep = np.flatnonzero(np.diff(words.first))
            fp = signed(_prints(words, part.num_rows))[keep]
            yield pa.RecordBatch.from_arrays([part["key"].take(pa.array(keep)), part["doc_id"].take(pa.array(keep)), *[pa.array(fp[:, j].copy()) for j in range(4)]], names=["key", "doc_id", "f0", "f1", "f2", "f3"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, f0..f3: 256 bits of every document that has a word."""
    return narrow(docs, id_col, text_col).mapInArrow(_fingerprint, "key long, doc_id long, f0 long, f1 long, f2 long, f3 long")


def _segments(radius: int) -> list[tuple[int, int, int]]:
    """First bit, width and reach of disjoint segments: of two fingerprints within `radius`, at least one
    segment differs by no more than its reach, as the sum of reach + 1 over the segments exceeds the radius."""
    whole, rest = divmod(min(radius, BITS) + 1, REACH + 1)
    reach = [REACH] * whole + [rest - 1] * (rest > 0)
    ends = np.floor(np.cumsum([r + 4 for r in reach]) * BITS / sum(r + 4 for r in reach)).astype(int).tolist()
    return [(a, min(b - a, WIDTH), r) for a, b, r in zip([0, *ends], ends, reach)]


def _values(fp: np.ndarray, first: int, width: int) -> np.ndarray:
    """The bits first..first+width-1 of each fingerprint (n x 4 words), as a number."""
    j, shift = divmod(first, 64)
    x = fp[:, j] >> np.uint64(shift)
    if shift + width > 64:
        x = x | fp[:, j + 1] << np.uint64(64 - shift)
    return (x & np.uint64((1 << width) - 1)).astype(np.int64)


def _meet(x: np.ndarray, y: np.ndarray, radius: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of rows of x and y (n x 4 words) within `radius` bits, once.

    For each segment, y is probed at all values within the segment's reach of
    those of x. A pair comes up at the first segment that brings it together.
    """
    segments = _segments(radius)
    for s, (first, width, reach) in enumerate(segments):
        vx, vy = _values(x, first, width).astype(np.int32), _values(y, first, width)
        order = np.argsort(vy, kind="stable").astype(np.int32)
        counts = np.bincount(vy, minlength=1 << width).astype(np.int32)
        starts = np.cumsum(counts, dtype=np.int32) - counts
        masks = np.array([sum(1 << k for k in flips) for r in range(min(reach, width) + 1) for flips in combinations(range(width), r)], np.int32)
        step = max(1, most // 4 // max(1, len(x)))
        for m in range(0, len(masks), step):
            at = (vx ^ masks[m : m + step, None]).ravel()
            some = np.flatnonzero(counts[at])
            at = at[some]
            n, begin, row = counts[at], starts[at], some % len(x)
            total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            a = 0
            while a < len(some):
                b = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
                i = np.repeat(row[a:b], n[a:b])
                j = order[np.arange(total[b] - total[a]) + np.repeat(begin[a:b] - (total[a:b] - total[a]), n[a:b])]
                half = np.flatnonzero(np.bitwise_count(x[i, 0] ^ y[j, 0]) + np.bitwise_count(x[i, 3] ^ y[j, 3]) <= radius)
                i, j, a = i[half], j[half], b
                near = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64) <= radius
                i, j = i[near], j[near]
                for f, w, r in segments[:s]:
                    new = np.bitwise_count(_values(x[i], f, w) ^ _values(y[j], f, w)) > r
                    i, j = i[new], j[new]
                if len(i):
                    yield i, j


def _tiles(radius: int):
    """a, b: the close pairs of every tile; rows come sorted by tile."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                tile = batch["tile"].to_numpy()
                if parts and parts[0]["tile"][0].as_py() != tile[0]:
                    yield from of_tile(parts)
                    parts = []
                n = int(np.searchsorted(tile, tile[0], side="right"))
                parts.append(batch.slice(0, n))
                batch = batch.slice(n)
        if parts:
            yield from of_tile(parts)

    def of_tile(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, side = (np.concatenate([p[c].to_numpy(zero_copy_only=False) for p in parts]) for c in ("node", "side"))
        fp = np.stack([np.concatenate([p[f"f{j}"].to_numpy() for p in parts]) for j in range(4)], axis=1).view(np.uint64)
        x, y = np.flatnonzero(side < 2), np.flatnonzero(side > 0)  # side 1: a block with itself
        for i, j in _meet(fp[x], fp[y], radius):
            a, b = node[x[i]], node[y[j]]
            keep = (a < b) if side[0] == 1 else a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])

    return tiles


def grid(counts: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """Segment and count at which each inner node of the grid splits, in the order of a heap: cells are
    halved along the segment whose counts vary most, so that crowded parts get small cells. -1: not split."""
    out, rows = [], [np.arange(len(counts))]
    for node in range((1 << max(0, leaves - 1).bit_length()) - 1):
        mine = counts[rows[node]]
        spread = mine.std(axis=0) if len(mine) > 1 else np.zeros(1)
        c = int(spread.argmax())
        cut = int(np.median(mine[:, c])) if spread[c] > 0 else 0
        if spread[c] > 0 and cut == mine[:, c].min():
            cut += 1
        below = mine[:, c] < cut if spread[c] > 0 else np.ones(len(mine), bool)
        out.append((c if spread[c] > 0 else -1, cut))
        rows += [rows[node][below], rows[node][~below]]
    return out


def _located(splits: list[tuple[int, int]]):
    """Adds each node's counts and its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([batch[f"f{j}"].to_numpy() for j in range(4)], axis=1).view(np.uint32).reshape(-1, COUNTS)
            counts = np.bitwise_count(fp).astype(np.int32)
            cell = np.zeros(len(counts), np.int64)
            for _ in range(len(splits).bit_length() if splits else 0):
                column, cut = (np.array(x) for x in zip(*splits))
                cell = 2 * cell + 1 + ((column[cell] >= 0) & (counts[np.arange(len(cell)), np.maximum(column[cell], 0)] >= cut[cell]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(counts.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "cell", "counts"])

    return run


def _apart(low: str, high: str, other_low: str, other_high: str) -> Column:
    """Manhattan distance of two boxes."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(COUNTS - 1)), F.lit(0),
        lambda a, i: a + F.greatest(F.lit(0), F.get(other_low, i) - F.get(high, i), F.get(low, i) - F.get(other_high, i)),
    )


def near_pairs(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """a, b: all pairs of nodes (node, f0..f3, distinct) within `radius` bits of each other.

    A grid range-join, exact. A fingerprint is embedded as the bit counts of its
    COUNTS segments; the Manhattan distance of two embeddings is at most the number
    of bits that differ. Cells of a grid over the counts, refined where crowded
    and cut by hash beyond `block` nodes, meet if the boxes about their counts are
    within the radius, and a node goes to the cells whose boxes are (40 bytes
    each). Where two cells meet, fingerprints are compared by segments: two within
    the radius are, in one segment at least, within that segment's small reach
    (pigeonhole), so a table of the segment's values is probed at all values so
    near. The bits decide. The result is a written table.
    """
    n = nodes.count()
    leaves = max(-(-n // block), min(LEAST_BLOCKS, 1 + n // FEW))
    few = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("f0", "f1", "f2", "f3").toArrow()
    counts = np.bitwise_count(np.stack([few[f"f{j}"].to_numpy() for j in range(4)], axis=1).view(np.uint32).reshape(-1, COUNTS)).astype(np.int64)
    kind = "node long, f0 long, f1 long, f2 long, f3 long"
    placed = nodes.select("node", "f0", "f1", "f2", "f3").mapInArrow(_located(grid(counts, min(leaves, max(1, len(counts) // 8)))), f"{kind}, cell long, counts array<int>")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = written(placed.join(sizes, "cell").withColumn("cell", F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.col("parts")))).drop("parts"), "placed")
    corners = [F.array(*[f(F.get("counts", F.lit(i))) for i in range(COUNTS)]) for f in (F.min, F.max)]
    boxes = written(placed.groupBy("cell").agg(corners[0].alias("low"), corners[1].alias("high")), "boxes")
    deal = F.pmod(F.col("cell"), F.lit(16))
    theirs = boxes.select(F.col("cell").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"), deal.alias("deal"))
    mine = boxes.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    meets = written(mine.join(theirs, "deal").where(_apart("low", "high", "other_low", "other_high") <= radius).select("cell", "other", "other_low", "other_high"), "meets")
    side = F.when(F.col("cell") == F.col("other"), 1).when(F.col("cell") < F.col("other"), 0).otherwise(2).cast("byte")
    tile = F.xxhash64(F.least("cell", "other"), F.greatest("cell", "other"))
    rows = placed.join(meets, "cell").where(_apart("counts", "counts", "other_low", "other_high") <= radius).select(tile.alias("tile"), side.alias("side"), "node", "f0", "f1", "f2", "f3")
    pairs = written(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(radius), "a long, b long"), "pairs")
    drop_written(placed, boxes, meets)
    return pairs


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, kept_key, kept_id, links: every document of a group but the one that stays, with that
    one, and how many other documents are within the radius of it.

    Groups are the connected components of pairs of fingerprints within `radius`
    of 256 bits; of each group the document with the least (doc_id, key) stays.

    - Equal fingerprints (copies, whatever their case, space and punctuation, and
      whatever their number) are one node, so they cost nothing in the join.
    - A null or empty text, or one without words, has no fingerprint and no group.
    - Rows that repeat an id with the same text are one document. Ids must be
      integers or cast to them; documents are told apart by a 64-bit hash of id and text.
    - A null id comes after all others. Very long texts count whole. Extra
      columns are dropped first. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col).distinct(), "prints")
    fs = ["f0", "f1", "f2", "f3"]
    nodes = written(prints.groupBy(*fs).agg(F.min("key").alias("node"), F.count("*").alias("copies")), "nodes")
    pairs = near_pairs(nodes, radius)
    roots = components(pairs)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("near"))
    node = nodes.join(roots, "node", "left").join(near, "node", "left").select(*fs, F.coalesce("root", "node").alias("root"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
    member = prints.join(node, fs).select("key", "doc_id", "root", "links")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    kept = member.groupBy("root").agg(F.min(order).alias("kept"), F.count("*").alias("n")).where("n > 1").select("root", F.col("kept.doc_id").alias("kept_id"), F.col("kept.key").alias("kept_key"))
    return member.join(kept, "root").where(F.col("key") != F.col("kept_key")).select("key", "doc_id", "kept_key", "kept_id", "links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that stay, whole: one of each group of near copies, and one of rows that
    repeat an id with the same text. Nulls, empty texts and ties as in near_duplicates."""
    gone = written(near_duplicates(docs, id_col=id_col, text_col=text_col, **params).select("key"), "gone")
    again = narrow(docs, id_col, text_col).groupBy("key").count().where("count > 1").select("key")
    again = written(again, "again")
    out = without(docs, gone, id_col, text_col)
    if again.isEmpty():
        return out
    name = fresh(docs.columns, "__key")
    twice = out.withColumn(name, row_key(id_col, text_col)).join(again.select(F.col("key").alias(name)), name, "left_semi")
    return without(out, again, id_col, text_col).unionByName(twice.dropDuplicates([name]).select(*[F.col(f"`{c}`") for c in docs.columns]))
