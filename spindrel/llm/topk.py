"""Exact top-k search over vectors with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

K = 10
#: Vectors that the tree of cells is made from (those of least hash), its leaves at most, rows of a block, queries of a tile and of a group.
SAMPLE, CELLS, BLOCK, TILE, GROUP = 8192, 1024, 65_536, 256, 65_536
_LEAST_BLOCK, _BLOCKS = 2048, 32
_PART, _CHUNK = 2048, 1 << 16
_BOX = 16


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, scaled so that squared distances between rows of the
    result are lower bounds of those between rows of x. Dimensions beyond a multiple are left to finer levels."""
    n, d = x.shape
    size = d // segments
    parts = x[:, : size * segments].reshape(n, segments, size)
    return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1) * np.sqrt(size)


def levels(dims: int) -> list[int]:
    """Segment counts, coarse to fine; the finest has segments of two."""
    out, m = [], 1
    while m * 2 < dims:
        out.append(m)
        m *= 4
    return [*out, dims // 2] if dims >= 4 and out[-1] != dims // 2 else out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def search(q: np.ndarray, d: np.ndarray, limit: np.ndarray, k: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query row, data row and distance of the pairs that may be among a query's k nearest: those within
    `limit` (squared, one for each query) that k others in d don't beat by more than rounding; and the number of exact distances taken.

    `apart`: a row of d for each query (or -1) that isn't compared with it. Level by level, coarse to
    fine, pairs whose bound exceeds the query's limit go, and only those left get a finer bound; what
    survives gets its exact distance, from which the limits tighten for the rows to come. A level that
    took nothing off the last rows is tried again on every sixteenth part only.
    """
    dims = q.shape[1]
    slack = 1e-9 * (1.0 + np.abs(q).max(initial=0) + np.abs(d).max(initial=0)) ** 2 * dims
    limit = limit + slack
    steps, found, best, exact = levels(dims), [], np.full((len(q), k), np.inf), 0
    of_q, idle = {m: statistics(q, m) for m in steps}, dict.fromkeys(steps, 0)
    for at in range(0, len(d), _PART):
        part = d[at : at + _PART]
        alive = np.ones((len(q), len(part)), bool)
        if apart is not None:
            own = np.flatnonzero((apart >= at) & (apart < at + len(part)))
            alive[own, apart[own] - at] = False
        left, i, j = int(alive.sum()), None, None
        for m in steps:
            if not left:
                break
            if idle[m] and at // _PART % 16:
                continue
            b = statistics(part, m)
            if i is None:
                alive &= _squares(of_q[m], b) <= limit[:, None]
                now = int(alive.sum())
            else:
                ok = np.concatenate([((of_q[m][i[s : s + _CHUNK]] - b[j[s : s + _CHUNK]]) ** 2).sum(1) <= limit[i[s : s + _CHUNK]] for s in range(0, len(i), _CHUNK)])
                i, j = i[ok], j[ok]
                now = len(i)
            idle[m], left = int(now > 0.95 * left), now
            if i is None and left < 0.2 * alive.size:
                i, j = np.nonzero(alive)
        if not left:
            continue
        if i is None:
            if left > 0.2 * alive.size and len(part) > k:
                # bounds took little: one product gives all distances but for rounding, and its k-th least a limit
                near = np.where(alive, _squares(q, part), np.inf)
                limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
                alive &= near <= limit[:, None]
                exact += left
            i, j = np.nonzero(alive)
        square = np.empty(len(i))
        for s in range(0, len(i), _CHUNK):
            diff = q[i[s : s + _CHUNK]] - part[j[s : s + _CHUNK]]
            square[s : s + _CHUNK] = (diff * diff).sum(axis=1)
        exact += len(i)
        keep = square <= limit[i]
        i, j, square = i[keep], j[keep], square[keep]
        found.append((i, j + at, square))
        order = np.lexsort((square, i))
        rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        top = order[rank < k]
        some = np.full((len(q), k), np.inf)
        some[i[top], rank[rank < k]] = square[top]
        best = np.sort(np.concatenate([best, some], axis=1), axis=1)[:, :k]
        limit = np.minimum(limit, best[:, -1] + slack)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), exact
    i, j, square = (np.concatenate(x) for x in zip(*found))
    keep = square <= limit[i]
    return i[keep], j[keep], np.sqrt(square[keep]), exact


# Cells: a tree over coarse statistics, so that blocks are near in themselves and boxes about them prune.


def _coarse(x: np.ndarray) -> np.ndarray:
    return statistics(x, 4 if x.shape[1] >= 8 else 1)


def tree(x: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Column and middle at which each inner node splits, in the order of a heap; -1: a leaf, as all rows are alike."""
    s, out, rows = _coarse(x), [], [np.arange(len(x))]
    depth = max(0, leaves - 1).bit_length()
    for node in range((1 << depth) - 1):
        mine = s[rows[node]]
        spread = mine.std(axis=0) if len(mine) > 1 else np.zeros(1)
        c = int(spread.argmax())
        if spread[c] > 0:
            cut = float(np.median(mine[:, c]))
            below = mine[:, c] < cut
            out.append((c, cut))
            rows += [rows[node][below], rows[node][~below]]
        else:
            out.append((-1, 0.0))
            rows += [rows[node], rows[node][:0]]
    return out


def cells(x: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    s, node = _coarse(x), np.zeros(len(x), np.int64)
    if splits:
        column, cut = np.array([c for c, _ in splits]), np.array([v for _, v in splits])
        for _ in range(len(splits).bit_length()):
            c = column[node]
            node = 2 * node + 1 + ((c >= 0) & (s[np.arange(len(x)), np.maximum(c, 0)] >= cut[node]))
    return node


def _assign(trees: dict[int, list[tuple[int, float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            cell = np.zeros(len(dims), np.int64)
            flat, offsets = batch["v"].values.to_numpy(zero_copy_only=False), batch["v"].offsets.to_numpy()
            for n in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == n)
                x = flat[offsets[rows][:, None] + np.arange(n)]
                cell[rows] = cells(x, trees.get(n, []))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], batch["dims"], batch["asks"], pa.array(cell)], names=["vec_id", "v", "dims", "asks", "cell"])

    return run


def _bytes(x: np.ndarray) -> bytes:
    """As floats of 32 bits where these hold the values, else of 64; a byte tells."""
    low = x.astype(np.float32)
    return b"f" + low.tobytes() if np.array_equal(low, x) else b"d" + np.ascontiguousarray(x, np.float64).tobytes()


def _array(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {b"f": np.float32, b"d": np.float64}[data[:1]], offset=1).reshape(n, -1).astype(np.float64)


_PACKED = "dims int, cell long, part long, n int, ids binary, data binary, low array<double>, high array<double>"


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("vec_id", kind="stable")
    x = np.stack(group["v"].to_numpy()).astype(np.float64)
    box = statistics(x, min(_BOX, x.shape[1]))
    head = group[["dims", "cell", "part"]].iloc[0].tolist()
    return pd.DataFrame([(*head, len(x), np.ascontiguousarray(group["vec_id"].to_numpy(np.int64)).tobytes(), _bytes(x), box.min(0), box.max(0))], columns=[c.split()[0] for c in _PACKED.split(", ")])


def _apart(qi: np.ndarray, di: np.ndarray) -> np.ndarray:
    """The row of di (ascending) with each query's own id, or -1."""
    at = np.minimum(np.searchsorted(di, qi), len(di) - 1)
    return np.where(di[at] == qi, at, -1)


def _radii(k: int):
    """Upper bounds of the squared k-th distance of each query of a tile, from one block near it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                q, d = _array(r.data, r.n), _array(r.d_data, r.d_n)
                qi, di = np.frombuffer(r.ids, np.int64), np.frombuffer(r.d_ids, np.int64)
                i, _, distance, _ = search(q, d, np.full(len(q), np.inf), k, _apart(qi, di))
                order = np.lexsort((distance, i))
                rank = np.arange(len(i)) - np.searchsorted(i[order], i[order])
                out = np.full(len(q), np.inf)
                out[i[order[rank == k - 1]]] = distance[order[rank == k - 1]] ** 2
                rows.append((r.dims, r.tile, r.n, r.ids, r.data, r.low, r.high, float(out.max()), out.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _TILE.split(", ")])

    return run


_TILE = "dims int, tile string, n int, ids binary, data binary, low array<double>, high array<double>, radius double, radii binary"


def _search(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        blocks = group[group["radii"].isna()]
        for b in blocks.itertuples(index=False):
            d, di = _array(b.data, b.n), np.frombuffer(b.ids, np.int64)
            low, high = np.asarray(b.low), np.asarray(b.high)
            for t in group[group["radii"].notna()].itertuples(index=False):
                q, qi, limit = _array(t.data, t.n), np.frombuffer(t.ids, np.int64), np.frombuffer(t.radii, np.float64)
                s = statistics(q, min(_BOX, q.shape[1]))
                gap = np.maximum(np.maximum(low - s, s - high), 0)
                near = np.flatnonzero((gap * gap).sum(1) <= limit * (1 + 1e-9) + 1e-9)
                if len(near):
                    i, j, distance, _ = search(q[near], d, limit[near], k, _apart(qi[near], di))
                    out.append(pd.DataFrame({"vec_id": qi[near][i], "neighbor_id": di[j], "distance": distance}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "neighbor_id": [], "distance": []})

    return run


def meetings(tiles: DataFrame, blocks: DataFrame, parts: int = 64) -> DataFrame:
    """dims, tile, cell, part: the tiles and blocks whose boxes are no farther apart than the tile's greatest
    radius. Blocks are dealt out to `parts`, to each of which the heads of the tiles go."""
    heads = blocks.select("dims", "cell", "part", F.col("low").alias("d_low"), F.col("high").alias("d_high"), F.pmod(F.xxhash64("cell", "part"), F.lit(parts)).alias("deal"))
    asks = tiles.select("dims", "tile", F.col("low").alias("q_low"), F.col("high").alias("q_high"), "radius").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    gap = F.aggregate(
        F.sequence(F.lit(0), F.size("q_low") - 1), F.lit(0.0),
        lambda a, i: a + F.pow(F.greatest(F.lit(0.0), F.get("d_low", i) - F.get("q_high", i), F.get("q_low", i) - F.get("d_high", i)), 2),
    )
    return asks.join(heads, ["dims", "deal"]).where(gap <= F.col("radius") * (1 + 1e-9) + 1e-9).select("dims", "tile", "cell", "part")


def top_k(vectors: DataFrame, k: int = K, queries: Column | None = None, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, rank, neighbor_id, distance: the k nearest others (Euclid), exactly, of every vector for
    which `queries` (a condition on vec_id; by default all) holds.

    Vectors go to cells by a tree over coarse segment statistics, made from a
    bounded sample (SAMPLE) but for all of them, and cells are cut into blocks of
    bounded size, however many equal vectors there are. Queries go in tiles; a
    block of a tile's own cell gives upper bounds of its k-th distances. Tiles meet
    the blocks whose boxes (about statistics of 16 segments) are near enough;
    inside, segment means and deviations bound distances from below, from one
    segment to segments of two, and survivors get their exact distance. Nothing is
    approximate. Where vectors have no structure, bounds take little off and the
    work is that of queries times vectors.

    - Ties in distance (equal to nine decimals) go to the lesser id.
    - Null vectors, empty ones and those with a null, NaN or infinite entry are
      left out, as are null ids. Ids must be integers or cast to them.
    - Vectors of different length don't meet.
    - Of rows that repeat an id the least vector stays. Equal vectors under several ids are each other's neighbours.
    - With fewer than k others, all of them come. An empty table gives no rows.
    - Extra columns are dropped first; very long vectors are compared whole.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)))
    if not v.groupBy("vec_id").count().where("count > 1").isEmpty():
        v = v.groupBy("vec_id").agg(F.min("v").alias("v"))
    v = v.select("vec_id", "v", F.size("v").alias("dims"), (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("asks"))
    few = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().to_pylist()
    n = v.count()
    block = block or min(BLOCK, max(_LEAST_BLOCK, n // _BLOCKS))
    trees = {}
    for dims in {x["dims"] for x in few}:
        x = np.array([x["v"] for x in few if x["dims"] == dims], np.float64)
        trees[dims] = tree(x, min(CELLS, max(1, n * len(x) // len(few) // block), max(1, len(x) // 4)))
    celled = written(v.mapInArrow(_assign(trees), "vec_id long, v array<double>, dims int, asks boolean, cell long"), "cells")

    def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
        many = rows.groupBy("dims", "cell").agg(F.ceil(F.count("*") / size).alias("parts"))
        dealt = rows.join(many, ["dims", "cell"]).select("vec_id", "v", "dims", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"))
        return written(dealt.groupBy("dims", "cell", "part").applyInPandas(_pack, _PACKED), name)

    blocks, asked = packed(celled, block, "blocks"), packed(celled.where("asks"), TILE, "asked")
    drop_written(celled)
    home = blocks.join(blocks.groupBy("dims", "cell").agg(F.min("part").alias("part")), ["dims", "cell", "part"]).select("dims", "cell", F.col("n").alias("d_n"), F.col("ids").alias("d_ids"), F.col("data").alias("d_data"))
    near = asked.withColumn("tile", F.concat_ws("/", "cell", "part")).join(home, ["dims", "cell"])
    tiles = written(near.repartition("dims", "tile").mapInPandas(_radii(k), _TILE), "tiles")
    drop_written(asked)
    groups = -(-tiles.count() * TILE // GROUP) or 1
    pairs = written(meetings(tiles, blocks).withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups))), "pairs")
    columns = ["dims", "cell", "part", "group", "n", "ids", "data", "low", "high", "radii"]
    asks = pairs.join(tiles, ["dims", "tile"]).select(*columns)
    rows = blocks.join(pairs.select("dims", "cell", "part", "group").distinct(), ["dims", "cell", "part"]).withColumn("radii", F.lit(None).cast("binary")).select(*columns)
    found = rows.unionByName(asks).groupBy("dims", "cell", "part", "group").applyInPandas(_search(k), "vec_id long, neighbor_id long, distance double")
    order = Window.partitionBy("vec_id").orderBy(F.round("distance", 9), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"))
