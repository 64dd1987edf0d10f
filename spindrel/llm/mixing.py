"""Mixing sources to target weights by the cube method of balanced sampling."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lookup, row_key, written
from .tokens import mix

TEMPERATURE, BUDGET, BLOCK, SEED = 0.5, 0.6, 4096, 17
_EPS = 1e-9


def _draws(n: int, salt: int) -> np.ndarray:
    return (mix(np.arange(n, dtype=np.uint64), salt % (1 << 62)) >> np.uint64(11)).astype(np.float64) / 2.0**53


def flight(p: np.ndarray, docs: np.ndarray, tokens: np.ndarray, salt: int) -> np.ndarray:
    """The flight phase for two constraints: moves inclusion probabilities until at most two are fractional.

    Three undecided units at a time have a one-dimensional null space of the
    constraints (documents and tokens, each over its probability): the cross
    product. The step along it goes as far as the unit cube allows, up or down
    with chances that keep every probability's expectation. Totals of documents
    and tokens stay as they were, exactly up to rounding.
    """
    p = p.astype(np.float64).copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    p[p <= _EPS], p[p >= 1 - _EPS] = 0.0, 1.0
    if len(open_) < 3:
        return p
    # units in a fixed random order; Python floats are quicker than arrays of three
    order = open_[np.argsort(mix(open_.astype(np.uint64), salt % (1 << 61)), kind="stable")]
    scale = tokens[order].mean() or 1.0
    q, d, t = p[order].tolist(), docs[order].tolist(), (tokens[order] / scale).tolist()
    draws = _draws(len(order) + 3, salt + 1).tolist()
    hand, nxt, n, k = [0, 1, 2], 3, len(order), 0
    while len(hand) == 3:
        i, j, m = hand
        u = d[j] * t[m] - d[m] * t[j]
        v = d[m] * t[i] - d[i] * t[m]
        w = d[i] * t[j] - d[j] * t[i]
        size = max(abs(u), abs(v), abs(w))
        if size < 1e-12:  # units in proportion: any move within the one constraint that is left
            u, v, w = d[j] or t[j], -(d[i] or t[i]), 0.0
            size = max(abs(u), abs(v))
            if size < 1e-12:
                u, v, size = 1.0, 0.0, 1.0
        up = down = 1e300
        for x, z in ((i, u / size), (j, v / size), (m, w / size)):
            if z > 1e-14:
                up, down = min(up, (1 - q[x]) / z), min(down, q[x] / z)
            elif z < -1e-14:
                up, down = min(up, -q[x] / z), min(down, (q[x] - 1) / z)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        hand = []
        for x, z in ((i, u / size), (j, v / size), (m, w / size)):
            q[x] += step * z
            if q[x] <= _EPS:
                q[x] = 0.0
            elif q[x] >= 1 - _EPS:
                q[x] = 1.0
            else:
                hand.append(x)
        while len(hand) < 3 and nxt < n:
            hand.append(nxt)
            nxt += 1
    p[order] = q
    return p


def landing(p: np.ndarray, docs: np.ndarray, tokens: np.ndarray, salt: int) -> np.ndarray:
    """The landing phase: of all ways to decide the few units still open, one at random among those
    that keep their expectations at the least expected miss of the totals."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    draws = _draws(4, salt + 2)
    if len(open_) == 1:
        p[open_] = float(draws[0] < p[open_[0]])
    elif len(open_) == 2:
        a, b = p[open_]
        # the linear program over four outcomes has one free weight, that of both; its cost is linear there
        low, high = max(0.0, a + b - 1), min(a, b)
        da, db = docs[open_] / max(docs[open_].max(), 1e-12), tokens[open_] / max(tokens[open_].max(), 1e-12)

        def miss(x: int, y: int) -> float:
            return (da @ (np.array([x, y]) - [a, b])) ** 2 + (db @ (np.array([x, y]) - [a, b])) ** 2

        both = low if miss(1, 1) + miss(0, 0) >= miss(1, 0) + miss(0, 1) else high
        edges = np.cumsum([both, a - both, b - both])
        x = int(np.searchsorted(edges, draws[1], side="right"))
        p[open_] = [(1, 1), (1, 0), (0, 1), (0, 0)][x]
    return p


def _walk(last: bool, seed: int):
    def walk(batch: pd.DataFrame) -> pd.DataFrame:
        # rows come in any order: sorted by key, a retry decides alike
        batch = batch.sort_values("key", kind="stable", ignore_index=True)
        salt = int(batch["key"].iat[0]) + seed
        p = flight(batch["p"].to_numpy(), batch["docs"].to_numpy(np.float64), batch["tokens"].to_numpy(np.float64), salt)
        if last:
            p = landing(p, batch["docs"].to_numpy(np.float64), batch["tokens"].to_numpy(np.float64), salt)
        batch["p"] = p
        return batch

    return walk


def _blocks(batches_of, seed: int):
    """Runs a function over blocks that come as sorted runs of rows, carrying the last over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            marks = batch["source"].isna().to_numpy().astype(np.int64), batch["source"].fillna("").to_numpy(), batch["block"].to_numpy()
            change = np.flatnonzero((marks[0][1:] != marks[0][:-1]) | (marks[1][1:] != marks[1][:-1]) | (marks[2][1:] != marks[2][:-1])) + 1
            edges = [0, *change.tolist()]
            for a, b in zip(edges, edges[1:]):
                yield batches_of(batch.iloc[a:b].copy())
            rest = batch.iloc[edges[-1] :]
        if rest is not None and len(rest):
            yield batches_of(rest.copy())

    return run


def inclusion(units: DataFrame, targets: Mapping[str, float] | None, temperature: float, budget: float) -> DataFrame:
    """of (the source), n, rate: the share of each source to take.

    Without targets a source's weight is its tokens to the power of temperature.
    The budget is a share of all tokens. Sources that can't fill theirs go whole,
    and what they leave is shared out by weight among the others: over sources in
    order of tokens by weight, a running total decides it.
    """
    by = units.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count("*").alias("n"))
    if targets is None:
        by = by.withColumn("weight", F.pow(F.col("supply"), temperature))
    else:
        known = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
        by = by.withColumn("weight", F.coalesce(F.element_at(known, F.col("source")), F.lit(0.0)).cast("double"))
    # one row per source, so these windows without partitions hold few rows
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("goal", budget * F.sum("supply").over(whole))
    by = by.where("weight > 0 and supply > 0").withColumn("fill", F.col("supply") / F.col("weight"))
    upto = Window.orderBy("fill", "source").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fill", "source").rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("level", (F.col("goal") - F.coalesce(F.sum("supply").over(upto), F.lit(0))) / F.sum("weight").over(onward))
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(whole)["level"]
    by = by.withColumn("least", F.coalesce(first, F.lit(1e300)))
    return by.select(F.col("source").alias("of"), "n", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("least")) / F.col("fill")).alias("rate"))


def sample(
    docs: DataFrame, targets: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET, block: int = BLOCK, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """key, doc_id, source, docs, tokens, rate: the documents drawn, balanced so that the tokens and the
    documents of every source come to its target up to a landing of at most two units.

    Tokens are words between white space. Flights run in blocks of about `block`
    units of one source, set by a hash of the key; the (at most two) units that a
    block leaves open go on to blocks of the next round, until one block per
    source is left, which lands. Rounds grow with the logarithm of the data; text
    moves in none of them.

    - Rows that repeat an id with the same text (and source) are one unit of so
      many documents: they go or stay together. Units are told apart by a 64-bit hash. Ids must be integers or cast to them.
    - Ties (units alike) are decided by the hash of the key. Very long texts count whole. Extra columns are dropped first.
    - A null source is a source of its own name-less kind; with targets its weight is 0.
    - A null or empty text has no tokens; it counts as a document only.
    - A null id is an id. Sources without target or tokens give nothing. An empty table gives no rows.
    """
    tokens = F.coalesce(F.when(F.trim(F.col(text_col)) == "", 0).otherwise(F.size(F.split(F.trim(F.col(text_col)), r"\s+"))), F.lit(0))
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), tokens.cast("long").alias("tokens"))
    units = written(rows.groupBy("key", "source").agg(F.first("doc_id").alias("doc_id"), F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "units")
    rates = inclusion(units, targets, temperature, budget)
    open_ = units.join(rates, F.col("source").eqNullSafe(F.col("of"))).select("source", "key", "doc_id", "docs", "tokens", "rate", F.col("rate").alias("p"), F.ceil(F.col("n") / block).alias("blocks"))
    schema = "source string, block long, key long, doc_id long, docs long, tokens long, rate double, p double, blocks long"
    decided: list[DataFrame] = []
    salt = 0
    while True:
        blocked = open_.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed + salt)), F.col("blocks")))
        last = (open_.agg(F.max("blocks")).first()[0] or 1) <= 1
        runs = blocked.select(*[c.split()[0] for c in schema.split(", ")]).repartition("source", "block").sortWithinPartitions("source", "block", "key")
        moved = written(runs.mapInPandas(_blocks(_walk(last, seed), seed), schema), "flight")
        decided.append(moved.where("p >= 1"))
        if last:
            break
        left = moved.where("p > 0 and p < 1")
        n = left.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
        open_ = left.drop("blocks", "block").join(n, F.col("source").eqNullSafe(F.col("of"))).select("source", "key", "doc_id", "docs", "tokens", "rate", "p", F.ceil(F.col("n") / block).alias("blocks"))
        salt += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("key", "doc_id", "source", "docs", "tokens", "rate")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The rows of docs that sample() draws, whole. Their keys are a written table; hash tables of its
    partitions meet the texts, which move once and are never sorted."""
    drawn = written(sample(docs, id_col=id_col, text_col=text_col, source_col=source_col, **params).select("key", "source"), "chosen")
    key, source = fresh(docs.columns, "__key"), fresh(docs.columns, "__source")
    chosen = drawn.select(F.col("key").alias(key), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias(source))
    keyed = docs.withColumn(key, row_key(id_col, text_col)).withColumn(source, F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")))
    return keyed.join(lookup(chosen, drawn, broadcast=False), [key, source], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
