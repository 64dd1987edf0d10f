"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow
from .tokens import WORD, Words, distinct, mix, slices, spans_hash

SAMPLE = 6000
PASSAGE = 48
VOCABULARY, HIDDEN, ATTENTION = 8192, 24, 12
HEADS = ("quality", "toxic")
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.01, 5
_DENSE = 8


@dataclass
class Encoded:
    """Passages of some texts: vocabulary entries (passage, column), dense features, and first passages of each text."""

    passage: np.ndarray
    column: np.ndarray
    dense: np.ndarray
    first: np.ndarray


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word number and hash: each word, and its first four and five bytes, for words whose endings vary."""
    length = words.end - words.start
    number, value = [np.arange(len(length))], [words.hash]
    for k in (4, 5):
        long = np.flatnonzero(length > k)
        number.append(long)
        value.append(mix(spans_hash(words.data, words.start[long], words.start[long] + k), k))
    return np.concatenate(number), np.concatenate(value)


def encode(texts: pa.Array, vocabulary: np.ndarray) -> Encoded:
    """Cuts every text into passages of PASSAGE words, whole, and encodes each.

    Dense features, by passage: marks per byte, digits per byte, mean length of
    words, share of distinct words, share of words like the one before, marks of
    the commonest non-word byte, log of words, log of bytes per word.
    """
    words = Words(texts)
    n = len(texts)
    counts = np.diff(words.first)
    passages = -(-counts // PASSAGE)
    first = np.concatenate([[0], np.cumsum(passages)])
    of_word = first[words.doc] + (np.arange(len(words.hash)) - words.first[words.doc]) // PASSAGE
    total = int(first[-1])
    if not total:
        return Encoded(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, _DENSE), np.float32), first)
    number, value = _features(words)
    at = np.searchsorted(vocabulary, value)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == value if len(vocabulary) else np.zeros(len(value), bool)
    pair = distinct(of_word[number[hit]] * len(vocabulary) + at[hit]) if len(vocabulary) else np.zeros(0, np.int64)

    begin = np.flatnonzero(np.diff(of_word, prepend=-1))
    size = np.diff(np.append(begin, len(of_word)))
    lo = words.start[begin]
    text = np.flatnonzero(counts)
    lo[first[text]] = words.offsets[text]
    hi = np.append(lo[1:], words.offsets[-1])
    hi[first[text + 1] - 1] = words.offsets[text + 1]
    data = words.data
    mark = ~WORD[data] & (data > 32)
    running = lambda x: np.concatenate([[0], np.cumsum(x)])
    between = lambda x: (lambda c: c[hi] - c[lo])(running(x))
    span = np.maximum(hi - lo, 1)
    by = np.lexsort(((words.hash >> np.uint64(32)).astype(np.uint32), of_word.astype(np.uint32)))
    new = np.ones(len(by), bool)
    new[1:] = (words.hash[by][1:] != words.hash[by][:-1]) | (of_word[by][1:] != of_word[by][:-1])
    first_seen = of_word[by[new]]
    same = np.zeros(len(of_word), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (of_word[1:] == of_word[:-1])
    letters = np.add.reduceat(words.end - words.start, begin)
    dense = np.stack(
        [
            between(mark) / span,
            between((data >= 48) & (data <= 57)) / span,
            letters / size / 10,
            np.bincount(first_seen, minlength=total) / size,
            np.add.reduceat(same, begin, dtype=np.int64) / size,
            between((data == 124) | (data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42)) / span,
            np.log1p(size) / 4,
            np.log(span / size) / 4,
        ],
        axis=1,
    )
    if n and len(pair):
        return Encoded(pair // len(vocabulary), pair % len(vocabulary), dense.astype(np.float32), first)
    return Encoded(np.zeros(0, np.int64), np.zeros(0, np.int64), dense.astype(np.float32), first)


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of about a megabyte, each with the number of its first."""
    at = 0
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        yield at, part["text"]
        at += part.num_rows


def encode_all(texts: pa.Array, vocabulary: np.ndarray) -> Encoded:
    """encode(), run by run, so that memory holds the scratch arrays of one only."""
    parts, base = [encode(pa.array([], pa.string()), vocabulary)], 0
    for _, part in _parts(texts):
        e = encode(part, vocabulary)
        parts.append(Encoded(e.passage + base, e.column, e.dense, e.first[1:] + base))
        base += int(e.first[-1])
    return Encoded(*(np.concatenate([getattr(x, name) for x in parts]) for name in ("passage", "column", "dense", "first")))


def select_vocabulary(texts: pa.Array, labels: np.ndarray, size: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """The `size` features most associated with any label (chi-square over 4, in three texts at least),
    sorted by hash, and their log odds by label."""
    K, tallies = labels.shape[1], []
    for at, part in _parts(texts):
        words = Words(part)
        number, value = _features(words)
        doc = words.doc[number].astype(np.int32)
        order = np.lexsort((doc, value))
        value, doc = value[order], doc[order]
        once = np.ones(len(value), bool)
        once[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[once], doc[once] + at
        if len(value):
            start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            tallies.append((value[start], np.diff(np.append(start, len(value))), *[np.add.reduceat(labels[doc, k], start) for k in range(K)]))
    if not tallies:
        return np.zeros(0, np.uint64), np.zeros((0, K), np.float32)
    value, *counts = (np.concatenate(x) for x in zip(*tallies))
    order = np.argsort(value, kind="stable")
    value = value[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    entries = value[start]
    df, *positive = (np.add.reduceat(x[order], start) for x in counts)
    n = len(labels)
    odds, strength = np.zeros((len(entries), labels.shape[1])), np.zeros(len(entries))
    for k in range(labels.shape[1]):
        pos = positive[k]
        neg, p = df - pos, labels[:, k].sum()
        odds[:, k] = np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (n - p + 1))
        expected = df * p / max(n, 1)
        strength = np.maximum(strength, (pos - expected) ** 2 / np.maximum(expected * (1 - p / max(n, 1)), 1e-9))
    strength[df < 3] = -1
    chosen = np.sort(np.argsort(-strength, kind="stable")[:size])
    chosen = chosen[strength[chosen] > 4]
    return entries[chosen], odds[chosen].astype(np.float32)


@dataclass
class Model:
    """Passage encoder, one gated attention and one score per head."""

    vocabulary: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    weights: dict[str, np.ndarray]
    thresholds: np.ndarray

    def hidden(self, e: Encoded) -> np.ndarray:
        w = self.weights
        h = ((e.dense - self.mean) / self.std) @ w["D"] + w["b"]
        return np.tanh(h + _sums(w["E"][e.column], e.passage, len(h)))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, n x heads, and passages of each text. Texts without words get NaN."""
        e = encode(texts, self.vocabulary)
        count = np.diff(e.first)
        out = np.full((len(count), len(HEADS)), np.nan)
        some = np.flatnonzero(count)
        if len(some):
            h = self.hidden(e)
            for k in range(len(HEADS)):
                a = _attend(h, self.weights, k)[2]
                begin = e.first[some]
                top = np.repeat(np.maximum.reduceat(a, begin), count[some])
                x = np.exp(a - top)
                z = np.add.reduceat(h * x[:, None], begin, axis=0) / np.add.reduceat(x, begin)[:, None]
                out[some, k] = 1 / (1 + np.exp(-(z @ self.weights["c"][k] + self.weights["d"][k])))
        return out, count


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by ascending group numbers below n."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(group):
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        out[group[begin]] = np.add.reduceat(values, begin, axis=0)
    return out


def _attend(h: np.ndarray, w: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, g = np.tanh(h @ w["V"][k]), 1 / (1 + np.exp(-(h @ w["U"][k])))
    return t, g, (t * g) @ w["w"][k]


def gradients(w: dict[str, np.ndarray], row: np.ndarray, column: np.ndarray, d: np.ndarray, sizes: np.ndarray, labels: np.ndarray, share: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (cross entropy, classes weighed alike, meaned over bags and summed over heads) of some bags and its gradients by weight.

    row, column: vocabulary entries of passages, by passage; d: dense features;
    sizes: passages of each bag; share: of each head, the share of positive labels."""
    begin, bags, loss = np.concatenate([[0], np.cumsum(sizes)[:-1]]), len(sizes), 0.0
    h = np.tanh(_sums(w["E"][column], row, len(d)) + d @ w["D"] + w["b"])
    g = {name: np.zeros_like(v) for name, v in w.items()}
    gh = np.zeros_like(h)
    for k in range(labels.shape[1]):
        t, s, score = _attend(h, w, k)
        soft = np.exp(score - np.repeat(np.maximum.reduceat(score, begin), sizes))
        soft /= np.repeat(np.add.reduceat(soft, begin), sizes)
        z = np.add.reduceat(h * soft[:, None], begin, axis=0)
        y = labels[:, k]
        prob = 1 / (1 + np.exp(-(z @ w["c"][k] + w["d"][k])))
        weight = np.where(y == 1, 0.5 / share[k], 0.5 / (1 - share[k])) / bags
        loss -= float((weight * np.log(np.maximum(np.where(y == 1, prob, 1 - prob), 1e-30))).sum())
        gl = ((prob - y) * weight).astype(w["c"].dtype)
        g["c"][k], g["d"][k] = z.T @ gl, gl.sum()
        gz = np.repeat(gl, sizes)[:, None] * w["c"][k]
        along = (gz * h).sum(1)
        gs = soft * (along - np.repeat(np.add.reduceat(soft * along, begin), sizes))
        g["w"][k] = (t * s).T @ gs
        gt, gg = gs[:, None] * w["w"][k] * s * (1 - t * t), gs[:, None] * w["w"][k] * t * s * (1 - s)
        g["V"][k], g["U"][k] = h.T @ gt, h.T @ gg
        gh += soft[:, None] * gz + gt @ w["V"][k].T + gg @ w["U"][k].T
    ga = gh * (1 - h * h)
    by = np.argsort(column, kind="stable")
    g["E"], g["D"], g["b"] = _sums(ga[row[by]], column[by], len(w["E"])), d.T @ ga, ga.sum(0)
    return loss, g


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, size: int = VOCABULARY) -> Model:
    """Learns from texts and their 0/1 labels (columns as HEADS). Same rows, same model.

    Each document is a bag of passages. a_p = w.(tanh(V h_p) * sigmoid(U h_p)) is
    the gated attention; the document is the softmax-weighted sum of its h_p; a
    logistic score of it meets the label. Gradients are written out; Adam steps.
    A fifth of the rows is held out of the steps to set the thresholds.
    """
    rng = np.random.default_rng(seed)
    vocabulary, odds = select_vocabulary(texts, labels, size)
    e = encode_all(texts, vocabulary)
    K, V = len(HEADS), len(vocabulary)
    E = rng.normal(0, 0.02, (V, HIDDEN))
    for k in range(K):
        E[:, k] = 0.5 * odds[:, k]
    w = {
        "E": E, "D": rng.normal(0, 0.3, (_DENSE, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (K, HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (K, HIDDEN, ATTENTION)),
        "w": rng.normal(0, 0.3, (K, ATTENTION)), "c": np.zeros((K, HIDDEN)), "d": np.zeros(K),
    }
    for k in range(K):
        w["c"][k, k] = 1.0
    w = {name: x.astype(np.float32) for name, x in w.items()}
    mean, std = (e.dense.mean(0), e.dense.std(0) + 1e-3) if len(e.dense) else (np.zeros(_DENSE), np.ones(_DENSE))
    model = Model(vocabulary, mean.astype(np.float32), std.astype(np.float32), w, np.full(K, 0.5))
    usable = np.flatnonzero(np.diff(e.first))
    held = usable[rng.random(len(usable)) < 0.2]
    fit = np.setdiff1d(usable, held)
    if not len(fit):
        return model
    dense = (e.dense - model.mean) / model.std
    entry = np.searchsorted(e.passage, np.arange(e.first[-1] + 1))
    share = np.clip(labels[fit].mean(0), 0.02, 0.98)
    m1, m2 = ({name: np.zeros_like(x) for name, x in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for a in range(0, len(order), BATCH):
            bag = order[a : a + BATCH]
            sizes = e.first[bag + 1] - e.first[bag]
            p = np.concatenate([np.arange(e.first[i], e.first[i + 1]) for i in bag])
            much = entry[p + 1] - entry[p]
            row = np.repeat(np.arange(len(p)), much)
            column = e.column[np.repeat(entry[p] - np.cumsum(much) + much, much) + np.arange(len(row))]
            _, g = gradients(w, row, column, dense[p], sizes, labels[bag], share)
            step += 1
            for name in w:
                m1[name] += 0.1 * (g[name] - m1[name])
                m2[name] += 0.001 * (g[name] ** 2 - m2[name])
                w[name] -= (RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    if len(held):
        scores = np.concatenate([model.score(part)[0] for _, part in _parts(texts.take(pa.array(held)))])
        for k in range(K):
            model.thresholds[k] = _threshold(scores[:, k], labels[held, k])
    return model


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Between the classes where balanced accuracy is best, as near 0.5 as that allows."""
    if labels.min() == labels.max():
        return 0.5
    grid = np.linspace(0.05, 0.95, 91)
    right = [((scores >= t)[labels == 1].mean() + (scores < t)[labels == 0].mean()) - 0.01 * abs(t - 0.5) for t in grid]
    return float(grid[int(np.argmax(right))])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Array, np.ndarray]:
    """At most `most` labelled rows, those of least hash of the id, in its order: the same
    ones however the tables are laid out. Rows with a null label or text, or of an id with labels that differ, are left out."""
    clean = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(h).cast("int").alias(h) for h in HEADS]).dropna()
    clean = clean.groupBy("doc_id").agg(*[F.min(h).alias(h) for h in HEADS], *[F.max(h).alias(f"{h}_max") for h in HEADS])
    clean = clean.where(" and ".join(f"{h} = {h}_max and {h} in (0, 1)" for h in HEADS)).select("doc_id", *HEADS)
    # ids first, so that only the texts drawn move
    ids = clean.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = narrow(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").where("text is not null").dropDuplicates(["doc_id", "key"])
    # an id may have many texts
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(most).select("doc_id", "text", *HEADS).toArrow()
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(t) for t in rows["text"].to_pylist()], np.uint64), rows["doc_id"].to_numpy())) if rows.num_rows else np.zeros(0, np.int64)
    rows = rows.take(pa.array(order))
    return rows["text"].combine_chunks(), np.stack([rows[h].to_numpy() for h in HEADS], axis=1).astype(np.float32)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out, count = model.score(part["text"])
                accepted = (out[:, 0] >= model.thresholds[0]) & (out[:, 1] < model.thresholds[1])
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["doc_id"], pa.array(count.astype(np.int32)), *[pa.array(out[:, k], from_pandas=True) for k in range(len(HEADS))], pa.array(accepted)],
                    names=["key", "doc_id", "n_passages", "quality_score", "toxic_score", "accepted"],
                )

    return score


SCORES = "key long, doc_id long, n_passages int, quality_score double, toxic_score double, accepted boolean"


def score_documents(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """key, doc_id, n_passages, quality_score, toxic_score, accepted, for every row of docs.

    One model is trained per call, on the driver, from a sample of labelled rows
    bounded by `most`, whole texts; it knows at most `vocabulary` features (words and
    beginnings of words most associated with a label, in three texts at least), and
    they and its weights (under 2 MB) go out with the tasks. Scoring is one pass
    without a shuffle. Accepted are documents at or
    over the threshold of quality and under that of toxicity.

    - A null or empty text, or one without words, has no passages and null
      scores, and isn't accepted.
    - All passages of a text count, however long it is.
    - Repeated rows are scored alike, and ties in score alike. A null id is kept. Ids must be integers or cast to them.
    - Extra columns are dropped first; accept() returns them as they are.
    - Labels of ids that docs don't have, null labels and labels that contradict
      each other are left out; without any labels scores are those of the
      untrained model and mean nothing, so every text with words is accepted.
    - An empty table gives no rows.
    """
    texts, y = labelled_sample(docs, labels, most, id_col, text_col)
    model = train(texts, y, size=vocabulary)
    if not len(y):
        model.thresholds[:] = 0.0, 2.0
    return narrow(docs, id_col, text_col).mapInArrow(_scorer(model), SCORES)


def accept(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """The rows of docs, whole, that the classifier accepts; nulls and ties as in score_documents().

    Rows pass through the scoring task as they are, so that nothing is joined."""
    texts, y = labelled_sample(docs, labels, most, id_col, text_col)
    model = train(texts, y, size=vocabulary)
    if not len(y):
        model.thresholds[:] = 0.0, 2.0

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                out, _ = model.score(part[text_col])
                yield part.filter(pa.array((out[:, 0] >= model.thresholds[0]) & (out[:, 1] < model.thresholds[1])))

    return docs.mapInArrow(keep, docs.schema)
