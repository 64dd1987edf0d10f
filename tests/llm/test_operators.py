"""The ten operators on small tables: brute force, planted cases, and odd rows."""

import math
import random
import time
import uuid
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrel.llm import chain_dedup, quality, suffix_dedup, topk
from spindrel.llm.chain_dedup import align, chains, common, fuzzy_passages, passages
from spindrel.llm.decontaminate import contaminated, decontaminate, local_alignment
from spindrel.llm.html_extract import Dom, densities, extract, extract_main_text
from spindrel.llm.line_dedup import line_dedup
from spindrel.llm.mixing import flight, landing, mixed, sample
from spindrel.llm.pii import find, find_pii, luhn
from spindrel.llm.simhash import _prints, grid, near_dedup, near_duplicates, near_pairs
from spindrel.llm.suffix_dedup import repeated, repeated_passages, suffix_array
from spindrel.llm.tokens import Words
from spindrel.llm.topk import top_k

SCHEMA = "doc_id long, text string, source string, key string, n string, gram int, cell int, __key int, at string, lang string, n_removed int"
rng = random.Random(4)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]


def prose(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def docs(spark, rows):
    """Rows of (id, text) with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "web" if (i or 0) % 2 else None, "k", "n", 1, 2, 3, "at", "en", 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    twice = (3, prose(80, 1))
    return docs(spark, [(None, prose(60, 2)), (1, None), (2, ""), twice, twice, (4, prose(20_000, 5)), (5, "..., !!"), (6, "ä\n\n\n"), (7, prose(60, 2))])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(3, 0, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")


def operators(spark, labels, benchmark):
    return {
        "quality": lambda d: quality.score_documents(d, labels), "accept": lambda d: quality.accept(d, labels), "mix": sample, "mixed": mixed, "pii": find_pii, "leaks": lambda d: contaminated(d, benchmark),
        "clean": lambda d: decontaminate(d, benchmark), "suffix": repeated_passages, "near": near_duplicates, "near_dedup": near_dedup, "lines": line_dedup, "chain": fuzzy_passages,
    }


@pytest.mark.parametrize("name", ["quality", "accept", "mix", "mixed", "pii", "leaks", "clean", "suffix", "near", "near_dedup", "lines", "chain"])
def test_odd_and_empty_tables(spark, odd, labels, name):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, prose(60, 2)), (3, prose(60, 2))], "item_id long, text string")
    f = operators(spark, labels, benchmark)[name]
    assert f(odd.limit(0)).count() == 0
    got = f(odd)
    if name in ("accept", "mixed", "clean", "near_dedup"):
        assert got.columns == odd.columns
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    if name == "clean":
        assert sorted(i for i in ids if i) == [1, 2, 3, 3, 4, 5, 6] and None not in ids
    if name == "near_dedup":  # the copy with an id stays, the repeated row goes
        assert sorted(ids) == [1, 2, 3, 4, 5, 6, 7]
    if name == "suffix":
        assert sorted((i or 0, r.start_word, r.end_word) for i, r in zip(ids, rows)) == [(0, 0, 60), (7, 0, 60)]
    if name == "lines":
        assert len(rows) == 9 and "n_removed_" in got.columns and {r["n_removed_"] for r in rows} == {0}
        assert sorted(r.text or "" for r in rows) == sorted(r.text or "" for r in odd.collect())
    if name == "quality":
        assert len(rows) == 9 and {r.quality_score for r in rows if r.doc_id in (1, 2, 5)} == {None}
        assert {r.n_passages for r in rows if r.doc_id == 3} == {2} and {r.n_passages for r in rows if r.doc_id == 4} == {417}
        assert not any(r.accepted for r in rows if r.doc_id in (1, 2, 5))
    if name == "accept":
        assert not set(ids) & {1, 2, 5} and ids.count(3) in (0, 2)
    if name in ("mix", "mixed"):
        assert set(ids) <= {None, 1, 2, 3, 4, 5, 6, 7}
    if name == "mix":  # a repeated row is one unit of two documents
        assert len(set(ids)) == len(ids) and {r.docs for r in rows if r.doc_id == 3} <= {2}
        assert {r.tokens for r in rows if r.doc_id == 4} <= {20_000}
    if name == "mixed":
        assert ids.count(3) in (0, 2)
    if name == "pii":
        assert rows == []
    if name == "leaks":
        assert sorted((i or 0, r.item_id, r.score, r.start_word, r.end_word) for i, r in zip(ids, rows)) == [(0, 3, 1.0, 0, 60), (7, 3, 1.0, 0, 60)]
    if name == "near":
        assert [(r.doc_id, r.kept_id, r.links) for r in rows] == [(None, 7, 1)]
    if name == "chain":
        assert sorted((i or 0, r.start_word, r.end_word, r.other_id or 0, r.identity) for i, r in zip(ids, rows)) == [(0, 0, 60, 7, 1.0), (7, 0, 60, 0, 1.0)]


def test_empty_side_tables(spark, odd, labels):
    assert decontaminate(odd, spark.createDataFrame([], "item_id long, text string")).count() == 9
    assert {r.doc_id for r in quality.accept(odd, labels.limit(0)).collect()} == {None, 3, 4, 6, 7}


def test_classifier_on_held_out_texts():
    bad = ["".join(random.Random(k).choices("qwxyz", k=5)) for k in range(40)]
    texts, y = [], []
    for k in range(600):
        r, toxic = random.Random(k), k % 3 == 0
        words = prose(r.randint(60, 400), 1000 + k).split()
        if toxic:  # one passage alone tells
            at = r.randrange(len(words) - 20)
            words[at : at + 15] = r.choices(bad, k=15)
        texts.append(" ".join(words))
        y.append((0 if toxic else 1, int(toxic)))
    labels = np.array(y, np.float32)
    model = quality.train(pa.array(texts[:400]), labels[:400])
    again = quality.train(pa.array(texts[:400]), labels[:400])
    scores, _ = model.score(pa.array(texts[400:]))
    assert ((scores[:, 1] >= model.thresholds[1]) == labels[400:, 1]).mean() > 0.95
    assert np.array_equal(scores, again.score(pa.array(texts[400:]))[0])


def test_gradients_against_differences():
    r = np.random.default_rng(3)
    shapes = {"E": (6, 4), "D": (8, 4), "b": (4,), "V": (2, 4, 3), "U": (2, 4, 3), "w": (2, 3), "c": (2, 4), "d": (2,)}
    w = {name: r.normal(0, 0.5, shape) for name, shape in shapes.items()}
    sizes = np.array([3, 1, 4])
    row, column = np.array([0, 0, 2, 3, 4, 4, 7]), np.array([1, 4, 1, 0, 5, 1, 3])
    batch = (row, column, r.normal(size=(8, 8)), sizes, np.array([[1, 0], [0, 1], [1, 1]], float), np.array([0.6, 0.3]))
    loss, g = quality.gradients(w, *batch)

    def by_loops():  # the forward pass, passage by passage
        total, first = 0.0, 0
        for bag, n in enumerate(sizes):
            h = [np.tanh(sum((w["E"][c] for x, c in zip(row, column) if x == p), np.zeros(4)) + batch[2][p] @ w["D"] + w["b"]) for p in range(first, first + n)]
            first += n
            for k in range(2):
                a = [math.exp(w["w"][k] @ (np.tanh(x @ w["V"][k]) / (1 + np.exp(-(x @ w["U"][k]))))) for x in h]
                z = sum(x * y for x, y in zip(a, h)) / sum(a)
                prob, y, share = 1 / (1 + math.exp(-(z @ w["c"][k] + w["d"][k]))), batch[4][bag, k], batch[5][k]
                total -= (0.5 / share * math.log(prob) if y else 0.5 / (1 - share) * math.log(1 - prob)) / len(sizes)
        return total

    assert abs(loss - by_loops()) < 1e-9
    for name, x in w.items():
        for at in np.ndindex(x.shape):
            old = x[at]
            x[at] = old + 1e-5
            up = by_loops()
            x[at] = old - 1e-5
            down = by_loops()
            x[at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-7, (name, at)


def test_scores_against_a_forward_pass_by_loops():
    texts = [prose(n, n) for n in (5, 48, 49, 200)]
    model = quality.train(pa.array(texts * 5), np.array([[1, 0], [0, 1], [1, 1], [0, 0]] * 5, np.float32), epochs=2)
    scores, count = model.score(pa.array([*texts, "", None]))
    assert count.tolist() == [1, 1, 2, 5, 0, 0] and np.isnan(scores[4:]).all()
    e = quality.encode(pa.array(texts), model.vocabulary)
    w = model.weights
    for i in range(4):
        h = []
        for p in range(e.first[i], e.first[i + 1]):
            x = ((e.dense[p] - model.mean) / model.std) @ w["D"] + w["b"]
            h.append(np.tanh(x + sum((w["E"][c] for q, c in zip(e.passage, e.column) if q == p), np.zeros_like(x))))
        for k in range(2):
            a = [math.exp(w["w"][k] @ (np.tanh(x @ w["V"][k]) / (1 + np.exp(-(x @ w["U"][k]))))) for x in h]
            z = sum(x * y for x, y in zip(a, h)) / sum(a)
            assert abs(scores[i, k] - 1 / (1 + math.exp(-(z @ w["c"][k] + w["d"][k])))) < 1e-4


def test_the_labelled_sample_is_bounded_by_rows(spark):
    many = docs(spark, [(1, prose(20, k)) for k in range(60)] + [(2, prose(20, 99))])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    texts, y = quality.labelled_sample(many, labels, 10)
    assert len(texts) == len(y) == 10
    assert len(quality.labelled_sample(many, labels, 1000)[0]) == 61


def test_main_text_of_pages(spark):
    main = "".join(f"<p>{prose(40, k)}</p>" for k in range(4))
    menu = "<ul>" + "".join(f'<li><a href="/{k}">go {k}</a></li>' for k in range(30)) + "</ul>"
    rows = [(1, f"<html><body><div>{menu}</div><div>{main}</div></body></html>"), (2, None), (3, ""), (4, "plain words"), (5, f"<body><div><p>{prose(30, 9)}<p>{prose(30, 8)}")]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert prose(40, 2) in got[1] and "go 3" not in got[1]
    assert got[2] is None and got[3] == "" and got[4] == "plain words" and prose(30, 9) in got[5]


def test_every_section_of_an_article():
    texts = [prose(43, 60 + k) for k in range(9)]
    first, second = ("".join(f"<p>{x}</p>" for x in part) for part in (texts[:5], texts[5:]))
    menu = "<nav>" + "".join(f'<a href="/{k}">go {k}</a>' for k in range(30)) + "</nav>"
    got = extract(f"<body>{menu}<article><section>{first}</section><section>{second}</section></article></body>")[0]
    assert got == "\n".join(texts)
    nested = extract(f"<body>{menu}<div><article><section>{first}</section><div><section>{second}</section></div></article></div></body>")[0]
    assert nested == "\n".join(texts)


def test_personal_data(spark):
    text = "Ask jo.doe+x@mail.example.org or see https://site.test/a?b=1, from 10.0.0.254 not 10.0.0.999; card 4111 1111 1111 1111, not 4111 1111 1111 1112; IBAN DE89 3704 0044 0532 0130 00."
    got = {(r.kind, r.value) for r in find_pii(docs(spark, [(1, text)])).collect()}
    assert {("email", "jo.doe+x@mail.example.org"), ("ip", "10.0.0.254"), ("card", "4111 1111 1111 1111"), ("account", "DE89 3704 0044 0532 0130 00")} <= got
    assert not any("999" in v or v.endswith("1112") for _, v in got)
    assert find_pii(docs(spark, [(1, prose(500, 3) + " at 5 @ home, 3.14, 1999.")])).count() == 0


def test_densities_against_recursion():
    def made(r, depth):
        tag = r.choice(("div", "section", "b", "a", "span", "i"))
        inside = "".join(r.choice((lambda: made(r, depth + 1), lambda: "word " * r.randrange(1, 9)))() for _ in range(r.randrange(4) if depth < 6 else 0))
        return f"<{tag}>{inside}</{tag}>"

    def count(node, linked):
        linked = linked or node.tag == "a"
        own = len(node.text or "") + sum(len(x.tail or "") for x in node)
        parts = [count(x, linked) for x in node]
        c, lc = own + sum(x[0] for x in parts), (own if linked else 0) + sum(x[2] for x in parts)
        t, lt = sum(x[1] + 1 for x in parts), sum(x[3] + (1 if x[4] else 0) for x in parts)
        return c, t, lc, lt, linked, [(c, t, lc, lt), *[y for x in parts for y in x[5]]]

    for seed in range(60):
        r = random.Random(seed)
        page = "<body>" + "".join(made(r, 0) for _ in range(3)) + "</body>"
        body = ElementTree.fromstring(page)
        rows = count(body, False)[5]
        c_body, _, lc_body, _ = rows[0]
        want = []
        for c, t, lc, lt in rows:
            base = math.log(c / max(c - lc, 1) * lc + lc_body / max(c_body, 1) * c + math.e)
            want.append(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / (math.log(base) if base > 1 else 1) if c else 0)
        of = dict(zip(body.iter(), want))
        sums = [sum(of[x] for x in node) for node in body.iter()]
        density, total, number = densities(Dom(page))
        assert np.allclose(density[number:], want) and np.allclose(total[number:], sums)


@pytest.mark.parametrize("bad", ["<a ", "<a \">\"", "<", "<!", "<td>", "<b>", "x", "<p><b>", "&"])
def test_broken_pages_take_linear_time(bad):
    began = time.perf_counter()
    extract(bad * (1_000_000 // len(bad)))
    extract("<div>" * 100_000 + "</x>" * 100_000)
    extract("<li><ul>" + "<b>" * 80_000 + "<li></li>" * 80_000)
    extract("<p>" + "<b>" * 80_000 + "<div></div>" * 80_000)
    assert time.perf_counter() - began < 15


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>3 < 4 &amp; 5</p>"), (3, "<p>3 < 4 &amp; 5</p>"), (None, "<div>" * 5000 + "deep"), (5, "<p>ties</p><p>ties</p>"), (6, "cut off <a href='x")]
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id long, html string, text string, n_nodes int, threshold int")
    got = extract_main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text or "") for r in got) == [(0, "deep"), (1, ""), (2, ""), (3, "3 < 4 & 5"), (3, "3 < 4 & 5"), (5, "ties\nties"), (6, "cut off <a href='x")]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_planted_personal_data_is_all_that_is_found():
    """Texts of known findings and near misses between plain words, in any order."""
    digits = lambda r, n: "".join(r.choice("123456789") for _ in range(n))

    def card(r):
        head = "4" + digits(r, 14)
        return next(head + d for d in "0123456789" if luhn(head + d))

    good = [
        ("email", lambda r: f"jo.{digits(r, 3)}@mail{digits(r, 2)}.example.org"), ("ip", lambda r: ".".join(str(r.randrange(256)) for _ in range(4))), ("card", card), ("ssn", lambda r: f"{r.choice('12345')}{digits(r, 2)}-{digits(r, 2)}-{digits(r, 4)}"),
        ("phone", lambda r: f"+{digits(r, 2)} {digits(r, 3)} {digits(r, 3)} {digits(r, 4)}"), ("phone", lambda r: f"({digits(r, 3)}) {digits(r, 3)}-{digits(r, 4)}"), ("url", lambda r: f"https://a{digits(r, 3)}.example/x?y={digits(r, 2)}"),
        ("account", lambda r: "DE89 3704 0044 0532 0130 00"), ("secret", lambda r: f"AKIA{digits(r, 16)}"),
    ]
    bad = [lambda r: f"{digits(r, 3)}.{digits(r, 2)}", lambda r: "300.1.2.3", lambda r: "000-12-3456", lambda r: "a @ b", lambda r: "x@y", lambda r: "http://", lambda r: digits(r, 12), lambda r: "DE00 3704 0044 0532 0130 00"[:-1], lambda r: "19.5 %"]
    for seed in range(150):
        r = random.Random(seed)
        text, want = "", []
        for _ in range(r.randrange(12)):
            text += " ".join(r.choices(VOCABULARY, k=3)) + " : "
            if r.random() < 0.6:
                kind, make = r.choice(good)
                value = make(r)
                want.append((kind, value))
            else:
                value = r.choice(bad)(r)
            text += value + " ; "
        assert [(k, text[a:b]) for k, a, b in find(text)] == want


@pytest.mark.parametrize("bad", ["12", "1 ", "1.2.", "http://", "a://", "www.a;", "password=", "account", "a@a.", "@", "(1", "+1 2", "+", "token:'", "x@b."])
def test_hostile_texts_take_linear_time(bad):
    began = time.perf_counter()
    find(bad * (1_000_000 // len(bad)))
    find("http://a" + ")" * 500_000)
    assert time.perf_counter() - began < 8


def test_cues_in_any_case_and_long_schemes():
    of = lambda x: [(k, x[a:b]) for k, a, b in find(x)]
    assert of("PassWord=abc123xyz") == of("API_Key: abc123xyz") == [("secret", "abc123xyz")]
    assert of("password=correcthorse; password: please wait") == [("secret", "correcthorse")]
    assert of("İİ jo@bücher.example") == [("email", "jo@bücher.example")]
    assert of("averyveryverylongscheme+x://host.example/y") == [("url", "averyveryverylongscheme+x://host.example/y")]


def test_alignment_against_the_full_matrix():
    for seed in range(30):
        r = np.random.default_rng(seed)
        a, b = r.integers(0, 4, 12), r.integers(0, 4, 25)
        h = np.zeros((13, 26), int)
        for i in range(12):
            for j in range(25):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert local_alignment(a, b)[0] == h.max()


def test_leaks_are_found_and_clean_texts_kept(spark):
    items = [(k, prose(40, 100 + k)) for k in range(5)]
    edited = items[1][1].split()
    edited[5], edited[20], edited[33] = "other", "words", "here"
    rows = [(k, prose(200, k)) for k in range(20)] + [(50, prose(50, 51) + " " + items[0][1] + " " + prose(50, 52)), (51, prose(30, 53) + " " + " ".join(edited).upper())]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for most in (2_000_000, 0):
        got = contaminated(docs(spark, rows), benchmark, broadcast_grams=most)
        assert sorted((r.doc_id, r.item_id, r.start_word) for r in got.collect()) == [(50, 0, 50), (51, 1, 30)]


def test_leaks_against_every_alignment(spark):
    """Seeds, scores and places of the whole operator, by counting and by full tables, for items of unlike length."""
    items = [(k, prose(n, 300 + k)) for k, n in enumerate((8, 30, 30, 90, 200))]
    items[2] = (2, items[1][1][: len(items[1][1]) // 2] + " " + prose(15, 777))  # shares half of its words with another
    rows = []
    for k in range(60):
        r = random.Random(k)
        words = prose(r.randint(30, 120), 500 + k).split()
        if k % 2:
            item = r.choice(items)[1].split()
            piece = [w if r.random() > (k % 5) / 12 else r.choice(VOCABULARY) for w in item]
            at = r.randrange(len(words))
            words[at:at] = piece
        rows.append((k, " ".join(words)))
    grams = lambda t: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    df: dict = {}
    for _, t in rows:
        for g in grams(t):
            df[g] = df.get(g, 0) + 1
    want = set()
    for item, text in items:
        seen = sorted(df[g] for g in grams(text) if g in df)
        seeds = {g for g in grams(text) if g in df and (df[g] <= 0.06 or len(seen) == 1 or seen.index(df[g]) / (len(seen) - 1) <= 0.5)}
        for k, t in rows:
            if seeds & grams(t):
                a, b = text.split(), t.split()
                h = np.zeros((len(a) + 1, len(b) + 1), int)
                for i, x in enumerate(a):
                    for j, y in enumerate(b):
                        h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
                if h.max() >= len(a):
                    want.add((k, item, int(h.max()), int(h.max(axis=0).argmax())))
    for most in (2_000_000, 0):
        got = contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_grams=most).collect()
        assert {(r.doc_id, r.item_id, round(r.score * 2 * len(items[r.item_id][1].split())), r.end_word) for r in got} == want and len(want) > 20


def test_suffixes_against_sorting():
    for seed in range(60):
        r = random.Random(seed)
        x = [r.randrange(r.choice((1, 2, 5))) for _ in range(r.randrange(60))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])
    texts = [np.random.default_rng(k).integers(0, 2, 40, dtype=np.uint64) for k in range(3)]
    for text, runs in zip(texts, repeated(texts, 6)):
        seen = [bytes(t[i : i + 6]) for t in texts for i in range(35)]
        want = [i for i in range(35) if seen.count(bytes(text[i : i + 6])) > 1]
        assert sorted(i for a, b in runs for i in range(a, b + 1)) == want


@pytest.mark.parametrize("block", [400_000, 40])
def test_every_pair_within_the_radius(spark, block):
    r = np.random.default_rng(3)
    bits = list(r.integers(0, 2, (164, 256)))
    for k in range(164):  # four pairs at each distance of 1..41
        other = bits[k].copy()
        other[r.choice(256, k % 41 + 1, replace=False)] ^= 1
        bits.append(other)
    bits += list((r.random((60, 256)) < 0.06).astype(int)) + list((r.random((60, 256)) < 0.94).astype(int))  # far corners of the grid
    prints = np.packbits(np.array(bits, np.uint8), axis=1).view(np.int64)
    far = (np.array(bits)[:, None] != np.array(bits)[None]).sum(axis=2)
    nodes = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints)], "node long, f0 long, f1 long, f2 long, f3 long")
    for radius in (0, 5, 40, 60):
        got = [(x.a, x.b) for x in near_pairs(nodes, radius, block).collect()]
        assert sorted(got) == [(i, j) for i in range(448) for j in range(i + 1, 448) if far[i, j] <= radius]
    assert near_pairs(nodes.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 17, 300])
def test_repeated_passages_against_all_windows(spark, most):
    """A header before different texts, passages that overlap, copies; with a small limit the header's group is crowded."""
    header, one, two = prose(55, 1), prose(70, 2), prose(52, 3)
    rows = [(k, f"{header} {prose(30, 10 + k)}") for k in range(40)] + [(50, f"{prose(20, 60)} {one} {prose(9, 61)} {two}"), (51, f"{one} {two}"), (52, f"{two} {prose(3, 62)} {one}"), (53, f"{one} {two}"), (54, prose(100, 63)), (55, "spam " * 120)]
    seen: dict = {}
    for k, t in rows:
        words = t.split()
        for i in range(len(words) - 49):
            seen.setdefault(tuple(words[i : i + 50]), []).append((k, i))
    covered: dict = {}
    for places in seen.values():
        for k, i in places if len(places) > 1 else []:
            covered.setdefault(k, set()).update(range(i, i + 50))
    want = {(k, w) for k, x in covered.items() for w in x}
    got = repeated_passages(docs(spark, rows), most=most).collect()
    assert {(r.doc_id, w) for r in got for w in range(r.start_word, r.end_word)} == want and len(want) > 2500


def test_texts_go_to_python_in_small_batches(spark, monkeypatch, tmp_path):
    """op6: a partition of 20 MB isn't one batch, and the session's own limit is back afterwards."""
    real, name = suffix_dedup._fetch, "spark.sql.execution.arrow.maxBytesPerBatch"

    def spied(length):
        fetch = real(length)

        def run(batches):
            def seen():
                for batch in batches:
                    (tmp_path / uuid.uuid4().hex).write_text(str(batch.nbytes))
                    yield batch

            yield from fetch(seen())

        return run

    monkeypatch.setattr(suffix_dedup, "_fetch", spied)
    same = prose(60, 1)
    rows = [(k, f"{same} {prose(30, k)} " + "x" * 230_000) for k in range(100)]
    before = spark.conf.get(name, None)
    assert repeated_passages(docs(spark, rows).coalesce(1)).count() == 100 and spark.conf.get(name, None) == before
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(sizes) > 20_000_000 and max(sizes) < 4_000_000, sizes


def test_bit_counts_bound_the_distance_and_cells_prune():
    r = np.random.default_rng(4)
    prints = r.integers(0, 2**32, (400, 8), dtype=np.uint32)
    counts = np.bitwise_count(prints).astype(int)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    assert (np.abs(counts[:, None] - counts[None]).sum(axis=2) <= apart).all()
    splits = grid(np.concatenate([counts // 8, counts // 8 + 20]), 8)
    assert len(splits) == 7 and splits[0][1] in range(5, 25)  # the middle of two crowds


def test_groups_and_links_against_all_pairs(spark):
    texts = []
    for k in range(60):
        words = prose(120, 300 + k).split()
        for e in range(k % 5):  # further and further from the first
            words[7 * e : 7 * e + 6] = [f"e{k}x{e}x{i}" for i in range(6)]
            texts.append(" ".join(words))
        texts.append(prose(120, 300 + k).upper())
    rows = list(enumerate(texts))
    prints = _prints(Words(pa.array(texts)), len(texts))
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 40
    least = np.arange(len(texts))
    for _ in texts:
        least = np.array([least[near[i]].min() for i in range(len(texts))])
    want = {(i, int(least[i]), int(near[i].sum()) - 1) for i in range(len(texts)) if least[i] != i}
    assert len(want) > 60 and {(r.doc_id, r.kept_id, r.links) for r in near_duplicates(docs(spark, rows)).collect()} == want


@pytest.mark.parametrize("n", [20_000, 100_000])
def test_long_unrelated_texts_are_far_apart(n):
    one, other = (" ".join(f"{side}{k}" for k in range(n)) for side in "ab")
    short = prose(50, 3)
    prints = np.concatenate([_prints(Words(pa.array(x)), len(x)) for x in ([one, short], [other, one], [short])])
    assert np.array_equal(prints[0], prints[3]) and np.array_equal(prints[1], prints[4])
    assert 90 < np.bitwise_count(prints[0] ^ prints[2]).sum() < 166


def test_near_copies_form_groups(spark):
    base = prose(300, 77)
    words = base.split()
    words[10] = "changed"
    rows = [(k, prose(300, k)) for k in range(20)] + [(30, base), (31, " ".join(words)), (32, base.upper())]
    assert sorted((r.doc_id, r.kept_id) for r in near_duplicates(docs(spark, rows)).collect()) == [(31, 30), (32, 30)]


def test_lines_of_later_windows_go(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\n\nc\nd\ny"), (3, "a\nb\nc\nd"), (4, "a\nb")]
    got = {r.doc_id: (r.text, r["n_removed_"]) for r in line_dedup(docs(spark, rows)).collect()}
    assert got == {1: ("a\nb\nc\nd", 0), 2: ("x\n\ny", 3), 3: ("", 4), 4: ("a\nb", 0)}


def nearest(rows, k, asks=lambda i: True):
    """vec_id: its nearest others, by all distances; rows of (id, vector)."""
    out = {}
    for i, v in rows:
        if asks(i):
            others = sorted((round(math.dist(v, w), 9), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = [j for _, j in others[:k]]
    return out


def neighbours(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbor_id
    return {i: [x[k] for k in range(1, len(x) + 1)] for i, x in got.items()}


@pytest.mark.parametrize("block", [None, 16])
def test_neighbours_against_all_distances(spark, block):
    r = np.random.default_rng(8)
    x = r.normal(size=(150, 16)).round(3)
    x[7] = x[3]
    x[20:60] = x[20]  # more equal vectors than a block holds: ties go to the lesser id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300 + i, v.tolist()) for i, v in enumerate(r.normal(size=(12, 3)).round(3))] + [(400, [1.0])]
    odd = [(None, x[0].tolist()), (200, None), (201, []), (202, [math.nan] * 16), (203, [1.0, None]), (204, [math.inf] * 16)]
    data = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows + odd + rows[:3]], "vec_id long, embedding array<double>, cell string, part int, dims double")
    assert neighbours(top_k(data, 5, block=block)) == {i: v for i, v in nearest(rows, 5).items() if v}
    few = top_k(data, 5, F.col("vec_id") % 10 == 0, block)
    assert neighbours(few) == {i: v for i, v in nearest(rows, 5, lambda i: i % 10 == 0).items() if v}
    assert top_k(data.limit(0)).count() == 0


def test_of_rows_with_one_id_the_least_vector_stays(spark):
    data = spark.createDataFrame([(1, [5.0, 5.0]), (1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 4.0])], "vec_id long, embedding array<float>")
    assert neighbours(top_k(data, 1)) == {1: [2], 2: [1], 3: [2]}


def test_levels_and_boxes_prune_where_vectors_have_clusters(spark):
    r = np.random.default_rng(5)
    # smooth curves, as segment statistics see them, about 40 centres
    centres = np.cumsum(r.normal(size=(40, 64)), axis=1) * 3
    x = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 64)) * 0.1
    q = x[::20]
    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))
    limit = np.sort(d, axis=1)[:, 20] ** 2
    i, j, distance, exact = topk.search(q, x, limit, 10)
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    for row in range(len(q)):
        mine = np.flatnonzero(i == row)
        assert set(want[row]) <= set(j[mine]) and np.allclose(np.sort(distance[mine])[:10], np.sort(d[row])[:10], atol=1e-5)
    assert exact < 0.1 * d.size
    seen = []
    whole = topk.meetings
    try:
        topk.meetings = lambda tiles, blocks: (seen.append((tiles.count() * blocks.count(), whole(tiles, blocks).count())), whole(tiles, blocks))[1]
        got = neighbours(top_k(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), 10, F.col("vec_id") % 20 == 0, 64))
    finally:
        topk.meetings = whole
    full = np.argsort(np.where(d < 1e-4, -1, d), axis=1, kind="stable")[:, 1:11]
    assert all(set(got[20 * row]) == set(full[row]) for row in range(len(q)))
    assert seen[0][1] < 0.2 * seen[0][0]


def test_flight_keeps_totals():
    r = np.random.default_rng(1)
    p, tokens = r.random(500), r.integers(1, 3000, 500).astype(float)
    q = flight(p, np.ones(500), tokens, 9)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ tokens - p @ tokens) < 1e-2


def test_landing_keeps_expectations_and_comes_close():
    p, docs_, tokens = np.array([0.3, 1.0, 0.6, 0.0]), np.ones(4), np.array([50.0, 9.0, 70.0, 5.0])
    outcomes = np.array([landing(p, docs_, tokens, salt) for salt in range(4000)])
    assert set(outcomes.ravel()) <= {0.0, 1.0} and (outcomes[:, 1] == 1).all() and (outcomes[:, 3] == 0).all()
    assert np.abs(outcomes.mean(axis=0) - p).max() < 0.03
    # of the ways to decide two that keep expectations, by enumeration the least expected miss: never both
    assert (outcomes[:, 0] + outcomes[:, 2] <= 1).all()
    assert landing(np.array([0.0, 1.0]), docs_[:2], tokens[:2], 1).tolist() == [0, 1]


def test_small_samples_against_their_expectations():
    """Flight and landing of five units: each is drawn as often as its probability says, and totals hold but for two units."""
    p, one, tokens = np.array([0.2, 0.9, 0.5, 0.4, 0.7]), np.ones(5), np.array([3.0, 1.0, 4.0, 1.0, 5.0])
    drawn = np.array([landing(flight(p, one, tokens, salt), one, tokens, salt) for salt in range(6000)])
    assert set(drawn.ravel()) <= {0.0, 1.0}
    assert np.abs(drawn.mean(axis=0) - p).max() < 0.03
    assert np.abs(drawn.sum(axis=1) - p.sum()).max() < 2 and np.abs(drawn @ tokens - p @ tokens).max() <= 9
    flown = np.array([flight(p, one, tokens, salt) for salt in range(200)])
    assert np.allclose(flown.sum(axis=1), p.sum()) and np.allclose(flown @ tokens, p @ tokens)


def test_mix_meets_its_targets(spark):
    rows = [(k, prose(random.Random(k).randint(5, 200), k)) for k in range(400)]
    got = sample(docs(spark, rows), targets={"web": 1.0}, budget=0.25).collect()
    tokens = sum(len(t.split()) for _, t in rows)
    assert {r.source for r in got} == {"web"} and abs(sum(r.tokens for r in got) - tokens * 0.25) < 400


def test_chains_against_every_chain():
    assert chains([0, 10, 20], [5, 15, 26]) == [[0, 1, 2]]
    for seed in range(80):
        r = random.Random(seed)
        matches = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 14))})
        best = [0.0] * len(matches)
        for i, (x, y) in enumerate(matches):
            before = [best[j] - 0.2 * ((x - u) + (y - v)) / 2 for j, (u, v) in enumerate(matches[:i]) if u < x and v < y]
            best[i] = 7 + max([0.0, *before])
        chain = chains([x for x, _ in matches], [y for _, y in matches])[0]
        got = sum(7 - 0.2 * ((matches[j][0] - matches[i][0]) + (matches[j][1] - matches[i][1])) / 2 for i, j in zip(chain, chain[1:])) + 7
        assert abs(got - max(best)) < 1e-9


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("direct", [1 << 26, 50])
def test_common_words_against_the_full_table(monkeypatch, direct):
    monkeypatch.setattr(chain_dedup, "_DIRECT", direct)
    for seed in range(200):
        r = random.Random(seed)
        k = r.choice((2, 4, 30))
        a, b = ([r.randrange(k) for _ in range(r.randrange(60))] for _ in range(2))
        pairs = common(a, b)
        assert len(pairs) == longest_common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_gaps_are_aligned_exactly():
    r = random.Random(3)
    a = [r.randrange(10**6) for _ in range(500)]
    b = [*a[:100], -1, *a[100:300], *a[301:]]
    assert len(common(a, b)) == 499
    assert len(common(a, [-2, -3, *a[5:]])) == 495
    a, b = ([r.randrange(9) for _ in range(1000)] for _ in range(2))
    assert len(common(a, b)) == longest_common(a, b)


def test_passages_are_cut_where_too_little_agrees():
    def of(a, b):
        return [(s, t, u, v) for s, t, u, v, _ in passages(*align(a, b, [0], [0], 7), 50, 0.8)]

    one, two, junk = list(range(80)), list(range(100, 180)), list(range(1000, 1150))
    assert of(one, one[:10] + [-1] + one[10:]) == [(0, 80, 0, 81)]
    assert of(one + junk + two, one + [-x for x in junk] + two) == [(0, 80, 0, 80), (230, 310, 230, 310)]
    assert of(one + junk[:60] + two, one + [-x for x in junk[:60]] + two) == [(0, 80, 0, 80), (140, 220, 140, 220)]
    assert of(one[:45] + junk, one[:45] + two) == []


@pytest.mark.parametrize("group", [256, 16])
def test_fuzzy_passages_are_found(spark, group):
    passage = prose(120, 500).split()
    edited = passage[:40] + ["new"] + passage[41:80] + passage[82:]
    rows = [(k, prose(300, k)) for k in range(10)] + [(20, prose(60, 21) + " " + " ".join(passage)), (22, " ".join(edited) + " " + prose(60, 23))]
    got = {r.doc_id: r for r in fuzzy_passages(docs(spark, rows), group=group).collect()}
    assert set(got) == {20, 22}
    assert (got[20].start_word, got[20].end_word, got[20].other_id, got[20].other_start, got[20].other_end) == (60, 180, 22, 0, 118)
    assert got[22].other_id == 20 and got[22].identity == 117 / 120


def test_edited_passages_are_found_as_brute_force_finds_them(spark):
    """Pairs that share a passage of 52 to 120 words, 0 to 18 % of it edited: nine in ten of those of which a whole alignment has one."""
    rows, want = [], set()
    for i in range(240):
        r = random.Random(1000 + i)
        share = (0, 0.05, 0.1, 0.15, 0.18)[i % 5]
        passage, copy = r.choices(VOCABULARY, k=r.choice((52, 60, 80, 120))), []
        for word in passage:
            kind = r.choice("sssid") if r.random() < share else ""
            copy += {"": [word], "s": [r.choice(VOCABULARY)], "i": [word, r.choice(VOCABULARY)], "d": []}[kind]
        one, other = [*r.choices(VOCABULARY, k=60), *passage, *r.choices(VOCABULARY, k=60)], [*r.choices(VOCABULARY, k=70), *copy, *r.choices(VOCABULARY, k=40)]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
        if passages(*np.array(common(one, other)).T, 50, 0.8):
            want |= {2 * i, 2 * i + 1}
    got = {r.doc_id for r in fuzzy_passages(docs(spark, rows)).collect() if r.doc_id // 2 == r.other_id // 2}
    assert got <= {k for k, _ in rows} and len(want) > 300 and len(got & want) >= 0.93 * len(want)


def test_places_that_few_documents_cover_do_not_meet_all(spark, monkeypatch):
    """op10: copies that their leads don't cover, nearly all alike enough to meet, don't make the square of their number of matches."""
    met, real = [], chain_dedup.written

    def written(df, name):
        table = real(df, name)
        met.extend([table.count()] if name == "met" else [])
        return table

    monkeypatch.setattr(chain_dedup, "written", written)
    r, passage = random.Random(8), prose(80, 601).split()
    rows = [(k, " ".join(f"new{k}x{i}" if r.random() < 0.12 else w for i, w in enumerate(passage))) for k in range(300)]
    found = {x.doc_id for x in fuzzy_passages(docs(spark, rows)).collect()}
    assert len(found) >= 290 and sum(met) < 20_000, (len(found), met)


@pytest.mark.parametrize("group", [256, 16])
def test_all_edited_copies_of_a_group_are_found(spark, group):
    r, passage = random.Random(6), prose(80, 600).split()
    rows = []
    for k in range(100):
        copy = [f"new{k}x{i}" if r.random() < 0.1 else w for i, w in enumerate(passage)]
        rows.append((k, " ".join([prose(40, 700 + k), *copy, prose(40, 900 + k)])))
    assert len({r.doc_id for r in fuzzy_passages(docs(spark, rows), group=group).collect()}) >= 97


def test_a_family_of_much_edited_copies_against_all_pairs(spark):
    """15 % of every copy edited: two are 0.72 alike on average, so that most pairs are none. Nine in ten of the documents that have a partner come up."""
    passage, texts = prose(80, 600).split(), []
    for k in range(100):
        r = random.Random(k)
        texts.append([*prose(40, 700 + k).split(), *(f"new{k}x{i}" if r.random() < 0.15 else w for i, w in enumerate(passage)), *prose(40, 90000 + k).split()])
    want = set()
    for i in range(100):
        for j in range(i):
            if passages(*np.array(common(texts[i], texts[j])).T, 50, 0.8):
                want |= {i, j}
    got = {r.doc_id for r in fuzzy_passages(docs(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()}
    assert 60 < len(want) < 100 and len(got & want) >= 0.9 * len(want)


def test_short_phrases_of_many_documents_are_no_passages(spark):
    phrase = prose(30, 77)
    rows = [(k, " ".join([prose(60, 700 + k), phrase, prose(60, 900 + k)])) for k in range(200)]
    assert fuzzy_passages(docs(spark, rows), group=16).count() == 0


@pytest.mark.parametrize("block", [8192, 16])
def test_of_a_phrase_of_many_documents_every_partner_comes_up(spark, block):
    """80 documents share a phrase of 47 words, no passage; two and two also the three words after it, a passage of 50.
    About the phrase's seeds all others are as alike, so a few picks a place don't do."""
    own = lambda k, side, n: [f"{side}{k}x{i}" for i in range(n)]
    phrase = own(0, "p", 47)
    texts = [own(k, "a", 40) + phrase + own(k // 2, "b", 3) + own(k, "c", 40) for k in range(80)]
    want = {(i, j) for i in range(80) for j in range(80) if i != j and passages(*np.array(common(texts[i], texts[j])).T, 50, 0.8)}
    got = fuzzy_passages(docs(spark, [(k, " ".join(t)) for k, t in enumerate(texts)]), block=block).collect()
    assert want == {(r.doc_id, r.other_id) for r in got} == {(k, k ^ 1) for k in range(80)}
    assert {(r.start_word, r.end_word) for r in got} == {(40, 90)}


@pytest.mark.parametrize("seeds", [1 << 20, 0])
def test_every_place_in_either_document_comes_up(spark, seeds):
    rows, want = [], set()
    for k in range(6):  # whichever document of the two has the lesser key
        passage = prose(80, 610 + k)
        rows += [(2 * k, " ".join([prose(60, 20 + k), passage, prose(400, 40 + k), passage, prose(60, 60 + k)])), (2 * k + 1, " ".join([prose(70, 80 + k), passage, prose(70, 90 + k)]))]
        want |= {(2 * k, 60), (2 * k, 540), (2 * k + 1, 70)}
    got = fuzzy_passages(docs(spark, rows), bitmap_seeds=seeds).collect()
    assert want == {(r.doc_id, r.start_word) for r in got}


def test_one_word_over_and_over(spark):
    rows = [(1, "spam " * 3000), (2, "spam " * 500 + prose(60, 3)), (3, prose(60, 4))]
    got = fuzzy_passages(docs(spark, rows)).collect()
    covered = {k: sum(r.end_word - r.start_word for r in got if r.doc_id == k) for k in (1, 2, 3)}
    assert covered[1] > 0.99 * 3000 and covered[2] > 0.99 * 500 and covered[3] == 0


def test_long_runs_of_one_word_are_covered_by_the_longest_elsewhere(spark):
    rows = [(1, "spam " * 3000), (2, prose(20, 5) + " spam" * 500), (3, "spam " * 70 + prose(60, 3)), (4, "eggs " * 300), (5, prose(60, 4))]
    got = {r.doc_id: (r.start_word, r.end_word, r.other_id, r.other_end - r.other_start, r.identity) for r in fuzzy_passages(docs(spark, rows)).collect()}
    assert got == {1: (0, 3000, 2, 500, 1.0), 2: (20, 520, 1, 500, 1.0), 3: (0, 70, 1, 70, 1.0)}


def test_an_edited_run_covers_the_whole_of_a_long_one(spark):
    """The only long run of its word: each of its places is like the other document's run with one word between."""
    edited = prose(40, 3) + " " + "spam " * 45 + "new " + "spam " * 45 + prose(40, 4)
    for more in ([], [(3, prose(30, 5) + " " + "spam " * 200 + prose(30, 6))]):  # with a third document, the long runs cover each other
        rows = [(1, prose(30, 1) + " " + "spam " * 400 + prose(30, 2)), (2, edited), *more]
        got = {r.doc_id: (r.start_word, r.end_word) for r in fuzzy_passages(docs(spark, rows)).collect()}
        assert got[1] == (30, 430) and got[2] == (40, 131) and len(got) == len(rows)


def test_short_runs_of_one_word_in_unlike_documents_do_not_meet(spark, monkeypatch):
    """op10: every document has a run of 44 words, four fifths of a passage, and all but two pairs nothing else in common."""
    met, real = [], chain_dedup.written

    def written(df, name):
        table = real(df, name)
        met.extend([table.count()] if name == "met" else [])
        return table

    monkeypatch.setattr(chain_dedup, "written", written)
    own = lambda k, side, n: " ".join(f"{side}{k}x{i}" for i in range(n))
    rows = [(k, " ".join([*[f"a{k}"] * 30, *["the"] * 44, *[f"b{k}"] * 30])) for k in range(100)]
    rows += [(k, " ".join([own(k, "a", 40), *["the"] * 44, own(k, "b", 1), *["of"] * 6, own(k, "c", 40)])) for k in (100, 101)]
    rows += [(k, " ".join([own(k, "a", 40), *["of"] * 6, own(k, "b", 1), *["the"] * 44, own(k, "c", 40)])) for k in (102, 103)]
    got = {(r.doc_id, r.start_word, r.end_word, r.other_id) for r in fuzzy_passages(docs(spark, rows)).collect()}
    assert got == {(k, 40, 91, k ^ 1) for k in (100, 101, 102, 103)} and sum(met) < 2500, (got, met)


def test_tiles_meet_as_pairs_do():
    r = np.random.default_rng(4)
    tiers, n = chain_dedup._tiers(50, 0.8, 7), 400
    size = 2 * (tiers[-1][0] + chain_dedup.DRIFT)
    rows = []
    for seed in range(6):
        i, j = (0, 1) if seed % 2 else (0, 0)
        for block in sorted({i, j}):
            rows += [(seed, i, j, block, bool(f), int(k), int(a)) for f, k, a in zip(sorted(r.random(n // 6) < 0.3, reverse=True), r.integers(0, 40, n // 6), r.integers(0, 999, n // 6))]
    masks = [r.integers(0, 1 << 8, len(rows)) for _ in "lr"]
    words = np.concatenate([r.integers(1, 4, (len(rows), size)), np.zeros((len(rows), 2))], axis=1).astype(np.uint8)
    columns = [pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32()))]
    columns += [pa.array(m) for m in masks] + [pa.array(r.random(len(rows)) < 0.2), pa.array([w.tobytes() for w in words], pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["seed", "i", "j", "block", "fresh", "key", "at", "l", "r", "inner", "words"])

    def met(pairs, most):
        return sorted(tuple(x.values()) for out in chain_dedup._meet(tiers, chain_dedup.DRIFT, pairs, most)(iter([batch])) for x in out.to_pylist())

    assert met(1 << 18, 1 << 30) == met(500, 0) == met(1 << 18, 0) and len(met(500, 0)) > 100
