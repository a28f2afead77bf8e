"""Language-model scores, conversation repair and ranked search against brute force,
with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard

from closurelens.llm import conversation_repair as turns
from closurelens.llm import hidden_markov as hmm
from closurelens.llm import lexical_search as search

SF = "/root/testdata/sf0.001"


def same(got, want, key):
    want = want[list(got.columns)]
    a, b = [f.sort_values(key).reset_index(drop=True).astype(str).to_dict("records") for f in (got, want)]
    assert a == b


# ---- 12 -----------------------------------------------------------------------------------

def every_edit(symbols):
    """Cheapest, then ASCII-least edits, by trying all with at most two inserts in a row."""
    best = (10**9, "")

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        if inserts < 2:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserts + 1)
        if i < len(symbols):
            s = symbols[i]
            go(i + 1, roles, cost + 2, audit + "D", 0)
            if s != "D":
                more = 5 * s.isupper()
                go(i + 1, roles + s.lower(), cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + more + 1, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_search_is_the_cheapest_and_least_edit():
    rng = random.Random(1)
    for n in range(4):
        for _ in range(40):
            s = "".join(rng.choice("suaxSUAXD") for _ in range(n))
            assert turns.search(s) == every_edit(s), s


def test_pieces_fold_to_the_whole_search():
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("suauauaxUAD") for _ in range(rng.randint(1, 50)))
        k = rng.randint(1, 20)
        tables = [[(e, q, *r) for e in range(4) for q in range(4) if (r := turns.search(s[a:a + k], e, q))]
                  for a in range(0, len(s), k)]
        assert turns._fold(tables) == turns.search(s), (s, k)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, copies int, pos int")


def test_repair_of_odd_rows_equals_sql(spark):
    rng = random.Random(3)
    rows = [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b."), (1, None, "user", ""),
            (1, 5, "", "x"), (1, 5, "system", "x"), (2, 9, "tool", "é. \t\n"), (2, 10, "assistant", "long. " * 20_000)]
    for conv in range(3, 40):
        for t in range(rng.randint(1, 9)):
            rows += [(conv, rng.choice([t, t, None]), rng.choice(["user", "assistant", "system", None]),
                      rng.choice(["yes.", "no", " ", None, "why?", "\x0bwell!\x0c"]))] * rng.choice([1, 1, 1, 3])
    # a conversation over several pieces and tasks, half of it one repeated row
    rows += [(100, i, "assistant" if i % 2 else "user", f"t{i}.") for i in range(300)] + [(100, 50, "user", "hot.")] * 300
    data = conversations(spark, [(*r, "k", 1, 2) for r in rows]).repartition(5)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype(
        {"conv_id": "Int64", "turn": "Int64"}))
    got = turns.repair_damaged(data).toPandas()
    same(got.astype({"conv_id": "Int64"}), con.execute(turns.oracle()).df().astype({"conv_id": "Int64"}), "conv_id")
    assert len(got.audit[got.conv_id == 100].item().replace("I", "")) > 2 * turns.PIECE
    assert turns.repair_damaged(data.limit(0)).count() == 0


def test_a_conversation_that_lost_all_rows(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = turns.repair_damaged(conversations(spark, [(conv, 0, "user", "gone.", "", 0, 0)])).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---- 13 -----------------------------------------------------------------------------------

WORDS = ["the", "The", "of", "größe", "año", "x1", "zeta", "omega", "rare", "b2", "名前"]


def text_of(rng, n):
    return rng.choice(["", "- "]) + "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\x7f", "\n", "_"]) for _ in range(n))


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, i, b"x", 7) for i, r in enumerate(docs)],
                              "doc_id long, text string, score int, hash binary, place int")
    q = spark.createDataFrame([(*r, 1, "z") for r in items], "item_id long, text string, rank int, doc_id string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    got = search.search(d, q, **options).toPandas().astype({"doc_id": "Int64"})
    same(got, con.execute(search.oracle()).df().astype({"doc_id": "Int64"}), ["item_id", "rank"])
    return got


def test_search_equals_sql_with_few_slots_and_small_batches(spark):
    # 16 slots for 11 words: bounds are loose, several batches are needed, and items come in blocks
    rng = random.Random(4)
    docs = [(i, text_of(rng, rng.randint(0, 60))) for i in range(300)]
    items = [(i, text_of(rng, rng.randint(1, 12))) for i in range(12)]
    got = ranked(spark, docs, items, slots=16, first=3, item_block=5, block_chars=5_000)
    assert len(got) > 100


def test_search_of_odd_rows(spark):
    rng = random.Random(5)
    many = text_of(rng, 30)
    docs = [(None, "omega rare"), (None, None), (1, ""), (2, "..."), (3, "omega rare"), (3, "omega rare"), (4, "rare " * 400),
            (5, "the " * 30_000 + "zeta"), *[(i, many) for i in range(100, 160)], *[(i, text_of(rng, 20)) for i in range(6, 60)]]
    items = [(1, "OMEGA rare rare"), (1, "OMEGA rare rare"), (2, ""), (3, None), (4, "nowhere"), (5, many), (6, "the the zeta")]
    got = ranked(spark, docs, items)
    assert got.sort_values("rank").doc_id[got.item_id == 5].tolist() == list(range(100, 110)) and set(got.item_id) == {1, 5, 6}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert search.search(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert search.search(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


# ---- 11 -----------------------------------------------------------------------------------

def small_model(states, classes, seed):
    rng = np.random.default_rng(seed)
    part = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(shape) + 0.1)
    names = hmm.Classes({str(i).encode(): i for i in range(1, classes)}, 0)
    return hmm.Model(names, part(states), part(states, states), part(states, classes).T.copy(), np.ones(classes))


def by_paths(text, m):
    """Likelihood and expected counts of one text, summed over every path of states."""
    k = len(m.first)
    like, first, pairs, counts = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros(m.emits.shape)
    for path in itertools.product(range(k), repeat=len(text)):
        p = m.first[path[0]] * math.prod(m.moves[a, b] for a, b in zip(path, path[1:]))
        p *= math.prod(m.emits[g, q] for g, q in zip(text, path))
        like += p
        first[path[0]] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
        for g, q in zip(text, path):
            counts[g, q] += p
    return like, first / like, pairs / like, counts / like


@pytest.mark.parametrize("stretch", [1_000_000, 3])
def test_expected_counts_equal_all_paths(monkeypatch, stretch):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    rng = random.Random(6)
    m = small_model(3, 4, 1)
    texts = sorted([np.array([rng.randrange(4) for _ in range(rng.randint(1, 6))], np.uint16) for _ in range(8)], key=lambda x: -len(x))
    want = [by_paths(t, m) for t in texts]
    total, first, pairs, counts = hmm._expected(texts, m)
    assert math.isclose(total, sum(math.log(w[0]) for w in want), rel_tol=1e-5)
    for got, i in ((first, 1), (pairs, 2), (counts, 3)):
        assert np.allclose(got, sum(w[i] for w in want), rtol=1e-4)
    stack, logs, now = hmm._Stack(texts), np.zeros(len(texts)), None
    for a, b in zip(stack.cuts[:-1], stack.cuts[1:]):
        _, scale, now = hmm._forward(stack, m, a, b, now, m.emits)
        text = np.arange(len(scale)) - np.repeat(stack.o[a:b] - stack.o[a], stack.n[a:b])
        logs += np.bincount(text, weights=np.log(scale), minlength=len(texts))
    assert np.allclose(logs, [math.log(w[0]) for w in want], rtol=1e-12)


def key_words(tokens):
    return [w if len(w) <= 64 else b" " + hashlib.sha256(w).digest() for w in tokens]


def test_scores_base_by_hand_and_model_by_enumeration(spark):
    texts = ["a b a", "B  c\u00a0d", None, "", " \t\n", "a b a", "\x1cx y", "É é", "b b b b", "c a b", "w" * 70 + " a", "w" * 70]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "")]
    docs = spark.createDataFrame([(*r, 1, b"", True) for r in rows], "doc_id long, text string, block int, classes binary, held boolean")
    tokens = [(t or "").encode().lower().split() + [b" "] for _, t in rows]
    out = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    tokens = [key_words(t) for t in tokens]
    c = Counter(w for t, h in zip(tokens, out) if not h for w in t)
    total, distinct = sum(c.values()), len(c)
    got = hmm.language_scores(docs, hmm.held_out_rows(), states=2, top=3, forms=5, rounds=2, common=4, block_chars=150).toPandas()
    assert got.columns.tolist() == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), r[1:4], round(r[4], 9))
    want = [(float("nan") if i is None else float(i), h, len(t), sum(w in c for w in t),
             sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in t)) for (i, _), h, t in zip(rows, out, tokens)]
    have = [(float(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score) for r in got.itertuples()]
    assert sorted(map(key, have)) == sorted(map(key, want)) and set(got.train_tokens) == {total}
    assert got.score.notna().all() and (got.score < 0).all()
    # one state: a text's score is the product of its class and word factors
    frequent = sorted((x for x in c.items() if x[0] != b" "), key=lambda x: (-x[1], x[0]))[:3]
    classes = hmm.Classes({w: i for i, (w, _) in enumerate(frequent, 1)}, 5)
    n, v = Counter(), Counter()
    for w, times in c.items():
        n[classes.of(w)] += times
        v[classes.of(w)] += 1
    mass = {g: n[g] + v[g] + (n[g] == 0 or g > 3) for g in range(classes.n)}
    emit = {g: (n[g] + 200 * mass[g] / sum(mass.values())) / (total + 200) for g in mass}
    score = [sum(math.log10(emit[classes.of(w)] * (c[w] + 1) / mass[classes.of(w)]) for w in t) for t in tokens]
    one = hmm.language_scores(docs, hmm.held_out_rows(), states=1, top=3, forms=5, rounds=3).toPandas()
    assert np.allclose(sorted(one.score), sorted(score), rtol=1e-5)


def test_model_beats_its_base_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = hmm.language_report(docs).toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and held.score.sum() > held.base_score.sum()
    _, track = hmm.baum_welch(spark.createDataFrame(
        [(zstandard.compress(np.random.default_rng(i).integers(0, 4, 30).astype(np.uint16).tobytes()),) for i in range(20)], "classes binary"),
        small_model(2, 4, 3), 4)
    assert all(b >= a - 0.5 for a, b in zip(track, track[1:]))


def test_scores_of_empty_and_untrained_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.language_report(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm.language_report(spark.createDataFrame([(held, "some words " * 5_000)], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 10_001, 0, 0, 0.0)
