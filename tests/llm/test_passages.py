"""op2: blocks of windows, what they leave on disk, and small tiles compared together."""

from __future__ import annotations

import glob
import os
import random
import time
from collections import defaultdict

import pandas as pd
import pytest

from closurelens import session
from closurelens.llm import ngram_join, substring_dedup
from closurelens.llm.common import connected_components

DOCS = "doc_id long, text string"
N = substring_dedup.UNIT_WORDS


@pytest.fixture(autouse=True)
def own_folder(monkeypatch, tmp_path):
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: str(tmp_path))


def tables(path, name: str) -> list[str]:
    return glob.glob(os.path.join(path, "closurelens", f"{name}-*"))


def ranges(rows: list[tuple[int, str]]) -> set[tuple[int, int, int, bool]]:
    """The ranges of repeated windows, from every window of every row."""
    at = {(d, s, tuple(w[s:s + N])) for d, t in rows for w in [t.split()] for s in range(len(w) - N + 1)}
    docs = defaultdict(list)
    for d, _, w in at:
        docs[w].append(d)
    out, last = [], None
    for d, s, w in sorted((d, s, w) for d, s, w in at if min(docs[w]) < max(docs[w])):
        stats = (min(docs[w]), max(docs[w]), len(docs[w]))
        if last == (d, s - 1, stats):
            out[-1][2] += 1
        else:
            out.append([d, s, N, d > stats[0]])
        last = (d, s, stats)
    return {tuple(x) for x in out}


def test_ranges_are_those_of_all_windows(spark):
    rng = random.Random(77)
    vocabulary = [f"w{i}" for i in range(400)]

    def some(n: int) -> list[str]:
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [some(n) for n in (12, 20, 24, 25, 40, 90)] + [["tick", "tock"] * 25, ["la"] * 40, some(6) * 9]
    texts = []
    for _ in range(40):
        w = some(rng.randint(0, 30))
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            w += p[a:len(p) - rng.randint(0, len(p) // 3)] + some(rng.randint(0, 20))
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[7] + " more"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (3, texts[3])]
    got = [r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect() if r.kind == "window"]
    assert {(r.doc_id, r.word_start, r.n_words, r.removed) for r in got} == ranges(rows)
    assert len(got) == len(ranges(rows)) > 100


def test_texts_of_one_document_count_their_common_windows_once(spark):
    rng = random.Random(78)
    start, p = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (30, 60)]
    rows = [(1, f"{start} {p} one"), (1, f"{start} {p} two more"), (2, f"{p}"), (3, f"other {p} end")]
    got = [r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect() if r.kind == "window"]
    assert {(r.doc_id, r.word_start, r.n_words, r.removed) for r in got} == {
        (1, 30, 60, False), (2, 0, 60, True), (3, 1, 60, True)} == ranges(rows)


def test_windows_of_copies_are_not_written_one_by_one(spark, tmp_path):
    rng = random.Random(79)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))
    rows = [(i, text) for i in range(5)]
    got = [r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect() if r.kind == "window"]
    assert {(r.doc_id, r.word_start, r.n_words) for r in got} == {(i, 0, 600) for i in range(5)}
    assert sum(spark.read.parquet(t).count() for t in tables(tmp_path, "passage-windows")) == 0
    # the wide tables are gone when they are no longer read
    assert not tables(tmp_path, "passage-units") and not tables(tmp_path, "passage-asked")


def test_rounds_of_components_are_removed(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "chain")
    assert len(tables(tmp_path, "chain")) == 1
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(41)}


def test_small_and_large_tiles_link_the_same_texts(spark, monkeypatch):
    rng = random.Random(80)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for k in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(80)] = "x"
            rows.append((len(rows), g, 1, " ".join(w)))
    texts = spark.createDataFrame(rows, "nid long, grp long, n_docs int, text string")
    sizes = texts.selectExpr("grp", "length(text) AS n_chars")
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 4)

    def links() -> pd.DataFrame:
        return (ngram_join.verified_members(texts, sizes, 0.8).groupBy("nid").sum("texts", "linked")
                .toPandas().sort_values("nid").reset_index(drop=True))

    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for *_, t in rows]
    want = [sum(a != b and rows[a][1] == rows[b][1] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
                for b in range(len(rows))) for a in range(len(rows))]
    small = links()
    assert small["sum(texts)"].tolist() == small["sum(linked)"].tolist() == want and sum(want) > 20
    monkeypatch.setattr(ngram_join, "CHUNK_CHARS", 3000)  # few tiles at once
    monkeypatch.setattr(ngram_join, "SMALL_TILE", 0)
    assert links().equals(small)


def test_shuffle_files_go_with_the_table_they_made(spark):
    from closurelens.session import materialize

    def shuffled() -> int:
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(len(glob.glob(os.path.join(d, "*", "shuffle_*"))) for d in dirs)

    def settled(most: int) -> int:  # removed in the background
        for _ in range(50):
            if shuffled() <= most:
                break
            time.sleep(0.2)
        return shuffled()

    for setting in (None, "false"):
        if setting:
            spark.conf.set(session._CLEANUP, setting)
        before = shuffled()
        df = spark.range(10_000).selectExpr("id % 700 AS k", "id").groupBy("k").count()
        assert len(materialize(df, "counted").collect()) == 700
        assert settled(before) <= before
        assert spark.conf.get(session._CLEANUP, None) == setting
        assert df.count() == 700  # the frame itself can be run again
    spark.conf.unset(session._CLEANUP)


def test_small_tables_are_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "UNITS_A_FILE", 10**9, raising=False)
    rng = random.Random(81)
    rows = []
    for g in range(150):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(3)]
        rows += [(3 * g + k, "\n".join(lines[k:] + [f"{lines[0]} {k} end"])) for k in range(3)]
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # the texts come in few partitions, the shuffles are dealt over many
        got = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS).coalesce(2))
        assert got.where("kind = 'paragraph'").count() >= 900
        most = spark.sparkContext.defaultParallelism
        assert got.rdd.getNumPartitions() <= most
        made = {t: len(glob.glob(os.path.join(t, "part-*"))) for t in tables(tmp_path, "passage")}
        assert len(made) >= 6 and max(made.values()) <= most < 60
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
