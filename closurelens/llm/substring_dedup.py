"""Passages that repeat across documents: paragraph MinHash banding with exact
verification, removals clustered by components.

Units of a document (words as in ``common``, places in words):
* paragraphs: lines of at least one shingle (``SHINGLE`` words); shorter lines
  are no passages;
* windows: every ``UNIT_WORDS`` consecutive words, so a passage of that length
  or more is found whole inside longer paragraphs.

The seed of a window is the smallest hash of its ``SEED_WORDS``-word runs, so
equal windows have equal seeds.  Documents first meet by their seeds, of which
neighbouring windows share most; only windows whose seed occurs in another
document are looked at themselves.  A block is the windows in a row that have
one seed at one place (a window alone, if the seed comes again in reach), known
by the hash of all its words.  If all blocks of a seed are equal, their windows
occur exactly where they do, and no window is counted by itself; only the
windows of the different blocks of a seed are, one row for each kind of block.
Repeated windows that follow each other and have the same first and last
document and count are one range.

Equal units have equal hashes and meet in one group.  Paragraphs also meet by
MinHash bands, their number tuned so that a pair at the threshold collides with
probability ``RECALL``; paragraphs that collide, directly or over others, are a
candidate group, in which every pair is compared in tiles of bounded size and
verified by exact Jaccard; verified links are joined to components.
A class is such a component or a window; classes that occur in at least two
documents are repeats.  In each class the document with the smallest id keeps
its passage and the others' are removals.  The class of a range is the hash of
its windows; ranges of different classes may overlap.

No group is gathered: classes and buckets are counted by partial minima and
maxima and joined back; what is gathered or ordered per document is bounded by
its words.  Defined results: null text = empty text; rows without
doc_id take no part; repeated rows are one document; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closurelens.llm.common import (SHINGLE, SIMILARITY, band_keys, bands_for, chunks,
                                    connected_components, minhash, mix, shingle_hashes,
                                    text_of, word_hashes)
from closurelens.llm.ngram_join import verified_members
from closurelens.session import discard, materialize

UNIT_WORDS = 24
SEED_WORDS = 12
ROWS = 4
RECALL = 0.99
PARAGRAPH, SEED = 0, 1
#: paragraphs a task keeps in mind to give their bands once
SEEN_KEPT = 200_000
#: tables have one file for so many units of the texts, and for each core, at most
UNITS_A_FILE = 1_000_000


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
_POWERS_KEPT = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept per worker up to a bounded number."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _POWERS_KEPT)
        with np.errstate(over="ignore"):
            made = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x, dtype=np.uint64)]))
                    for x in (_BASE, pow(_BASE, -1, 2**64))]
        if size > _POWERS_KEPT:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def _prefix(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of w[j] * B**j and the powers of the inverse of B, for ``_range_hash``."""
    power, back = _powers(len(w) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum(mix(w) * power[:len(w)])]), back


def _range_hash(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of word ranges."""
    sums, back = prefix
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * back[starts] + np.uint64(seed) * (ends - starts).astype(np.uint64))


def window_seeds(prefix: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of ``SEED_WORDS`` words, and the seed of every window, in order."""
    n = len(prefix[0]) - UNIT_WORDS
    if n < 1:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    at = np.arange(n + UNIT_WORDS - SEED_WORDS)
    runs = low = _range_hash(prefix, at, at + SEED_WORDS, 2)
    span, width = UNIT_WORDS - SEED_WORDS + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return runs, np.minimum(low[:n], low[span - width:span - width + n])


def words_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, starts and ends of the paragraphs) of one text."""
    words: list[str] = []
    ranges = []
    for line in text.lower().split("\n"):
        start = len(words)
        words += line.split()
        if len(words) - start >= SHINGLE:
            ranges.append((start, len(words)))
    s, e = np.array(ranges, dtype=np.int64).reshape(-1, 2).T
    return words, s, e


def _lists(counts: np.ndarray, values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))


def _units(bands: int):
    """Paragraphs and seeds of the texts.  Equal paragraphs have equal bands, so a task gives
    them once for those it has kept in mind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts):
                doc, kind, unit, at, size, fresh, sets = [], [], [], [], [], [], []
                for i in range(a, b):
                    words, s, e = words_of(texts[i])
                    w = word_hashes(words)
                    prefix = _prefix(w)
                    seeds = np.unique(window_seeds(prefix)[1])
                    if not len(s) and not len(seeds):
                        continue
                    units = _range_hash(prefix, s, e, 1).view(np.int64)
                    none = np.zeros(len(seeds), dtype=np.int64)
                    new = none.astype(bool)
                    if len(s):
                        shingles, first = shingle_hashes(w), []
                        for u, x, y in zip(units.tolist(), s.tolist(), e.tolist()):
                            first.append(u not in seen)
                            if first[-1]:
                                seen.add(u)
                                sets.append(shingles[x:y - SHINGLE + 1])
                        new = np.concatenate([first, new])
                        if len(seen) > SEEN_KEPT:
                            seen.clear()
                    doc.append(np.full(len(s) + len(seeds), ids[i], dtype=np.int64))
                    kind.append(np.repeat(np.array([PARAGRAPH, SEED], dtype=np.int8), [len(s), len(seeds)]))
                    unit.append(np.concatenate([units, seeds.view(np.int64)]))
                    at.append(np.concatenate([s, none]))
                    size.append(np.concatenate([e - s, none]))
                    fresh.append(new)
                if not doc:
                    continue
                keys = [band_keys(minhash(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]), bands * ROWS),
                                  bands, ROWS).ravel()] if sets else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(doc)), pa.array(np.concatenate(kind)), pa.array(np.concatenate(unit)),
                     pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(size).astype(np.int32)),
                     _lists(np.concatenate(fresh) * bands, keys)],
                    ["doc_id", "kind", "unit", "word_start", "n_words", "bands"])

    return run


_FOUND = ("kind byte, doc_id long, several boolean, word_start int, n_windows int, seed long, unit long, x long, "
          "windows array<long>, line string")


def _blocks(prefix: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, several: bool) -> tuple[np.ndarray, ...]:
    """Starts, numbers of windows and seeds of the blocks with a wanted seed."""
    runs, seeds = window_seeds(prefix)
    if not len(seeds) or not len(wanted):
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.int64),)
    at = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
    n = np.diff(np.append(at, len(seeds)))
    keep = np.isin(seeds[at].view(np.int64), wanted)
    at, n = at[keep], n[keep]
    seed = seeds[at]
    # one place of the seed for all windows, or each window is a block
    span, times = n + UNIT_WORDS - SEED_WORDS, np.zeros(len(at), dtype=np.int64)
    for j in range(2 * (UNIT_WORDS - SEED_WORDS) + 1):
        times += (j < span) & (runs[np.minimum(at + j, len(runs) - 1)] == seed)
    alone = (times > 1) | (n > UNIT_WORDS - SEED_WORDS + 1) | several
    parts = np.where(alone, n, 1)
    owner = np.repeat(np.arange(len(at)), parts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    return at[owner] + step, np.where(alone, 1, n)[owner], seed[owner].view(np.int64)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines, and the blocks of windows whose seed is wanted, of each text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids, several = batch.column("doc_id").to_pylist(), batch.column("several").to_pylist()
        for a, b in chunks(texts):
            rows, out, windows, lines = [], [], [], []
            for i in range(a, b):
                words, s, e = words_of(texts[i])
                prefix = _prefix(word_hashes(words))
                units = _range_hash(prefix, s, e, 1).view(np.int64)
                at, n, seed = _blocks(prefix, batch.column("seeds")[i].values.to_numpy(), several[i])
                chosen = np.flatnonzero(np.isin(units, batch.column("lines")[i].values.to_numpy()))
                lines += [" ".join(words[s[k]:e[k]]) for k in chosen] + [None] * len(at)
                owner = np.repeat(np.arange(len(at)), n)
                w = at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                h = _range_hash(prefix, w, w + UNIT_WORDS, 3).view(np.int64)
                x = np.bitwise_xor.reduceat(h, np.cumsum(n) - n) if len(n) else h
                windows.append(h)
                none = np.zeros(len(chosen), dtype=np.int64)
                rows.append((ids[i], several[i], len(chosen), len(at)))
                out.append([np.concatenate(c) for c in (
                    (none, at), (none, n), (none, seed), (none, x),
                    (units[chosen], _range_hash(prefix, at, at + n + UNIT_WORDS - 1, 4).view(np.int64)))])
            at, n, seed, x, unit = (np.concatenate(c) for c in zip(*out))
            total = [r[2] + r[3] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.repeat(np.array([PARAGRAPH, SEED], dtype=np.int8), r[2:]) for r in rows])),
                 pa.array(np.repeat(np.array([r[0] for r in rows], dtype=np.int64), total)),
                 pa.array(np.repeat(np.array([r[1] for r in rows], dtype=bool), total)),
                 pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(seed), pa.array(unit),
                 pa.array(x), _lists(n, windows), pa.array(lines, pa.string())],
                [f.split()[0] for f in _FOUND.split(", ")])


def _same_as_before(order: Window, start: str, length: Column) -> Column:
    """0 if a row follows the one before it and has its first and last document and count, else 1."""
    here = F.struct("first", "last", "n")
    follows = (F.col(start) == F.lag(start).over(order) + F.lag(length).over(order)) & (here == F.lag(here).over(order))
    return F.when(follows, 0).otherwise(1)


def repeated_ranges(found: DataFrame, files: int | None = None) -> DataFrame:
    """Ranges of repeated windows, from the blocks (see ``_found``)."""
    rows = found.where(F.col("kind") == SEED)
    # texts of one document may share windows; theirs are blocks of one window
    blocks = rows.where("not several").union(rows.where("several").dropDuplicates(["doc_id", "word_start", "unit"]))
    kinds = materialize(blocks.groupBy("seed", "unit").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"),
        F.max("n_windows").alias("length"), F.max("x").alias("x")), "passage-blocks", files=files)
    kinds = kinds.join(kinds.groupBy("seed").agg(F.count("*").alias("n_kinds")), "seed")
    # the only kind of block of its seed: its windows occur where it occurs
    pure = kinds.where("n_kinds = 1 and first < last").select(
        "unit", F.lit(0).alias("pos"), F.col("length").cast("long").alias("length"), "x", "first", "last", "n")
    mixed = kinds.where("n_kinds > 1").select(F.col("unit").alias("u"), "first", "last", "n")
    windows = materialize(
        blocks.select("unit", "doc_id", "windows")
        .join(mixed, (F.col("unit") == F.col("u")) & (F.col("doc_id") == F.col("first")))
        .select("unit", "first", "last", "n", F.posexplode("windows").alias("pos", "x"))
        .dropDuplicates(["unit", "pos"]), "passage-windows", files=files)
    repeats = (windows.groupBy("x").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                        F.sum("n").alias("n")).where("first < last"))
    inside = Window.partitionBy("unit").orderBy("pos")
    parts = (windows.select("unit", "pos", "x").join(repeats, "x")
             .withColumn("begins", _same_as_before(inside, "pos", F.lit(1)))
             .withColumn("part", F.sum("begins").over(inside))
             .groupBy("unit", "part").agg(F.min("pos").alias("pos"), F.count("*").alias("length"), F.bit_xor("x").alias("x"),
                                          F.first("first").alias("first"), F.first("last").alias("last"),
                                          F.first("n").alias("n")))
    order = Window.partitionBy("doc_id").orderBy("word_start", "x")
    placed = (blocks.select("doc_id", "word_start", "unit").join(pure.unionByName(parts.drop("part")), "unit")
              .select("doc_id", (F.col("word_start") + F.col("pos")).alias("word_start"), "length", "x", "first", "last", "n")
              .withColumn("begins", _same_as_before(order, "word_start", F.col("length")))
              .withColumn("range", F.sum("begins").over(order)))
    return (placed.groupBy("doc_id", "range")
            .agg(F.min("word_start").alias("word_start"), F.sum("length").alias("n"),
                 F.bit_xor("x").alias("x"), F.first("first").alias("first"))
            .select("doc_id", "word_start", (F.col("n") + UNIT_WORDS - 1).alias("n_words"),
                    F.xxhash64("x", "n").alias("unit"), "first"))


def _shared(rows: DataFrame, key: str, member: str) -> DataFrame:
    """The rows whose key has two members or more, with the smallest as low.  Both sides of the
    join are dealt once; one row a key is kept, the others pass by."""
    dealt = rows.repartition(key)
    low = (dealt.groupBy(key).agg(F.min(member).alias("low"), F.max(member).alias("high"))
           .where("low < high").select(key, "low"))
    return dealt.join(low.hint("shuffle_hash"), key)


def repeated_passages(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, kind ('paragraph' or 'window', a range of windows), word_start, n_words,
    class_id, removed: every occurrence of a passage that occurs in two documents or more."""
    bands = bands_for(threshold, RECALL, ROWS)
    given = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    units = materialize(given.mapInArrow(
        _units(bands), "doc_id long, kind byte, unit long, word_start int, n_words int, bands array<long>"), "passage-units")
    # each file costs its executor a few processes (chmod): few, if the shuffle has far more partitions than the rows need
    files = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(units.count() / UNITS_A_FILE))

    lines = units.where(F.col("kind") == PARAGRAPH)
    edges = _shared(lines.select("unit", F.explode("bands").alias("band")), "band", "unit")
    groups = connected_components(edges.select(F.col("unit").alias("a"), F.col("low").alias("b")), "passage-candidates",
                                  files=files)
    paragraphs = materialize(lines.select("doc_id", "unit", "word_start", "n_words"), "passage-paragraphs", files=files)

    # the key of a line is its hash, so one of the equal lines stands for all
    wanted = (paragraphs.join(groups, F.col("unit") == F.col("node")).groupBy("unit").agg(F.min("doc_id").alias("doc_id"))
              .select("doc_id", F.lit(None).cast("long").alias("seed"), F.col("unit").alias("line"))
              .union(_shared(units.where(F.col("kind") == SEED).select("unit", "doc_id"), "unit", "doc_id")
                     .select("doc_id", "unit", F.lit(None).cast("long"))))
    asked = materialize(wanted.groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"), F.collect_set("line").alias("lines")),
                        "passage-asked", files=files)
    discard(units)
    several = given.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several"))
    asked_of = asked.join(several, "doc_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    found = materialize(given.join(asked_of, "doc_id").select("doc_id", "text", "seeds", "lines", "several")
                        .mapInArrow(_found, _FOUND), "passage-found", files=files)
    discard(asked)

    texts = materialize(found.where(F.col("kind") == PARAGRAPH).select("unit", "line")
                        .join(groups, F.col("unit") == F.col("node"))
                        .select(F.col("unit").alias("nid"), F.col("root").alias("grp"), F.lit(1).alias("n_docs"),
                                F.col("line").alias("text")).dropDuplicates(["nid"]), "passage-lines", files=files)
    checked = materialize(verified_members(texts, texts.select("grp", F.length("text").alias("n_chars")), threshold),
                          "passage-checked", files=files)
    discard(texts)
    roots = connected_components(checked.select(F.col("nid").alias("a"), F.col("hook").alias("b")), "passage-links",
                                 files=files)
    discard(checked)

    classed = (paragraphs.join(roots, F.col("unit") == F.col("node"), "left")
               .select("doc_id", F.coalesce("root", "unit").alias("unit"), "word_start", "n_words"))
    repeats = (classed.groupBy("unit").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
               .where("first < last").select("unit", "first"))
    columns = ["doc_id", "kind", "word_start", "n_words", "unit", "first"]
    return (classed.join(repeats, "unit").withColumn("kind", F.lit("paragraph")).select(columns)
            .union(repeated_ranges(found, files).withColumn("kind", F.lit("window")).select(columns))
            .select("doc_id", "kind", F.col("word_start").cast("long").alias("word_start"),
                    F.col("n_words").cast("long").alias("n_words"), F.col("unit").alias("class_id"),
                    (F.col("doc_id") > F.col("first")).alias("removed")).coalesce(files))


_PIECE = re.compile(r"\S+")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist()):
            if text and spans:
                drop = {i for s in spans for i in range(s["word_start"], s["word_start"] + s["n_words"])}
                keep, at = [], 0
                for i, m in enumerate(_PIECE.finditer(text)):
                    if i not in drop:
                        keep.append(text[at:m.end()])
                    elif "\n" in text[at:m.start()]:
                        keep.append("\n")
                    at = m.end()
                text = "".join(keep).strip()
            out.append(text)
        cols = [pa.array(out, pa.string()) if n == "text" else b.column(n) for n in b.schema.names if n != "__spans"]
        yield pa.RecordBatch.from_arrays(cols, [n for n in b.schema.names if n != "__spans"])


def remove_repeats(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents without their removed passages, all columns kept.  The spans
    gathered per document are bounded by its words."""
    spans = (repeated_passages(docs, threshold).where("removed").groupBy(F.col("doc_id").alias("__id"))
             .agg(F.collect_set(F.struct("word_start", "n_words")).alias("__spans")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.join(spans, docs["doc_id"].cast("long") == F.col("__id"), "left").drop("__id").mapInArrow(_cut, fields)
