"""Benchmark decontamination by SimHash of item-sized windows (DataFrame only).

Words are the lower-cased text without ASCII punctuation, split at white space;
shingles are five consecutive words, weighted by how often they occur.

1. An item-sized window can reach the similarity only if it shares shingles
   with an item, so windows are laid where a document's shingle equals an item's
   shingle, aligned to the place of the shingle in the item (one window per
   unbroken run of common shingles).  Nothing that could match is left out.
2. Equal windows collapse.  Each distinct window gets a 64-bit SimHash of its
   weighted shingles.
3. Multi-index lookup: fingerprints are cut into 8 blocks of 8 bits; item blocks
   are stored with every value within 2 bits, so any fingerprint within
   ``RADIUS`` = 8 * 2 + 7 = 23 bits meets its item in at least one block.
4. Candidates within the radius are verified by the exact weighted Jaccard
   similarity of the shingles (sum of minima over sum of maxima).

A window of similarity 0.8 differs from its item in about 10 of 64 bits, with a
standard deviation of 2.9, so the radius lies more than four deviations away.

The shingle table of the items is broadcast only while it has at most
``BROADCAST_SHINGLES`` rows; beyond that the same join is a shuffled one.

Defined results: null texts are empty; items of fewer than five words have no
shingle and match nothing; a document shorter than the item is one window; null
ids are kept as null; repeated rows give one result row per (doc_id, text,
item_id); empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closurelens.llm.common import SHINGLE, SIMILARITY, text_of
from closurelens.session import materialize

BLOCKS, BLOCK_BITS, NEAR = 8, 8, 2
RADIUS = BLOCKS * NEAR + BLOCKS - 1
BROADCAST_SHINGLES = 2_000_000


def _words(text: Column) -> Column:
    """Words of a text; one empty word if it has none."""
    plain = F.translate(F.lower(text), string.punctuation, "")
    return F.split(F.btrim(plain, F.lit(" \t\n\x0b\f\r")), r"\s+")


def _shingle_at(i: str) -> str:
    """Hash of the shingle of column words that starts at position i (from 0)."""
    return "xxhash64(" + ", ".join(f"words[{i} + {k}]" for k in range(SHINGLE)) + ")"


def _near_masks() -> list[int]:
    """All 8-bit masks of at most NEAR set bits."""
    return [m for m in range(1 << BLOCK_BITS) if bin(m).count("1") <= NEAR]


def _fingerprint(hashes: str) -> str:
    """64-bit SimHash of an array of shingle hashes (repeats weigh more)."""
    vote = f"aggregate({hashes}, 0, (s, h) -> s + 2 * cast(shiftright(h, b) & 1 as int) - 1)"
    return (f"aggregate(sequence(0, 63), 0L, (f, b) -> "
            f"f | CASE WHEN {vote} > 0 THEN shiftleft(1L, b) ELSE 0L END)")


def _shingles(n: str, w: str = "words") -> str:
    return f"transform(sequence(0, {n} - {SHINGLE}), i -> array_join(slice({w}, i + 1, {SHINGLE}), ' '))"


_COUNT = "size(filter({a}, x -> x = u))"
_WEIGHTED_JACCARD = (
    "aggregate(array_union(a, b), named_struct('lo', 0L, 'hi', 0L), (s, u) -> named_struct("
    "'lo', s.lo + least(" + _COUNT.format(a="a") + ", " + _COUNT.format(a="b") + "), "
    "'hi', s.hi + greatest(" + _COUNT.format(a="a") + ", " + _COUNT.format(a="b") + ")), "
    "s -> s.lo / s.hi)")


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, n, words, hashes) of the items with at least five words."""
    return (items.select("item_id", _words(text_of()).alias("words"))
            .withColumn("n", F.size("words")).where(F.col("n") >= SHINGLE)
            .withColumn("shingles", F.expr(_shingles("n"))))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, word_start): for every document
    and item with a window at or above the threshold, the best similarity and
    the first window that has it."""
    item = item_windows(items)
    at = (item.select("words", "n", F.explode(F.expr(f"sequence(0, n - {SHINGLE})")).alias("q"))
          .select("n", "q", F.expr(_shingle_at("q")).alias("h"),
                  F.expr(f"CASE WHEN q > 0 THEN {_shingle_at('q - 1')} END").alias("before")).distinct())
    seeds = at.withColumnRenamed("h", "seed")
    if at.count() <= BROADCAST_SHINGLES:
        seeds = F.broadcast(seeds)

    # generate, join and window text stay in one generated loop, so that the words
    # of a document are never copied per shingle
    starts = F.expr(f"CASE WHEN size(words) >= {SHINGLE} THEN sequence(0, size(words) - {SHINGLE}) END")
    placed = (docs.select("doc_id", text_of().alias("text"))
              .select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
              .select("doc_id", "text_hash", "words", F.explode(starts).alias("i"))
              .withColumn("h", F.expr(_shingle_at("i"))))
    run_starts = F.expr(f"before IS NULL OR i = 0 OR {_shingle_at('greatest(i, 1) - 1')} <> before")
    windows = materialize(placed.join(seeds, F.col("h") == F.col("seed")).where(run_starts)
               .withColumn("s", F.expr("greatest(0, least(i - q, size(words) - n))"))
               .select("doc_id", "text_hash", "n", "s",
                       F.expr("array_join(slice(words, s + 1, n), ' ')").alias("win"))
               .distinct(), "leak-windows")

    flat = materialize(windows.select("n", "win").distinct()
            .withColumn("w", F.split("win", " "))
            .withColumn("a", F.expr(_shingles("size(w)", "w")))
            .withColumn("fp", F.expr(_fingerprint("transform(a, x -> xxhash64(x))")))
            .select("n", "win", "a", "fp"), "leak-fingerprints")
    marked = item.select("item_id", "n", F.col("shingles").alias("b"), F.expr(
        _fingerprint("transform(shingles, x -> xxhash64(x))")).alias("item_fp"))

    def block(fp: str) -> Column:
        return F.expr(f"cast(shiftright({fp}, blk * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} as int)")

    blocks = F.explode(F.array([F.lit(k) for k in range(BLOCKS)])).alias("blk")
    probes = (marked.select("item_id", "n", "item_fp", blocks)
              .withColumn("v", block("item_fp"))
              .withColumn("v", F.explode(F.transform(F.array([F.lit(m) for m in _near_masks()]),
                                                     lambda m: m.bitwiseXOR(F.col("v"))))))
    near = (flat.select("n", "win", "fp", blocks).withColumn("v", block("fp"))
            .join(probes, ["n", "blk", "v"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
            .select("n", "win", "item_id").distinct())
    verified = (near.join(flat.select("n", "win", "a"), ["n", "win"])
                .join(marked.select("item_id", "n", "b"), ["item_id", "n"])
                .withColumn("similarity", F.expr(_WEIGHTED_JACCARD))
                .where(F.col("similarity") >= threshold - 1e-12)
                .select("n", "win", "item_id", "similarity"))
    return (windows.join(verified, ["n", "win"])
            .groupBy("doc_id", "text_hash", "item_id")
            .agg(F.max("similarity").alias("similarity"),
                 F.min(F.struct(-F.col("similarity"), "s")).getField("s").cast("long").alias("word_start")))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents without those that hold a benchmark item, all columns kept."""
    bad = leaks(docs, items, threshold).select(
        F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_text")).distinct()
    tagged = docs.withColumn("__text_hash", F.xxhash64(text_of()))
    return tagged.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id"))
                       & (F.col("__text_hash") == F.col("__bad_text")), "left_anti").drop("__text_hash")
