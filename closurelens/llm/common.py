"""Shared helpers: table reading, word hashing, shingles, MinHash and connected
components.

Text rules used by every near-duplicate operator: a null text is the empty
text; words are the lower-cased text split at white space; shingles are five
consecutive words (a text of one to four words is one shingle, a text without
words has none) and are compared by a 64-bit hash.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closurelens.session import discard, materialize

SHINGLE = 5
SIMILARITY = 0.8
#: characters handled per numpy block inside a task
BLOCK_CHARS = 400_000
_WORDS_KEPT = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    import uuid

    from closurelens.session import checkpoint_dir

    return os.path.join(checkpoint_dir(spark), "closurelens", f"{name}-{uuid.uuid4().hex}")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


class WordHashes(dict):
    """word -> 64-bit hash, kept per worker up to a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                      0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_hashes(w: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word shingles of one word-hash sequence, in order."""
    n = len(w)
    if n == 0:
        return w
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out += w[j:n - k + 1 + j] * _POSITION[j]
    return mix(out + np.uint64(k))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split())))


def _seeds(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, size=n, dtype=np.uint64)


def minhash(flat: np.ndarray, starts: np.ndarray, n_hashes: int, seed: int = 7) -> np.ndarray:
    """MinHash values (uint16) of the shingle groups ``flat[starts[i]:starts[i+1]]``,
    none of them empty; one row per group."""
    out = np.empty((len(starts), n_hashes), dtype=np.uint16)
    flips, factors = _seeds(n_hashes, seed), _seeds(n_hashes, seed + 1) | np.uint64(1)
    for j in range(n_hashes):
        low = np.minimum.reduceat((flat ^ flips[j]) * factors[j], starts)
        out[:, j] = mix(low) >> np.uint64(48)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band and signature row (the band number is hashed in)."""
    s = signature[:, :bands * rows].astype(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j] + np.uint64(1))
    return key.view(np.int64)


def chunks(texts: Iterable[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``limit`` characters (one text at least)."""
    start = size = i = 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= limit:
            yield start, i
            start, size = i, 0
    if i > start:
        yield start, i


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands of ``rows`` values that let a pair at the threshold collide
    with at least the wanted probability."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-threshold ** rows)))


def min_matches(n: int, threshold: float, tolerance: float) -> int:
    """Smallest number of equal values among n for which the posterior chance of
    reaching the threshold is at least the tolerance.  With a uniform prior the
    posterior is Beta(m+1, n-m+1), whose upper tail at t is the chance that a
    Binomial(n+1, t) variable is at most m."""
    from math import comb

    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def connected_components(edges: DataFrame, name: str, max_rounds: int = 40, files: int | None = None) -> DataFrame:
    """Components of an undirected graph given as (a, b): one row (node, root)
    per node that has an edge to another node, root = smallest node.

    Alternating large-star and small-star steps: every step is one partial
    minimum per node and one join back, so that a node with very many edges is
    spread over the tasks of its rows, never gathered.  Each round is written to
    the shared folder, which cuts the lineage, and the one before it is removed.
    Ends when a round changes no edge; self edges and nulls take no part; no edges
    give no rows.  ``files`` is the most files a round is written to.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, f"{name}-edges", files=files)
    mark = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == mark:
            break
        mark = tuple(now)
        # large star: all larger neighbours of a node move to its smallest one
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: the smaller neighbours of a node and the node itself move to its smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = large.join(low, "a")
        small = (pair.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        e, last = materialize(small, f"{name}-round", files=files), e
        discard(last)
    else:
        raise RuntimeError(f"{name}: components not settled after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def pandas_map(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
               schema: str) -> DataFrame:
    return df.mapInPandas(fn, schema)
