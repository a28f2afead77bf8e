"""N-gram Jaccard join with Bayesian candidate pruning.

1. Equal texts collapse to one class (MD5 of the whole text), so copies are
   counted, never paired.
2. Every text gets MinHash values; ``bands`` groups of ``rows`` values are band
   keys, their number tuned so that a pair at the threshold collides with
   probability ``CANDIDATE_RECALL``.  A bucket adds one edge per member (to its
   smallest member), and the components of these edges are candidate groups.
3. A candidate group is cut into chunks of bounded rows and characters, and
   each pair of chunks is a tile.  Inside a tile MinHash values are compared
   ``STEP`` at a time; a pair is dropped as soon as the posterior probability
   of reaching the threshold is below ``TOLERANCE``; the rest is verified on
   the exact shingle sets.  A tile returns one row per member (counts and one
   spanning edge), not its pairs, so the output is linear in the members times
   the chunks of their group.
4. Components of the verified links are the classes.

Candidate search by MinHash is probabilistic: a pair exactly at the threshold
is missed with probability of about 1 - CANDIDATE_RECALL, pairs above it with
less.

Defined results: null text = empty text; texts without words are similar to
equal texts only; texts of one to four words have one shingle; repeated rows
count as copies; ``class_id`` is the smallest doc_id of the class (null if no
member has an id); an empty table gives no rows; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closurelens.llm.common import (SIMILARITY, band_keys, bands_for, chunks,
                                    connected_components, min_matches, minhash, shingle_hashes,
                                    shingle_set, text_of, word_hashes)
from closurelens.session import materialize

ROWS = 5
CANDIDATE_RECALL = 0.9999
N_HASHES = 128
STEP = 32
TOLERANCE = 1e-6
CHUNK_ROWS = 512
CHUNK_CHARS = 4_000_000
#: tiles of so few texts have their pairs listed and are compared together
SMALL_TILE = 64


def _band_arrow(bands: int, rows: int):
    """Adds the band keys of column text and leaves the text out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys: list = [[]] * len(texts)
            for a, b in chunks(texts):
                sets, at = [], []
                for i in range(a, b):
                    s = shingle_hashes(word_hashes(texts[i].lower().split()))
                    if len(s):
                        sets.append(s)
                        at.append(i)
                if not at:
                    continue
                starts = np.cumsum([0, *map(len, sets[:-1])])
                values = minhash(np.concatenate(sets), starts, bands * rows)
                for i, k in zip(at, band_keys(values, bands, rows)):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), batch.column("n_chars"),
                 pa.array(keys, pa.list_(pa.int64()))], ["key", "doc_id", "n_chars", "bands"])

    return run


def exact_similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sorted distinct shingle sets reach the exact Jaccard threshold."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if len(i) <= 2000:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                           for a, b in zip(i, j)], dtype=np.int64)
    else:  # many pairs of few texts: shared counts as products of 0/1 blocks
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        ri, rj = at[:len(i)], at[len(i):]
        owner = np.repeat(np.arange(len(rows)), size[rows])
        _, col, times = np.unique(np.concatenate([sets[r] for r in rows]),
                                  return_inverse=True, return_counts=True)
        many = times[col] > 1
        owner, col = owner[many], np.unique(col[many], return_inverse=True)[1]
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        total = np.zeros((len(rows), len(rows)), dtype=np.float32)
        width = 4096
        last = int(col[-1]) + 1 if len(col) else 0
        for lo in range(0, last, width):
            s, e = np.searchsorted(col, [lo, lo + width])
            block = np.zeros((len(rows), width), dtype=np.float32)
            block[owner[s:e], col[s:e] - lo] = 1
            total += block @ block.T
        shared = total[ri, rj].astype(np.int64)
    union = size[i] + size[j] - shared
    return shared >= threshold * union - 1e-9


def prune(left: np.ndarray, right: np.ndarray, same: bool, threshold: float,
          tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) that the incremental comparison keeps."""
    equal = np.zeros((len(left), len(right)), dtype=np.int16)
    for c in range(STEP):
        equal += left[:, c][:, None] == right[:, c][None, :]
    alive = equal >= min_matches(STEP, threshold, tolerance)
    if same:
        alive = np.triu(alive, 1)
    i, j = np.nonzero(alive)
    count = equal[i, j].astype(np.int32)
    for n in range(2 * STEP, left.shape[1] + 1, STEP):
        if not len(i):
            break
        for c in range(n - STEP, n):
            count += left[i, c] == right[j, c]
        keep = count >= min_matches(n, threshold, tolerance)
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def _small_pairs(chunk: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one tile: of a chunk with itself, or of two chunks."""
    if tile[0] == tile[1]:
        return np.triu_indices(len(chunk), 1)
    return tuple(x.ravel() for x in np.meshgrid(np.flatnonzero(chunk == tile[0]), np.flatnonzero(chunk == tile[1]),
                                                indexing="ij"))


def _pruned(values: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``prune``, of the given pairs."""
    count = np.zeros(len(i), dtype=np.int32)
    for n in range(STEP, values.shape[1] + 1, STEP):
        count += (values[i, n - STEP:n] == values[j, n - STEP:n]).sum(axis=1)
        keep = count >= min_matches(n, threshold, TOLERANCE)
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def _compared(pdf: pd.DataFrame, starts: np.ndarray, threshold: float) -> pd.DataFrame:
    """Compares the texts of each tile; the rows of a tile follow each other from its start."""
    nid, docs, chunk = pdf.nid.to_numpy(), pdf.n_docs.to_numpy(), pdf.chunk.to_numpy()
    tiles = pdf[["ti", "tj"]].to_numpy()
    n = len(nid)
    sets = [shingle_set(t) for t in pdf.text]
    values = minhash(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]), N_HASHES)
    small, links = [], []
    for lo, hi in zip(starts, np.append(starts[1:], n)):
        if hi - lo <= SMALL_TILE:
            i, j = _small_pairs(chunk[lo:hi], tiles[lo])
            small.append((lo + i, lo + j))
            continue
        a = lo + np.flatnonzero(chunk[lo:hi] == tiles[lo, 0])
        same = tiles[lo, 0] == tiles[lo, 1]
        b = a if same else lo + np.flatnonzero(chunk[lo:hi] == tiles[lo, 1])
        i, j = prune(values[a], values[b], same, threshold)
        i, j = a[i], b[j]
        ok = exact_similar(sets[lo:hi], i - lo, j - lo, threshold)
        links.append((i[ok], j[ok]))
    if small:
        i, j = _pruned(values, *(np.concatenate(x) for x in zip(*small)), threshold)
        for at in range(0, len(i), 1000):  # so few that the pairs are looked at one by one
            p, q = i[at:at + 1000], j[at:at + 1000]
            ok = exact_similar(sets, p, q, threshold)
            links.append((p[ok], q[ok]))
    i, j = (np.concatenate(x) for x in zip(*links)) if links else np.empty((2, 0), dtype=np.int64)
    root = np.arange(n)
    while True:
        old = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == old).all():
            break
    texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    linked = (np.bincount(i, weights=docs[j], minlength=n)
              + np.bincount(j, weights=docs[i], minlength=n))
    return pd.DataFrame({"nid": nid, "texts": texts.astype("int64"),
                         "linked": linked.astype("int64"), "hook": nid[root]})


def _tiles(threshold: float):
    """Tiles in order: small ones are compared together, up to ``CHUNK_CHARS`` characters at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["grp", "ti", "tj"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            # the last tile may go on in the next frame
            rest = pdf.iloc[starts[-1]:]
            yield from parts(pdf.iloc[:starts[-1]], starts[:-1])
        if rest is not None:
            yield from parts(rest, np.zeros(1, dtype=np.int64))

    def parts(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(starts):
            return
        ends = np.append(starts[1:], len(pdf))
        chars = np.cumsum(pdf.text.str.len().to_numpy())[ends - 1]
        at = 0
        while at < len(starts):
            done = chars[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(chars, done + CHUNK_CHARS, "right")))
            lo = starts[at]
            yield _compared(pdf.iloc[lo:ends[to - 1]], starts[at:to] - lo, threshold)
            at = to

    return run


def verified_members(texts: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Compares the texts of each candidate group with each other in tiles.

    ``texts`` is (nid, grp, n_docs, text), ``sizes`` one row (grp, n_chars) per
    text.  Returns, per text and tile: nid, texts and linked (partners, and their
    documents), hook (the nid of an edge that spans its links there)."""
    parts = sizes.groupBy("grp").agg(
        F.greatest(F.ceil(F.count("*") / CHUNK_ROWS),
                   F.ceil(F.sum("n_chars") / CHUNK_CHARS)).cast("int").alias("parts"))
    tiles = (texts.join(parts, "grp")
             .withColumn("chunk", F.expr("cast(pmod(xxhash64(nid), parts) as int)"))
             .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
             .select("grp", F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj"),
                     "nid", "n_docs", "chunk", "text"))
    # by number, as tiles of few bytes may take long
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (tiles.repartition(n, "grp", "ti", "tj").sortWithinPartitions("grp", "ti", "tj", "nid")
            .mapInPandas(_tiles(threshold), "nid long, texts long, linked long, hook long"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select(
        F.unhex(F.md5("text")).alias("key"), "doc_id", "text")


def similar_classes(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(documents, texts): documents has (key, doc_id) of every row; texts has one
    row per distinct text: key, rep (its smallest doc_id), n_docs (rows with this
    text), n_text_links, n_links, root (a number per class), class_id, is_first
    (whether this text stands for its class)."""
    bands = bands_for(threshold, CANDIDATE_RECALL, ROWS)
    keyed = _keyed(docs)
    signed = materialize(
        keyed.withColumn("n_chars", F.length("text").cast("long"))
        .mapInArrow(_band_arrow(bands, ROWS),
                    "key binary, doc_id long, n_chars long, bands array<long>"), "ngram-bands")
    classes = materialize(
        signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"),
                                  F.max("n_chars").alias("n_chars"))
        .withColumn("nid", F.monotonically_increasing_id()), "ngram-classes")

    first = signed.join(classes.select(F.col("key").alias("k"), "rep", "nid"),
                        (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    buckets = first.select("nid", F.explode("bands").alias("band"))
    shared = (buckets.groupBy("band").agg(F.min("nid").alias("low"), F.max("nid").alias("high"))
              .where("low < high").select("band", "low"))
    groups = connected_components(
        buckets.join(shared, "band").select(F.col("nid").alias("a"), F.col("low").alias("b")),
        "ngram-candidates")

    members = classes.join(groups, classes.nid == groups.node).select(
        "nid", F.col("key").alias("k"), "rep", "n_docs", F.col("root").alias("grp"))
    texts = (keyed.join(members, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep")))
             .select("nid", "grp", "n_docs", "text").dropDuplicates(["nid"]))
    sizes = classes.join(groups, classes.nid == groups.node).select(F.col("root").alias("grp"), "n_chars")
    found = materialize(verified_members(texts, sizes, threshold), "ngram-links")
    roots = connected_components(found.select(F.col("nid").alias("a"), F.col("hook").alias("b")),
                                 "ngram-classes-verified")

    counts = found.groupBy("nid").agg(F.sum("texts").alias("texts"), F.sum("linked").alias("linked"))
    full = (classes.join(counts, "nid", "left")
            .join(roots.withColumnRenamed("node", "nid"), "nid", "left")
            .select("key", "rep", "n_docs", "nid", F.coalesce("texts", F.lit(0)).alias("n_text_links"),
                    (F.coalesce("linked", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
                    F.coalesce("root", "nid").alias("root")))
    best = full.groupBy("root").agg(
        F.min("rep").alias("class_id"),
        F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("first"))
    full = materialize(full.join(best, "root").withColumn(
        "is_first", F.col("first.key") == F.col("key")).drop("first"), "ngram-full")
    return signed.select("key", "doc_id"), full


def ngram_jaccard_join(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (other documents of Jaccard
    similarity at or above the threshold, copies included), n_text_links (other
    texts), n_copies (documents with this text)."""
    rows, texts = similar_classes(docs, threshold)
    return rows.join(texts, "key").select(
        "doc_id", "class_id", "n_links", "n_text_links", F.col("n_docs").alias("n_copies"))


def keep_one_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest
    doc_id stays (of repeated rows one), with all its columns."""
    _, texts = similar_classes(docs, threshold)
    keep = texts.where("is_first").select(F.col("key").alias("__keep_key"), F.col("rep").alias("__keep_id"))
    tagged = docs.withColumn("__key", F.unhex(F.md5(text_of())))
    return (tagged.join(keep, (F.col("__key") == F.col("__keep_key"))
                        & F.col("doc_id").cast("long").eqNullSafe(F.col("__keep_id")))
            .dropDuplicates(["__key", "__keep_id"]).drop("__key", "__keep_key", "__keep_id"))


def expected_recall(similarity: float, threshold: float = SIMILARITY) -> float:
    """Chance that a pair of this similarity becomes a candidate."""
    bands = bands_for(threshold, CANDIDATE_RECALL, ROWS)
    return 1 - math.pow(1 - similarity ** ROWS, bands)
