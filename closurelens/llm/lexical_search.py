"""Ranked lexical search over hashed max-sketches.

Index (every row of the documents, in blocks of about ``BLOCK_CHARS``): a document's
term counts fold into the coordinatewise maxima of ``SLOTS`` hashed coordinates,
stored sparsely, one byte each (255 stands for any larger count).  The same pass
counts the documents that hold each term, block by block, before the shuffle.

Search, for blocks of ``ITEMS`` items (the stated query set): the sketch coordinates
of the items' terms are looked up for a block of documents at once, and one product
with the items' weights gives an upper bound of every score, since a coordinate is
at least the count of each term that hashes to it and the score grows with the
count.  The texts with the highest bounds are scored exactly; what is left is
visited by falling bound, in batches that grow, until no bound reaches the k-th
exact score.  Texts that occur many times are bounded and scored once, and only
their k smallest ids can be among the answers.

What the driver holds is one block of items, the statistics of its terms and one
threshold per item.

Defined results: a null or empty text has no terms, is not counted and is never
found; a null doc_id ranks after all others; repeated rows are documents of their
own; equal rows of an item are one item, an item without terms has no rows, and
each text of a repeated item_id is ranked on its own; empty tables give no rows;
columns other than doc_id, text and item_id, text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closurelens.llm.common import text_of
from closurelens.session import materialize

K = 10
SLOTS = 1 << 16
BLOCK_CHARS = 3_000_000
ITEMS = 500
#: texts of a batch that are broadcast, at 50 bytes and one small list each; more are joined by a shuffle
BROADCAST_TEXTS = 100_000
#: texts per item in the first batch of exact scores, and the growth of later ones
FIRST, GROWTH = 32, 8
_MANY = 255
#: no impact is larger: (10^9 tf) div (1000 tf + 8 m) with m > 0
_TOP = 1_000_000
#: documents per product with the items' weights, and rows taken from a batch at once
_ROWS, _TAKEN = 500, 256
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


def slot_of(term: bytes, slots: int = SLOTS) -> int:
    return zlib.crc32(term) % slots


class _Numbers(dict):
    """term -> its number in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def length_part(n: np.ndarray | int, n_docs: int, n_terms: int):
    return 25 + 75 * n * n_docs // max(n_terms, 1)


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


_BLOCK = ("doc_ids array<{id}>, hashes binary, lengths binary, starts binary, slots binary, counts binary, "
          "n_docs long, n_terms long, terms array<binary>, dfs array<long>")


def _blocks(batches: Iterator[pa.RecordBatch], n_slots: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Documents to one row per block of ``chars`` characters."""
    ids, hashes, lengths, parts, numbers, size = [], [], [], [], _Numbers(), 0

    def close(kind: pa.DataType) -> pa.RecordBatch:
        nonlocal ids, hashes, lengths, parts, numbers, size
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
        term = np.concatenate(parts) if parts else np.empty(0, np.int64)
        pairs, tf = np.unique(doc << 32 | term, return_counts=True)
        doc, term = pairs >> 32, pairs & 0xFFFFFFFF
        slots = np.array([slot_of(t, n_slots) for t in numbers], np.int64)
        packed = np.sort(doc << 24 | slots[term] << 8 | np.minimum(tf, _MANY))
        place = packed >> 8
        packed = packed[np.append(place[1:] != place[:-1], True)] if len(place) else packed
        starts = np.searchsorted(packed >> 24, np.arange(len(ids) + 1))
        row = [ids, b"".join(hashes), np.array(lengths, np.int64).tobytes(), starts.astype(np.int64).tobytes(),
               ((packed >> 8) & 0xFFFF).astype(np.uint16).tobytes(), (packed & 0xFF).astype(np.uint8).tobytes(),
               sum(n > 0 for n in lengths), sum(lengths), list(numbers), np.bincount(term, minlength=len(numbers)).tolist()]
        types = [pa.list_(kind), *[pa.binary()] * 5, pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        ids, hashes, lengths, parts, numbers, size = [], [], [], [], _Numbers(), 0
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for a in range(0, batch.num_rows, _TAKEN):
            some = batch.slice(a, _TAKEN)
            for doc_id, raw in zip(some.column("doc_id").to_pylist(), some.column("text").cast(pa.binary()).to_pylist()):
                words = terms_of(raw)
                ids.append(doc_id), lengths.append(len(words)), hashes.append(hashlib.sha256(raw).digest())
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                size += len(raw) + 200
                if size >= chars:
                    yield close(kind)
    if ids:
        yield close(kind)


class Index:
    """Sketches, document frequencies and the copies of each text, as written tables."""

    def __init__(self, documents: DataFrame, slots: int = SLOTS, block_chars: int = BLOCK_CHARS):
        self.slots = slots
        self.docs = documents.select("doc_id", text_of().alias("text"))
        self.kind = documents.schema["doc_id"].dataType.simpleString()
        self.blocks = materialize(self.docs.mapInArrow(lambda rows: _blocks(rows, slots, block_chars),
                                                       _BLOCK.format(id=self.kind)), "sketches")
        total = self.blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        self.n_docs, self.n_terms = total[0] or 0, total[1] or 0
        self.dfs = materialize(self.blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x"))
                               .groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df")), "sketch-terms")
        held = self.blocks.select("hashes", F.posexplode("doc_ids").alias("i", "doc_id")).select(
            F.expr("substring(hashes, 32 * i + 1, 32)").alias("hash"), "doc_id")
        order = Window.partitionBy("hash").orderBy(F.asc_nulls_last("doc_id"))
        self.copies = materialize(held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= K), "copies")


def _bounds(columns: np.ndarray, weights: np.ndarray, floors: np.ndarray, most: int, n_docs: int, n_terms: int) -> Callable:
    """(item, hash, bound) of distinct texts whose bound reaches the item's floor; if
    ``most`` is not 0, the ``most`` highest of each item in the task only."""
    loose = 1.0 if (weights.sum(axis=0) * _TOP < 2.0 ** 53).all() else 1 + 1e-9

    def highest(held: dict[tuple[int, bytes], int], low: np.ndarray) -> dict[tuple[int, bytes], int]:
        kept, times = {}, Counter()
        for (q, h), b in sorted(held.items(), key=lambda x: (x[0][0], -x[1])):
            if times[q] < most:
                kept[q, h] = b
                times[q] += 1
                if times[q] == most:
                    low[q] = b
        return kept

    def batch_of(item: list, hashes: list, bound: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(hashes, pa.binary()), pa.array(bound, pa.int64())], ["item", "hash", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}
        low = floors.copy()
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                hashes = [row["hashes"][i:i + 32] for i in range(0, len(row["hashes"]), 32)]
                once = np.array(sorted({h: i for i, h in reversed(list(enumerate(hashes)))}.values()))
                m = length_part(np.frombuffer(row["lengths"], np.int64), n_docs, n_terms)
                starts = np.frombuffer(row["starts"], np.int64)
                col = columns[np.frombuffer(row["slots"], np.uint16)]
                hit = col >= 0
                doc, col = np.repeat(np.arange(len(m)), np.diff(starts))[hit], col[hit]
                tf = np.frombuffer(row["counts"], np.uint8)[hit].astype(np.int64)
                r = np.where(tf == _MANY, _TOP, impact(tf, m[doc]))
                item, text, bound = [], [], []
                for a in range(0, len(m), _ROWS):
                    i, j = np.searchsorted(doc, [a, a + _ROWS])
                    sketch = np.zeros((min(_ROWS, len(m) - a), len(weights)))
                    sketch[doc[i:j] - a, col[i:j]] = r[i:j]
                    mine = once[(once >= a) & (once < a + _ROWS)]
                    b = np.floor(sketch[mine - a] @ weights * loose)
                    keep = b >= low
                    if most and len(mine) > most:
                        keep &= b >= np.partition(b, len(mine) - most, axis=0)[len(mine) - most]
                    d, q = np.nonzero(keep)
                    item.append(q), text.append(mine[d]), bound.append(b[d, q].astype(np.int64))
                item, text, bound = [np.concatenate(x).tolist() for x in (item, text, bound)]
                text = [hashes[t] for t in text]
                if most:
                    held.update(zip(zip(item, text), bound))
                    held = highest(held, low)
                else:
                    yield batch_of(item, text, bound)
        yield batch_of([q for q, _ in held], [h for _, h in held], list(held.values()))

    return run


def _exact(items: list[Counter], weights: dict[bytes, int], n_docs: int, n_terms: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, raw, wanted in zip(batch.column("hash").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(),
                                      batch.column("items").to_pylist()):
                words = terms_of(raw)
                m = length_part(len(words), n_docs, n_terms)
                part = {t: weights[t] * impact(tf, m) for t, tf in Counter(filter(weights.__contains__, words)).items()}
                out += [(i, h, sum(times * part.get(t, 0) for t, times in items[i].items())) for i in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()),
                 pa.array([o[2] for o in out], pa.int64())], ["item", "hash", "score"])

    return run


def _search_block(index: Index, items: list, first: int) -> DataFrame:
    """The answers (item_id, rank, doc_id, score) for a bounded list of items."""
    spark = index.docs.sparkSession
    bags = [Counter(terms_of((r.text or "").encode())) for r in items]
    words = spark.createDataFrame([(t,) for t in set().union(*bags)], "term binary")
    found = {bytes(r.term): r.df for r in index.dfs.join(words, "term").collect()}
    w = {t: weight(df, index.n_docs) for t, df in found.items()}
    slots = sorted({slot_of(t, index.slots) for t in w})
    columns = np.full(index.slots, -1, dtype=np.int32)
    columns[slots] = np.arange(len(slots))
    matrix = np.zeros((len(slots), len(bags)))
    for i, bag in enumerate(bags):
        for t, times in bag.items():
            if t in w:
                matrix[columns[slot_of(t, index.slots)], i] += times * w[t]
    stats = (index.n_docs, index.n_terms)
    schema = "item int, hash binary, bound long"
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "hash")

    def highest(rows: DataFrame, most: int) -> DataFrame:
        return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")

    def score(pairs: DataFrame) -> DataFrame:
        """Exact scores of written (item, hash) pairs; each text is read once."""
        wanted = pairs.groupBy("hash").agg(F.collect_list("item").alias("items"))
        least = index.copies.where("place = 1").select("hash", F.col("doc_id").alias("id"))
        wanted = materialize(wanted.join(least, "hash"), "search-texts")
        if wanted.count() <= BROADCAST_TEXTS:
            wanted = F.broadcast(wanted)
        rows = (index.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")))
                .where(F.unhex(F.sha2("text", 256)) == F.col("hash")).select("hash", "text", "items"))
        return materialize(rows.mapInArrow(_exact(bags, w, *stats), "item int, hash binary, score long")
                           .dropDuplicates(["item", "hash"]), "search-scores")

    def answers(scored: DataFrame) -> DataFrame:
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return (scored.where("score > 0").join(index.copies, "hash")
                .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K))

    def thresholds(scored: DataFrame) -> np.ndarray:
        floors = np.ones(len(bags))
        for r in answers(scored).where(F.col("rank") == K).select("item", "score").collect():
            floors[r.item] = r.score
        return floors

    def bounds(floors: np.ndarray, most: int) -> DataFrame:
        run = _bounds(columns, matrix, floors, most, *stats)
        return (index.blocks.select("hashes", "lengths", "starts", "slots", "counts")
                .mapInArrow(run, schema).dropDuplicates(["item", "hash"]))

    scored = score(materialize(highest(bounds(np.ones(len(bags)), first), first), "search-first"))
    floors, most = thresholds(scored), first
    rest = materialize(bounds(floors, 0).join(scored, ["item", "hash"], "left_anti"), "search-rest")
    while not rest.isEmpty():
        most *= GROWTH
        batch = materialize(highest(rest, most), "search-batch")
        scored = scored.union(score(batch))
        floors = thresholds(scored)
        reach = spark.createDataFrame([(i, int(f)) for i, f in enumerate(floors)], "item int, floor long")
        rest = materialize(rest.join(batch, ["item", "hash"], "left_anti").join(reach, "item")
                           .where("bound >= floor").drop("floor"), "search-rest")
    named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    return answers(scored).join(named, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, slots: int = SLOTS, first: int = FIRST,
           item_block: int = ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The K documents of highest score for every item: item_id, rank, doc_id, score."""
    index = Index(documents, slots, block_chars)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    blocks = -(-items.count() // item_block)
    parts = []
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if mine:
            parts.append(materialize(_search_block(index, mine, first), "search-answers"))
    none = documents.sparkSession.createDataFrame([], f"item_id long, rank int, doc_id {index.kind}, score long")
    return reduce(DataFrame.union, parts, none)


def oracle() -> str:
    return """
WITH p AS (SELECT '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+' AS p),
d AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(text, p)) AS t FROM documents, p),
q AS (SELECT i, item_id, unnest(regexp_extract_all(text, p)) AS t FROM
  (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)), p),
f AS (SELECT row, doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT row, sum(tf)::BIGINT AS n FROM f GROUP BY 1),
a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY t, n_docs),
u AS (SELECT i, item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT i, item_id, row, doc_id,
  sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM u JOIN w USING (t) JOIN f USING (t) JOIN n USING (row), a GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM s WHERE score > 0) WHERE rank <= 10"""
