"""Exact top-k inner product search with a vector-approximation file.

Every vector becomes integers floor(256 * x).  Its approximation is the grid cell
of each component: cells are 2**``CELL_BITS`` wide, so a cell is the component
shifted right and needs no fitted range, and holds its components exactly.

Of equal vectors only the k + 1 smallest ids can be among a query's k best (its
own id aside), so the others are queries at most, never candidates; copies do not
pile up in a query's group.

1. Scan: tasks hold a block of queries and a block of approximations (numbers of
   blocks follow the row counts, so a task's blocks have bounded size) and take
   an upper and a lower bound of every score from the cells.  A candidate stays
   if its upper bound reaches the kth largest lower bound of its block.
2. The kth largest lower bound over all blocks cuts the survivors of each query
   again; the exact vectors of the rest are joined in.
3. Refinement: per query the candidates are visited in falling order of their
   upper bounds until the kth exact score is above every bound that is left.

Defined results: vectors that are null or hold a null or non-finite component
take no part, neither do rows without vec_id; shorter vectors count as padded
with zeros; repeated (vec_id, vector) rows count once and rows with equal vec_id
are not each other's candidates; fewer than k candidates give fewer rows; equal
scores go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closurelens.session import materialize

K = 5
CELL_BITS = 2
EVERY = 50
QUERY_BLOCK = 2_000
ROW_BLOCK = 50_000


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): the rows that take part, as integers, once each."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(e * 256).cast("long")).alias("v"))
            .dropDuplicates(["vec_id", "v"]))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while every sum stays below 2**53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(q: np.ndarray, cells: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all queries with all cells."""
    low = cells << bits
    base, slack = _dot(q, low), (1 << bits) - 1
    return base + slack * np.minimum(q, 0).sum(1)[:, None], base + slack * np.maximum(q, 0).sum(1)[:, None]


def _scan(width: int, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q = pdf.is_query.to_numpy()
        qs, cs = pdf[is_q], pdf[~is_q].sort_values("vec_id")
        out = []
        ids = cs.vec_id.to_numpy()
        cells = _matrix(cs.v, width)
        for a in range(0, len(qs), 256):  # bounded score blocks
            part = qs.iloc[a:a + 256]
            if not len(cs):
                break
            low, high = bounds(_matrix(part.v, width), cells)
            for i, qid in enumerate(part.vec_id.to_numpy()):
                other = ids != qid
                lows = low[i][other]
                if not len(lows):
                    continue
                cut = np.partition(lows, -k)[-k] if len(lows) > k else lows.min()
                keep = other & (high[i] >= cut)
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[keep], "low": low[i][keep], "high": high[i][keep]}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "low", "high")})

    return run


def _refine(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["high", "vec_id"], ascending=[False, True])
        q, rows = np.array(pdf.q.iloc[0], dtype=object), []
        for vec_id, high, v in zip(pdf.vec_id, pdf.high, pdf.v):
            if len(rows) >= k and high < rows[k - 1][0]:
                break
            n = min(len(q), len(v))
            rows.append((int((q[:n] * np.array(v[:n], dtype=object)).sum()) if n else 0, vec_id))
            rows.sort(key=lambda r: (-r[0], r[1]))
            del rows[k:]
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "rank": range(1, len(rows) + 1),
                             "vec_id": [r[1] for r in rows], "score": [r[0] for r in rows]})

    return run


def _kth_low(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        top = pdf.sort_values("low", ascending=False).groupby("query_id").head(k)
        yield top[["query_id", "low"]]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each vec_id divisible by ``every``."""
    rows = materialize(whole_vectors(vectors), "va-exact")
    n, n_queries, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0),
                                   F.max(F.size("v"))).first()
    width = max(1, width or 1)
    q_blocks, c_blocks = -(-max(1, n_queries) // QUERY_BLOCK), max(1, -(-n // ROW_BLOCK))
    # at least a task per core: small tables are cut finer
    c_blocks = max(c_blocks, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)) or 1)
    is_query = F.col("vec_id") % every == 0
    # Spark keeps k + 1 rows of each vector before the shuffle already
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    candidates = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    cells = candidates.select("vec_id", F.transform("v", lambda x: F.floor(x / (1 << CELL_BITS)).cast("long")).alias("v"),
                        F.lit(False).alias("is_query"),
                        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"),
                        F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)).cast("int").alias("cb"))
    queries = rows.where(is_query).select("vec_id", "v", F.lit(True).alias("is_query"),
                                          F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"),
                                          F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))
    found = materialize(queries.select("vec_id", "v", "is_query", "qb", "cb")
                        .unionByName(cells).groupBy("qb", "cb")
                        .applyInPandas(_scan(width, k), "query_id long, vec_id long, low long, high long"), "va-bounds")
    # the kth lower bound over all blocks, from k rows of each block at most
    best = found.mapInPandas(lambda it: _kth_low(it, k), "query_id long, low long").groupBy("query_id").applyInPandas(
        lambda pdf: pd.DataFrame({"q_id": [pdf.query_id.iloc[0]],
                                  "cut": [int(pdf.low.nlargest(k).iloc[-1]) if len(pdf) >= k else -(2**63)]}),
        "q_id long, cut long")
    left = found.join(best, found.query_id == best.q_id).where("high >= cut").select("query_id", "vec_id", "high")
    exact = (left.join(rows, "vec_id")
             .join(rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id"))
    return exact.groupBy("query_id").applyInPandas(_refine(k), "query_id long, rank int, vec_id long, score long")


def oracle() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}"""
