"""Secret scans with an incremental blob ledger.

Every version of a path (a documents row) is content-addressed by the SHA-256
of its whole text.  The ledger is a Parquet folder with one row per (blob, rule
version) that has been scanned, with its findings.  A scan takes only the blobs
that the ledger lacks for the rule version, one row of text each, appends what
it found, and joins the ledger back to all paths.  Appends go through Spark's
write job, so a scan that is lost leaves no rows and is done again by the next.

A hot blob (many copies) is counted by a partial minimum, scanned once, and
joined back by a join that Spark can split.  Rows that repeat both id and text
are each scanned and leave one ledger row.

Base kinds: assign, access, hex.  The method adds well-known token formats
(``EXTRA``).  Spans are code point offsets, end exclusive.

Defined results: null text = empty text, which has no findings; one result row
per input row, repeated or null ids included; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closurelens.llm.common import shared_dir, text_of
from closurelens.session import materialize

RULE_VERSION = "2"
BASE = ("assign", "access", "hex")
#: letters of either case and no others: ignoring case would take the long s and the Kelvin sign too
_KEY = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", "password|passwd|secret|token|api_?key")
_ASSIGN = re.compile(rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: kind -> (text that must occur, pattern)
EXTRA = {
    "private_key": ("-----BEGIN", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    "code_host": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "chat": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "web_token": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
}
KINDS = BASE + tuple(EXTRA)


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every finding, in order."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    # a run of 24 or more holds a whole 24-character match, so shorter runs need no check
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for i, (mark, pattern) in enumerate(EXTRA.values(), len(BASE)):
        if mark in text:
            out += [(m.start(), i, m.end()) for m in pattern.finditer(text)]
    return sorted(out)


def _write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [find_secrets(t) for t in batch.column("text").to_pylist()]
        counts = [[sum(k == i for _, k, _ in r) for r in rows] for i in range(len(BASE))]
        base = [hashlib.sha256(_write([x for x in r if x[1] < len(BASE)]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("blob"), *[pa.array(c, pa.int64()) for c in counts],
             pa.array(base, pa.string()), pa.array([_write(r) for r in rows], pa.string())],
            ["blob", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])


_FOUND = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def read_ledger(spark: SparkSession, ledger: str, version: str = RULE_VERSION) -> DataFrame:
    """The ledger's rows of one rule version, one a blob (scans at one time may append the
    same findings twice); no rows where nothing is stored yet."""
    path = os.path.join(ledger, f"rules={version}")
    try:
        return spark.read.schema(_FOUND).parquet(path).dropDuplicates(["blob"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FOUND)


def scan(docs: DataFrame, ledger: str, version: str = RULE_VERSION) -> DataFrame:
    """Scans what the ledger at this folder lacks and returns the findings of all
    paths: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", text_of().alias("text")).select(
        "doc_id", F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    paths = materialize(keyed.select("doc_id", "blob"), "secret-paths")
    unseen = (paths.groupBy("blob").agg(F.min("doc_id").alias("rep"))
              .join(read_ledger(spark, ledger, version).select("blob"), "blob", "left_anti")
              .withColumnRenamed("blob", "b"))
    todo = (keyed.join(unseen, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("rep")))
            .select("blob", "text"))
    # repeated rows of one id and text find the same; their findings, not their texts, are made one
    todo.mapInArrow(_scan, _FOUND).dropDuplicates(["blob"]).write.mode("append").parquet(os.path.join(ledger, f"rules={version}"))
    return paths.join(read_ledger(spark, ledger, version), "blob").drop("blob")


def new_ledger(spark: SparkSession) -> str:
    return shared_dir(spark, "secret-ledger")


def oracle() -> str:
    """SQL of the base columns; the added kinds find nothing in the given tables."""
    places = """list_transform(range(1, len(m_{k}) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p_{k}[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'm': m_{k}[i]}})"""
    assign = f"""({_KEY})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = {"assign": assign, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    holds = {"assign": f"length(regexp_extract(x.m, '{assign}', 2)) >= 6",
             "access": "length(x.m) >= 20", "hex": "length(x.m) >= 24"}
    found = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS p_{k}"
                      for k, p in patterns.items())
    spans = ", ".join(
        f"list_transform(list_filter({places.format(k=k)}, lambda x: {holds[k]}), "
        f"lambda x: {{'s': x.s, 'k': {i}, 'e': x.s + length(x.m)}}) AS s_{k}" for i, k in enumerate(patterns))
    names = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {found.replace(patterns["hex"], "[0-9a-f]{24,}")} FROM d),
s AS (SELECT doc_id, {spans} FROM f),
w AS (SELECT *, coalesce(array_to_string(list_transform(
  list_sort(s_assign || s_access || s_hex), lambda x: [{names}][x.k + 1] || ':' || x.s || ':' || x.e), ','), '') AS spans FROM s)
SELECT doc_id, {', '.join(f'CAST(len(s_{k}) AS BIGINT) AS n_{k}' for k in BASE)}, sha256(spans) AS base_sha256, spans FROM w"""
