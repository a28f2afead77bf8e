"""Conversation structure repair by iterative-deepening A*.

``damage`` breaks rows by a checksum of their key; ``repair`` finds for every
conversation the cheapest edits that make its roles ``(s?(ua)+)?`` by initial.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit of blank
and duplicate rows), Insert an empty user or assistant row 5; a truncated row
that stays adds 5.  The search walks the edits depth first in ASCII order (D, I,
K, R) under a cost bound that rises to the least cost seen beyond it.  A table of
failed states (row, role state) holds the least cost each one still needs, so
that no state is entered again without a larger budget.  The first accepting
path is the cheapest and, among the cheapest, the ASCII-least.

A conversation may hold a large part of all rows.  Equal rows are counted before
they are shuffled, rows are range-sorted over all tasks, and a conversation of
more than ``PIECE`` rows is searched piece by piece: for every pair of role
states before and after a piece the same search gives cost and edits, and a fold
over the pieces picks the cheapest chain.  Pieces end with an edit of their last
row, so of two edit strings none begins the other and the fold is exact.  What is
gathered for one conversation is one letter per row, as its result holds it.  The
hash reads a conversation's rows as a sorted stream; SHA-256 is a chain, so this
stream is one task's work however long the conversation is.

Defined results: a null role or text is one space, and so is a null in the
checksum key; rows of a null conv_id are a conversation; rows of equal turn stand
in order of role and text; an empty role has no legal initial; conversations that
lost all rows have zeros, no edits and the hash of the empty string; no rows give
no rows; columns other than the four named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closurelens.session import materialize

PIECE = 64
_WHITE = " \t\n\x0b\x0c\r"
#: state of the roles so far: 0 none, 1 system, 2 user, 3 assistant; roles may end in 0 and 3
ENDS = (0, 3)
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: the only state that a new or changed role can lead to
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_NEVER = 1 << 60


def _least(symbol: str) -> int:
    """The least cost of one row whatever the state: D forced, capitals truncated,
    x a role that cannot be kept."""
    return 2 if symbol.isupper() else symbol == "x"


@lru_cache(maxsize=50_000)
def search(symbols: str, entry: int = 0, leave: int | None = None) -> tuple[int, str] | None:
    """Cost and letters of the cheapest, then ASCII-least edits of rows given as
    one symbol each (initial s, u, a or x; capital if truncated; D if it must go).

    From state ``entry`` to ``leave``, with an edit of the last row at the end; or,
    without ``leave``, to an accepted end, which may be inserted.  None if no edits
    lead there."""
    n = len(symbols)
    if leave == 0 and entry != 0 or leave == 1 and not (entry == 1 or entry == 0 and "s" in symbols.lower()):
        return None
    rest = [0] * (n + 1)
    for i in reversed(range(n)):
        rest[i] = rest[i + 1] + _least(symbols[i])
    needs: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def moves(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        if i == n:
            if leave is None:
                yield "I", 5, i, _NEXT[q]
            return
        s = symbols[i]
        yield "D", 2, i + 1, q
        yield "I", 5, i, _NEXT[q]
        if s != "D":
            more = 5 * s.isupper()
            if (q, s.lower()) in _KEEP:
                yield "K", more, i + 1, _KEEP[q, s.lower()]
            yield "R", 1 + more, i + 1, _NEXT[q]

    def walk(i: int, q: int, spent: int) -> int:
        """0 when the path reached the end, else the least total beyond the bound."""
        if i == n and (q in ENDS if leave is None else q == leave):
            return 0
        beyond = _NEVER
        for letter, cost, j, r in moves(i, q):
            total = spent + cost + max(rest[j], needs.get((j, r), 0))
            if total <= bound:
                path.append(letter)
                total = walk(j, r, spent + cost)
                if not total:
                    return 0
                path.pop()
            beyond = min(beyond, total)
        needs[i, q] = beyond - spent
        return beyond

    bound = rest[0]
    while found := walk(0, entry, 0):
        bound = found
    return bound, "".join(path)


def _fold(tables: Iterator[list]) -> tuple[int, str]:
    """Joins the pieces' tables (entry, leave, cost, letters).  Edit strings of
    different states differ before either ends, so their order is kept as a rank."""
    now = {0: (0, 0)}  # state -> cost, rank among the strings so far
    back: list[dict[int, tuple[int, str]]] = []
    for table in tables:
        best: dict[int, tuple[int, tuple[int, str], int]] = {}
        for entry, leave, cost, letters in table:
            if entry in now:
                c, rank = now[entry]
                new = (c + cost, (rank, letters), entry)
                best[leave] = min(best.get(leave, new), new)
        order = sorted(best, key=lambda q: best[q][1])
        now = {q: (best[q][0], order.index(q)) for q in best}
        back.append({q: (best[q][2], best[q][1][1]) for q in best})
    tail = {0: "", 1: "II", 2: "I", 3: ""}
    cost, _, q = min((c + 5 * len(tail[q]), rank, q) for q, (c, rank) in now.items())
    letters = [tail[q]]
    for step in reversed(back):
        q, part = step[q]
        letters.append(part)
    return cost, "".join(reversed(letters))


def damage(rows: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text and copies (adjacent equal rows).
    The checksum of ``conv_id:turn`` modulo 20 drops a row (0), empties its text (1),
    removes its sentence ends (2), repeats it (3) or makes its role user (4)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")]
    h = F.crc32(key) % 20
    return rows.where(h != 0).select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(h == 3, 2).otherwise(1).cast("long").alias("copies"))


def _lines(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, copies) with the fault of the first
    of each, its symbol and initial, and ``pos``, which orders the table."""
    lines = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    lines = lines.withColumn("digest", F.unhex(F.sha2("text", 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = (lines.groupBy(*[F.col(c).alias(f"{c}_") for c in ("conv_id", "role", "digest")])
            .agg(F.min(turn).alias("first"), F.count("*").alias("times")).where("times > 1"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("conv_id", "role", "digest")]
    end = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    lines = (lines.join(seen, same, "left")
             .select("conv_id", "turn", "role", "text", "copies", end.alias("end"),
                     F.coalesce(F.col("first") < turn, F.lit(False)).alias("again")))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    lines = (lines.withColumn("blank", F.col("end") == "").withColumn("again", F.col("again") & ~F.col("blank"))
             .withColumn("cut", ~F.col("blank") & ~F.col("again") & ~F.col("end").isin(".", "!", "?"))
             .withColumn("initial", initial)
             .withColumn("symbol", F.when(F.col("blank") | F.col("again"), "D")
                         .when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.drop("end").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialize(lines.withColumn("pos", F.monotonically_increasing_id()), "turns")


_PIECES = "conv_id {id}, shard long, piece long, symbols string, initials string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, shard, symbol, initial, copies) to pieces of one run each."""
    run, number, symbols, initials = None, 0, [], []
    schema = None

    def flush(rows: list) -> None:
        nonlocal number
        if symbols:
            rows.append((*run, number, "".join(symbols), "".join(initials)))
            number += 1
            symbols.clear(), initials.clear()

    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("shard", pa.int64()), ("piece", pa.int64()),
                            ("symbols", pa.string()), ("initials", pa.string())])
        rows: list = []
        for conv, shard, symbol, initial, copies in zip(*[c.to_pylist() for c in batch.columns]):
            if run != (conv, shard):
                flush(rows)
                run, number = (conv, shard), 0
            while copies:
                k = min(copies, PIECE - len(symbols))
                symbols.extend([symbol] + ["D"] * (k - 1))
                initials.extend([initial] * k)
                symbol, copies = "D", copies - k
                if len(symbols) == PIECE:
                    flush(rows)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
    if symbols:
        rows = []
        flush(rows)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_TABLE = "array<struct<entry:int,leave:int,cost:long,letters:string>>"


def _search_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole conversations are searched to their end, pieces for every pair of states."""
    for f in frames:
        out = []
        for symbols, initials, whole in zip(f.symbols, f.initials, f.n_rows == f.symbols.str.len()):
            if whole:
                table = [(0, 0, *search(symbols))]
            else:
                table = [(e, q, *r) for e in range(4) for q in range(4) if (r := search(symbols, e, q))]
            out.append((_illegal(initials), initials[0], initials[-1],
                        [dict(zip(("entry", "leave", "cost", "letters"), t)) for t in table]))
        yield f[["conv_id", "shard", "piece", "n_rows"]].assign(
            whole=f.n_rows == f.symbols.str.len(), illegal=[r[0] for r in out], head=[r[1] for r in out],
            last=[r[2] for r in out], states=[r[3] for r in out])


def _fold_pieces(pieces: pd.DataFrame) -> pd.DataFrame:
    f = pieces.sort_values(["shard", "piece"])
    cost, audit = _fold([tuple(t.values()) for t in table] for table in f.states)
    illegal = f.illegal.sum() + sum(_illegal(a + b) for a, b in zip(f["last"], f["head"][1:]))
    return pd.DataFrame({"conv_id": f.conv_id[:1].to_list(), "illegal": [illegal], "cost": [cost], "audit": [audit]},
                        ).astype({"conv_id": f.conv_id.dtype})


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, audit of the first, role, text, copies) to the hash of the
    repaired conversation; one conversation after the other, nothing kept of its texts."""
    conv = at = q = letters = sha = schema = None
    started = False

    def put(role: str, text: str) -> None:
        nonlocal started
        sha.update((("\n" if started else "") + f"{role}:{text}").encode())
        started = True

    def inserts() -> None:
        nonlocal at, q
        while at < len(letters) and letters[at] == "I":
            q, at = _NEXT[q], at + 1
            put(_ROLE[q], "")

    def close() -> list[dict]:
        if letters is None:
            return []
        inserts()
        return [{"conv_id": conv, "repaired_sha256": sha.hexdigest()}]

    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("repaired_sha256", pa.string())])
        out: list[dict] = []
        for c, audit, role, text, copies in zip(*[x.to_pylist() for x in batch.columns]):
            if audit is not None:
                out += close()
                conv, letters, at, q, sha, started = c, audit, 0, 0, hashlib.sha256(), False
                continue
            for _ in range(copies):
                inserts()
                edit, at = letters[at], at + 1
                if edit == "K":
                    q = _KEEP[q, role[0]]
                    put(role, text)
                elif edit == "R":
                    q = _NEXT[q]
                    put(_ROLE[q], text)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if letters is not None:
        yield pa.RecordBatch.from_pylist(close(), schema=schema)


def repair(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``original`` from the rows left of it (conv_id, turn,
    role, text, copies): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""
    kind = original.schema["conv_id"].dataType.simpleString()
    lines = _lines(rows)
    long = lambda c: F.col(c).cast("long")
    per_turn = lines.groupBy("conv_id", "turn").agg(
        F.sum("copies").alias("n_rows"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - 1 + F.col("again").cast("int"))).alias("duplicate"),
        F.sum(F.col("cut").cast("long")).alias("truncated"))
    counts = per_turn.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "blank", "duplicate", "truncated")],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    runs = (lines.select("conv_id", F.shiftright("pos", 33).alias("shard"), "pos", "symbol", "initial", "copies")
            .repartition("conv_id", "shard").sortWithinPartitions(F.asc_nulls_first("conv_id"), "shard", "pos")
            .select("conv_id", "shard", "symbol", "initial", "copies"))
    cut = runs.mapInArrow(_cut, _PIECES.format(id=kind))
    sized = cut.join(counts.select(F.col("conv_id").alias("c"), "n_rows"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    # searches cost time, not bytes: dealt to all tasks, which merging by size would undo
    n = int(original.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(sized.repartition(n, "conv_id", "shard", "piece").mapInPandas(
        _search_pieces, f"conv_id {kind}, shard long, piece long, n_rows long, whole boolean, illegal long, "
                        f"head string, last string, states {_TABLE}"), "turn-pieces")
    answers = found.where("whole").select(
        "conv_id", "illegal", F.col("states")[0]["cost"].alias("cost"), F.col("states")[0]["letters"].alias("audit")).union(
        found.where("not whole").groupBy("conv_id").applyInPandas(
            _fold_pieces, f"conv_id {kind}, illegal long, cost long, audit string"))
    answers = materialize(answers, "turn-answers")
    none = F.lit(None)
    stream = (answers.select("conv_id", "audit", none.cast("string").alias("role"), none.cast("string").alias("text"),
                             F.lit(0).cast("long").alias("copies"), F.lit(-1).cast("long").alias("pos"))
              .union(lines.select("conv_id", none.cast("string"), "role", "text", "copies", "pos")))
    hashes = (stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "pos").drop("pos")
              .mapInArrow(_hash, f"conv_id {kind}, repaired_sha256 string"))
    out = original.select("conv_id").distinct()
    for part in (counts, answers, hashes):
        part = part.withColumnRenamed("conv_id", "c")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(long(c), F.lit(0).cast("long")).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damages the rows and repairs what is left of every conversation."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    return repair(rows, damage(rows))


def oracle() -> str:
    """The same answer from a table over rows and states in place of the search."""
    white = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key,
  coalesce(role, ' ') AS r, coalesce(text, ' ') AS x FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
  lambda c, b: xor(c >> 8, t.crc[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS h FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE r END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text
  FROM h, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
p AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '{white}') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
  left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
f AS (SELECT *, seen AND NOT blank AS dup, NOT blank AND NOT seen
  AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut FROM p),
m(q, l, sym, c, q2, outrole) AS (VALUES (0,'','',0,0,''), (1,'','',0,1,''), (2,'','',0,2,''), (3,'','',0,3,''),
  (0,'I','',5,2,'u'), (0,'II','',10,3,'ua'), (1,'I','',5,2,'u'), (1,'II','',10,3,'ua'), (2,'I','',5,3,'a'), (3,'I','',5,2,'u')),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, ''  AS text FROM d
  UNION ALL
  SELECT conv_id, i, q, b.cost, b.audit, b.text FROM (
    SELECT s.conv_id, f.i, e.q2 AS q, min({{'cost': s.cost + m.c + e.c, 'audit': s.audit || m.l || e.l,
      'text': s.text || CASE m.outrole WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:'
        WHEN 'ua' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END
        || CASE e.l WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
        ELSE chr(10) || CASE e.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text END}}) AS b
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN m ON m.q = s.q,
    LATERAL (SELECT 'D' AS l, 2 AS c, m.q2 AS q2
      UNION ALL SELECT 'K', 5 * f.cut::INT, CASE WHEN f.ini = 's' THEN 1 WHEN f.ini = 'u' THEN 2 ELSE 3 END
        WHERE NOT f.blank AND NOT f.dup AND (f.ini = 's' AND m.q2 = 0 OR f.ini = 'u' AND m.q2 <> 2 OR f.ini = 'a' AND m.q2 = 2)
      UNION ALL SELECT 'R', 1 + 5 * f.cut::INT, CASE WHEN m.q2 = 2 THEN 3 ELSE 2 END WHERE NOT f.blank AND NOT f.dup) e
    GROUP BY ALL)),
z AS (SELECT conv_id, max(i) AS n FROM s GROUP BY 1),
a AS (SELECT s.conv_id, min({{'cost': s.cost + m.c, 'audit': s.audit || m.l, 'text': s.text ||
    CASE m.outrole WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:'
    WHEN 'ua' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END}}) AS b
  FROM s JOIN z ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.n = s.i JOIN m ON m.q = s.q WHERE m.q2 IN (0, 3) GROUP BY 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT c.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank,
  coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated,
  coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(a.b.cost, 0)::BIGINT AS cost, coalesce(a.b.audit, '') AS audit,
  sha256(coalesce(substr(a.b.text, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id"""
