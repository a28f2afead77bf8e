"""Hidden Markov language model, trained by Baum-Welch, and its exact scores.

Tokens of a text: its words (runs of other than ASCII white space, A-Z
lower-cased), then one end.  The base score is a unigram with add-one counts.
The model has ``STATES`` latent states; state k emits a class g of words, and the
class emits the word by its count: b_k(w) = B_k(g) (c(w) + 1) / (N_g + V_g + 1).
The ``top`` most frequent words and the end are classes of their own, all other
words share ``forms`` classes by their ending and length, one unknown word in
each.  The second factor does not depend on the state, so that Baum-Welch needs
only classes: the parameters have a fixed size, while counts of all words of the
corpus stay in a table and are joined.

Every training text takes part in every round whole.  A task adds up the expected
counts of its texts, Spark sums them over the tasks in fixed point (the same sums
in any order), and the driver holds the sums: states x classes.  Scores are the
scaled forward recursion over the whole text in double precision.

Words are looked up block by block: texts are cut into blocks of about
``BLOCK_CHARS``, a block's distinct words are joined to the corpus counts, and the
answer returns to the block, so that a word travels once per block and not once
per occurrence, and no task holds more words than its block.

Defined results: a null text is the empty text, which is one end; a null doc_id is
the empty string in the split and trains; repeated rows count each; without
training rows every word is unknown and the base is log10 1 = 0 a token; no rows
give no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closurelens.llm.common import text_of
from closurelens.session import materialize

STATES = 8
TOP, FORMS = 8192, 4096
#: frequent words whose counts every task holds; the others are joined
COMMON = 131_072
ROUNDS = 6
BLOCK_CHARS = 3_000_000
#: tokens of the texts that are sorted by length together, of one batch, and of one stretch of a long text
WINDOW, BATCH, STRETCH = 4_000_000, 500_000, 1_000_000
#: pseudo-count of the class distribution in every state, and of the transitions
SMOOTH = 200.0
_STAY = 0.9
_FIXED = 1 << 20
#: the end's key; no word holds a space
END = b" "


def key_of(word: bytes) -> bytes:
    """The word, or for a very long one its digest, marked by a space."""
    return word if len(word) <= 64 else b" " + hashlib.sha256(word).digest()


def _compress(raw: bytes) -> bytes:
    return zstandard.compress(raw, 1)


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all low bytes first, compressed."""
    return _compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _unpack_words(lengths: bytes, joined: bytes) -> list[bytes]:
    ends = np.cumsum(_unpack(lengths)).tolist()
    raw = zstandard.decompress(joined)
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_BLOCK = ("block long, doc_ids array<{id}>, held array<boolean>, lengths binary, tokens binary, "
          "word_lengths binary, joined binary, words array<binary>, counts array<long>")


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    ids, held, parts, numbers, size = [], [], [], _Numbers(), 0

    def close(kind: pa.DataType) -> pa.RecordBatch:
        nonlocal ids, held, parts, numbers, size
        words = [key_of(w) for w in numbers]
        train = [p for p, h in zip(parts, held) if not h]
        counts = np.bincount(np.concatenate(train) if train else np.empty(0, np.int64), minlength=len(numbers))
        row = [uuid.uuid4().int >> 65, ids, held, np.array([len(p) for p in parts], np.int64).tobytes(),
               _pack(np.concatenate(parts)), _pack(np.array([len(w) for w in words])), _compress(b"".join(words)),
               words, counts.tolist()]
        types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), *[pa.binary()] * 4,
                 pa.list_(pa.binary()), pa.list_(pa.int64())]
        ids, held, parts, numbers, size = [], [], [], _Numbers(), 0
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                          [f.split()[0] for f in _BLOCK.split(", ")])

    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for a in range(0, batch.num_rows, 256):
            some = batch.slice(a, 256)
            for doc_id, out, raw in zip(some.column("doc_id").to_pylist(), some.column("held_out").to_pylist(),
                                        some.column("text").cast(pa.binary()).to_pylist()):
                words = raw.lower().split()
                words.append(END)
                ids.append(doc_id), held.append(out)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                size += len(raw) + 100
                if size >= chars:
                    yield close(kind)
    if ids:
        yield close(kind)


@dataclass
class Classes:
    """Classes of words: the end 0, frequent words 1.., endings after them."""

    top: dict[bytes, int]
    forms: int

    @property
    def n(self) -> int:
        return 1 + len(self.top) + self.forms

    def of(self, word: bytes) -> int:
        if word == END:
            return 0
        if word in self.top:
            return self.top[word]
        return 1 + len(self.top) + zlib.crc32(word[-3:] + bytes([min(len(word), 15)])) % self.forms


@dataclass
class Model:
    """Parameters of a fixed size: first (K), moves (K, K), emits (C, K), mass (C)."""

    classes: Classes
    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    mass: np.ndarray


def _class_sums(batches: Iterator[pa.RecordBatch], classes: Classes) -> Iterator[pa.RecordBatch]:
    n, v = np.zeros(classes.n, np.int64), np.zeros(classes.n, np.int64)
    for batch in batches:
        g = np.array([classes.of(w) for w in batch.column("word").to_pylist()], np.int64)
        np.add.at(n, g, batch.column("c").to_numpy())
        np.add.at(v, g, 1)
    g = np.flatnonzero(v)
    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n[g]), pa.array(v[g])], ["g", "n", "v"])


def _coder(classes: Classes, mass: np.ndarray, common: list[tuple[bytes, int]], total: int, distinct: int):
    """Blocks and the counts of their words to one row per text: its classes, what it
    knows, its base score and the part of its score that no state changes."""
    place = {w: i for i, (w, _) in enumerate(common)}
    held = np.array([c for _, c in common] + [0], np.int64)
    held_g = np.array([classes.of(w) for w, _ in common] + [0], np.int64)

    def code(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in block.itertuples():
            words = _unpack_words(row.word_lengths, row.joined)
            at = np.array([place.get(w, -1) for w in words], np.int64)
            c, g = held[at], held_g[at]
            c[found.i.to_numpy()] = found.c.to_numpy()
            rare = np.flatnonzero(at < 0)
            g[rare] = [classes.of(words[i]) for i in rare]
            base, part = np.log10((c + 1) / (total + distinct + 1)), np.log10((c + 1) / mass[g])
            lengths = np.frombuffer(row.lengths, np.int64)
            tokens = _unpack(row.tokens)
            starts = np.cumsum(lengths) - lengths
            known = np.add.reduceat((c > 0)[tokens].astype(np.int64), starts)
            coded = g.astype(np.uint16)[tokens]
            out.append(pd.DataFrame({
                "doc_id": list(row.doc_ids), "held_out": list(row.held), "n_tokens": lengths, "n_known": known,
                "base_score": np.add.reduceat(base[tokens], starts), "part": np.add.reduceat(part[tokens], starts),
                "classes": [_compress(coded[a:a + n].tobytes()) for a, n in zip(starts, lengths)]}))
        return pd.concat(out) if out else pd.DataFrame(
            {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "part", "classes")})

    return code


def _batches(texts: Iterable[tuple[np.ndarray, object]]) -> Iterator[list[tuple[np.ndarray, object]]]:
    """Texts with their tags in batches of like length, longest first."""
    def cut(window: list) -> Iterator[list]:
        window.sort(key=lambda x: -len(x[0]))
        batch, size = [], 0
        for x in window:
            batch.append(x)
            size += len(x[0])
            if size >= BATCH:
                yield batch
                batch, size = [], 0
        if batch:
            yield batch

    window, size = [], 0
    for x in texts:
        window.append(x)
        size += len(x[0])
        if size >= WINDOW:
            yield from cut(window)
            window, size = [], 0
    yield from cut(window)


class _Stack:
    """Texts sorted by falling length, laid out by time: at step t the first n[t]
    texts are alive and take places o[t] to o[t + 1]."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.n = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        self.o = np.concatenate([[0], np.cumsum(self.n)])
        self.symbols = np.empty(self.o[-1], np.uint16)
        for j, t in enumerate(texts):
            self.symbols[self.o[:len(t)] + j] = t
        self.cuts = [0]
        for t in range(len(self.n)):
            if self.o[t + 1] - self.o[self.cuts[-1]] > STRETCH and t > self.cuts[-1]:
                self.cuts.append(t)
        self.cuts.append(len(self.n))


def _forward(s: _Stack, model: Model, a: int, b: int, before: np.ndarray | None, emits: np.ndarray):
    """Scaled forward recursion over steps a to b: alphas, scales and the last alphas."""
    o = (s.o[a:b + 1] - s.o[a]).tolist()
    alpha = np.take(emits, s.symbols[s.o[a]:s.o[b]].astype(np.int64), axis=0)
    scale = np.empty(len(alpha), emits.dtype)
    ones = np.ones(emits.shape[1], emits.dtype)
    moves = model.moves.astype(emits.dtype)
    now = before
    for t in range(b - a):
        x = alpha[o[t]:o[t + 1]]
        x *= model.first if now is None else now[:len(x)] @ moves
        c = np.dot(x, ones, out=scale[o[t]:o[t + 1]])
        x /= c[:, None]
        now = x
    return alpha, scale, now


def _expected(texts: list[np.ndarray], model: Model) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood and expected counts of first states, moves and (class, state)."""
    s, k = _Stack(texts), len(model.first)
    emits = model.emits.astype(np.float32)
    moves = model.moves.astype(np.float32)
    back = np.ascontiguousarray(moves.T)
    starts = [None]
    for a, b in zip(s.cuts[:-2], s.cuts[1:-1]):
        starts.append(_forward(s, model, a, b, starts[-1], emits)[2].copy())
    total, first, pairs, counts = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((len(emits), k))
    after = None  # emission x beta / scale of the first step after the stretch
    for a, b, before in list(zip(s.cuts[:-1], s.cuts[1:], starts))[::-1]:
        alpha, scale, _ = _forward(s, model, a, b, before, emits)
        total += np.log(scale, dtype=np.float64).sum()
        o = (s.o[a:b + 1] - s.o[a]).tolist()
        symbols = s.symbols[s.o[a]:s.o[b]].astype(np.int64)
        seen = np.take(emits, symbols, axis=0)
        seen /= scale[:, None]
        beta = np.ones_like(seen)
        for t in range(b - a - 1, -1, -1):
            x = beta[o[t]:o[t + 1]]
            if after is not None:
                x[:len(after)] = after @ back
            after = seen[o[t]:o[t + 1]]
            after *= x
        n = s.n[a:b]
        before_each = np.arange(n[0], len(alpha)) - np.repeat(n[:-1], n[1:])
        pairs += alpha[before_each].T @ seen[n[0]:]
        if before is not None:
            pairs += before[:n[0]].T @ after
        alpha *= beta
        if a == 0:
            first += alpha[:n[0]].sum(axis=0)
        for j in range(k):
            counts[:, j] += np.bincount(symbols, weights=alpha[:, j].astype(np.float64), minlength=len(counts))
    return total, first, pairs * model.moves, counts


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, None]]:
    for batch in batches:
        for x in batch.column("classes"):
            yield np.frombuffer(zstandard.decompress(x.as_buffer()), np.uint16), None


def _expect(model: Model):
    """Rows (g, sums): g = -1 likelihood, -2 first states, -3 - k moves from state k,
    else a class's expected count by state; fixed point."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.first)
        sums = {}
        for batch in _batches(_texts(batches)):
            total, first, pairs, counts = _expected([x for x, _ in batch], model)
            g = np.flatnonzero(counts.any(axis=1))
            part = np.vstack([np.full((1, k), total / k), first[None], pairs, counts[g]])
            for key, row in zip([-1, -2, *range(-3, -3 - k, -1), *g.tolist()], np.rint(part * _FIXED).astype(np.int64)):
                sums[key] = sums[key] + row if key in sums else row
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([r.tolist() for r in sums.values()], pa.list_(pa.int64()))], ["g", "sums"])

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, dict]]:
            for batch in batches:
                rest = batch.drop_columns(["classes"])
                for x, i in zip(batch.column("classes"), range(batch.num_rows)):
                    yield np.frombuffer(zstandard.decompress(x.as_buffer()), np.uint16), rest.slice(i, 1)

        for batch in _batches(rows()):
            s = _Stack([x for x, _ in batch])
            logs, now = np.zeros(len(batch)), None
            for a, b in zip(s.cuts[:-1], s.cuts[1:]):
                _, scale, now = _forward(s, model, a, b, now, model.emits)
                now = now.copy()
                text = np.arange(len(scale)) - np.repeat(s.o[a:b] - s.o[a], s.n[a:b])
                logs += np.bincount(text, weights=np.log10(scale), minlength=len(logs))
            table = pa.Table.from_batches([r for _, r in batch]).combine_chunks()
            out = table.append_column("score", pa.array(logs + table.column("part").to_numpy())).drop_columns(["part"])
            yield from out.to_batches()

    return run


def _start(classes: Classes, mass: np.ndarray, states: int) -> Model:
    """States that stay, with class distributions scattered about the corpus's."""
    rng = np.random.default_rng(11)
    p = mass / mass.sum()
    emits = p[:, None] * np.exp(rng.normal(0, 1.0, (classes.n, states)))
    moves = np.full((states, states), (1 - _STAY) / max(states - 1, 1))
    np.fill_diagonal(moves, _STAY if states > 1 else 1.0)
    return Model(classes, np.full(states, 1 / states), moves, emits / emits.sum(axis=0), mass)


def baum_welch(coded: DataFrame, model: Model, rounds: int) -> tuple[Model, list[float]]:
    """Rounds of Baum-Welch over written texts (classes); the log-likelihood before each."""
    k, p = len(model.first), model.mass / model.mass.sum()
    track = []
    for _ in range(rounds):
        sums = (coded.select("classes").mapInArrow(_expect(model), "g long, sums array<long>")
                .groupBy("g").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(k)]).collect())
        if not sums:
            break
        rows = {r.g: np.array(r[1:], np.float64) / _FIXED for r in sums}
        track.append(float(rows[-1].sum()))
        moves = np.stack([rows[-3 - j] for j in range(k)]) + 1.0
        counts = np.zeros((len(p), k))
        for g, row in rows.items():
            if g >= 0:
                counts[g] = row
        counts += SMOOTH * p[:, None]
        first = rows[-2] + 1.0
        model = Model(model.classes, first / first.sum(), moves / moves.sum(axis=1, keepdims=True),
                      counts / counts.sum(axis=0), model.mass)
    return model, track


def _least_count(counts: DataFrame, wanted: int) -> int:
    """The largest bound that at least ``wanted`` words reach (1 if none does), from the
    numbers of words by the leading 12 bits of their count, so that a sort by count
    meets few more words than it keeps."""
    low = F.greatest(F.floor(F.log2("c")) - 11, F.lit(0)).cast("int")
    bins = counts.select(low.alias("s"), "c").selectExpr("shiftleft(shiftright(c, s), s) AS least")
    have = 0
    for r in sorted(bins.groupBy("least").count().collect(), reverse=True):
        have += r["count"]
        if have >= wanted:
            return r.least
    return 1


def language_scores(documents: DataFrame, held_out: Column, states: int = STATES, top: int = TOP, forms: int = FORMS,
                    rounds: int = ROUNDS, common: int = COMMON, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Scores every text by the model of the rows that are not held out: doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if not 0 < 1 + top + forms <= 65536:
        raise ValueError("top + forms must be below 65536")
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", held_out.alias("held_out"), text_of().alias("text"))
    blocks = materialize(docs.mapInArrow(lambda rows: _blocks(rows, block_chars), _BLOCK.format(id=kind)), "lm-blocks")
    counts = materialize(
        blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).where("x.counts > 0")
        .groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("c")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = F.col("word") == F.lit(bytearray(END))
    # the end first, then words by falling count: 64 bytes at most each
    wanted = 1 + max(top, common)
    least = _least_count(counts, wanted)
    frequent = counts.where((F.col("c") >= least) | end).orderBy(F.desc(end), F.desc("c"), "word").limit(wanted).collect()
    known = {bytes(r.word): r.c for r in frequent}
    classes = Classes({w: i for i, w in enumerate([w for w in known if w != END][:top], 1)}, forms)
    n, v = np.zeros(classes.n, np.int64), np.zeros(classes.n, np.int64)
    for r in (counts.mapInArrow(lambda rows: _class_sums(rows, classes), "g long, n long, v long")
              .groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()):
        n[r.g], v[r.g] = r.n, r.v
    mass = (n + v + ((n == 0) | (np.arange(classes.n) > len(classes.top)))).astype(np.float64)

    spark = documents.sparkSession
    listed = spark.createDataFrame([(w,) for w in known] or [(END,)], "word binary")
    places = blocks.select(F.col("block").alias("b"), F.posexplode("words").alias("i", "word")).join(F.broadcast(listed), "word", "left_anti")
    found = places.join(counts, "word").select("b", "i", "c")
    code = _coder(classes, mass, list(known.items()), total, distinct)
    coded = materialize(
        blocks.drop("words", "counts").groupBy("block").cogroup(found.groupBy("b")).applyInPandas(
            code, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, part double, classes binary"),
        "lm-coded")
    model, _ = baum_welch(coded.where("not held_out"), _start(classes, mass, states), rounds)
    scored = coded.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                          "base_score", "part", "classes")
    return scored.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                                            "train_tokens long, base_score double, score double")


def held_out_rows() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def language_report(documents: DataFrame) -> DataFrame:
    return language_scores(documents, held_out_rows())
