"""Toxicity: a lexicon learned from labelled documents, matched with Levenshtein
automata run over the lexicon's trie, and weighed by context windows.

Training (labels of rows whose crc32(doc_id as text) mod 5 is not 0, at most
``TRAIN_ROWS`` of them in order of a hash of the id): word and word-beginning
counts by label are taken on the executors; terms that occur significantly more
in toxic documents become the lexicon (at most ``TERMS``); a logistic model is
fitted on the features of the same rows (``TRAIN_ROWS`` rows of a few numbers).

Scoring: a token matches a term when the token, or for a word beginning its
start, is within the allowed edits (none under five letters, one up to eight,
two beyond; beginnings and terms of weak evidence allow none).  A hit counts as quotation when it stands in
quotation marks or a reporting word stands in the ``WINDOW`` words before it,
as address when a second-person word is near; quoted and other hits are separate
features.  Only the text enters a score.

Defined results: null and empty texts are scored as a text without words; a
null doc_id is in no remainder class, so it is not held out and never trained
on; without labelled toxic and other rows the lexicon is empty and every score
is the share of toxic rows (0 without rows); one result row per input row.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closurelens.llm.common import text_of
from closurelens.session import materialize

TRAIN_ROWS = 20_000
TERMS = 60
#: least signed log-likelihood ratio of a term, least log odds of one that allows edits
MIN_RATIO, FUZZY_FROM = 30.0, 4.0
STEM_LENGTHS = (4, 5, 6, 7)
MIN_DOCS = 4
WINDOW = 5
#: stripped from the ends of a token
EDGES = string.punctuation + "“”„«»‘’¿¡…–—"
#: fixed word lists: reporting words, second person, quotation marks
REPORTING = frozenset("said says wrote writes called quote quoted quoting term word phrase slur insult "
                      "mot terme insulte wort begriff palabra insulto dit sagt dijo".split())
SECOND_PERSON = frozenset("you your yours u ur tu ton vous du dein ihr tú usted".split())
QUOTES = "\"“”„«»‘’"
FEATURES = 9


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) <= 8 else 2


class Trie:
    """Terms by letter; a node is (children, term number or -1, most edits that a
    term below allows).  A term within e edits of a token leaves one of its e + 1
    pieces untouched, as the token's start, its end or inside it; tokens without
    such a piece are not walked."""

    def __init__(self, terms: list[tuple[str, bool, bool]]):
        self.allowed = [edits_allowed(t) if fuzzy else 0 for t, _, fuzzy in terms]
        self.root: list = [{}, -1, 0]
        self.stems = {t: i for i, (t, stem, _) in enumerate(terms) if stem}
        self.words = {t: i for i, (t, stem, _) in enumerate(terms) if not stem}
        starts: set[str] = set()
        ends: set[str] = set()
        inside: set[str] = set()
        for term, i in self.words.items():
            e = self.allowed[i]
            if not e:
                continue
            cut = [len(term) * j // (e + 1) for j in range(e + 2)]
            pieces = [term[x:y] for x, y in zip(cut, cut[1:])]
            starts.add(pieces[0])
            ends.add(pieces[-1])
            inside.update(pieces[1:-1])
            node = self.root
            for c in term:
                node[2] = max(node[2], e)
                node = node[0].setdefault(c, [{}, -1, 0])
            node[1], node[2] = i, max(node[2], e)
        # one scan of a token: any piece in its place, or a word beginning
        ways = [f"{before}(?:{'|'.join(map(re.escape, sorted(some)))}){after}" for before, some, after in (
            ("^", starts | self.stems.keys(), ""), ("", ends, r"\Z"), ("", inside, "")) if some]
        self.near = re.compile("|".join(ways) or "(?!)").search
        spread = [(len(t), self.allowed[i]) for t, i in self.words.items() if self.allowed[i]]
        self.shortest = min((n - e for n, e in spread), default=10**9)
        self.longest = max((n + e for n, e in spread), default=0)

    def find(self, token: str) -> tuple[int, int] | None:
        """(term number, edits) of the nearest term, None if none is near enough."""
        i = self.words.get(token)
        if i is not None:
            return i, 0
        if not self.near(token):
            return None
        if self.shortest <= len(token) <= self.longest:
            best = self.walk(token)
            if best is not None:
                return best
        for n in STEM_LENGTHS[::-1]:
            i = self.stems.get(token[:n]) if len(token) >= n else None
            if i is not None:
                return i, 0
        return None

    def walk(self, token: str) -> tuple[int, int] | None:
        """The Levenshtein automaton of the token stepped along the trie.  Its state
        is one integer per number of edits, whose bit j tells that the letters so
        far are within that many edits of the token's first j letters; a branch
        ends when no bit is left within what the terms below allow."""
        n, full = len(token), (2 << len(token)) - 1
        at: dict[str, int] = {}
        for j, t in enumerate(token):
            at[t] = at.get(t, 0) | 1 << j
        best = None
        stack = [(self.root, 1, 3 & full, 7 & full)]
        while stack:
            (children, _, _), r0, r1, r2 = stack.pop()
            for c, node in children.items():
                hit = at.get(c, 0)
                s0 = (r0 & hit) << 1
                s1 = ((r1 & hit) << 1 | r0 | r0 << 1 | s0 << 1) & full
                s2 = ((r2 & hit) << 1 | r1 | r1 << 1 | s1 << 1) & full if node[2] > 1 else 0
                if not (s0 | s1 | s2):
                    continue
                term = node[1]
                if term >= 0:
                    edits = 0 if s0 >> n else 1 if s1 >> n else 2 if s2 >> n else 3
                    if edits <= self.allowed[term] and (best is None or (edits, term) < (best[1], best[0])):
                        best = (term, edits)
                stack.append((node, s0, s1, s2))
        return best


class Matcher(dict):
    """token as written -> (hit or None, plain token); bounded."""

    def __init__(self, terms: list[tuple[str, bool, bool]]):
        super().__init__()
        self.trie = Trie(terms)
        self.some = bool(terms)

    def __missing__(self, token: str):
        if len(self) >= 300_000:
            self.clear()
        plain = token.lower().strip(EDGES)
        out = self[token] = self.trie.find(plain) if plain and self.some else None
        return out


_MATCHERS: dict[tuple, Matcher] = {}


def matcher(terms: list[tuple[str, bool, bool]]) -> Matcher:
    """The matcher of a lexicon, kept by the worker for its next tasks."""
    key = tuple(terms)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(terms)
    return _MATCHERS[key]


def features(text: str, match: Matcher, weight: np.ndarray, fuzzy: np.ndarray) -> list[float]:
    """Feature row of one whole text."""
    tokens = text.split()
    out = [0.0] * FEATURES
    if not tokens:
        return out
    hits = [(i, h) for i, h in enumerate(map(match.__getitem__, tokens)) if h]
    kinds = set()
    quoted_sum = plain_sum = top = address = 0.0
    for i, (term, edits) in hits:
        w = weight[term] if edits == 0 else fuzzy[term]
        token = tokens[i]
        before = [t.lower().strip(EDGES) for t in tokens[max(0, i - WINDOW):i]]
        after = [t.lower().strip(EDGES) for t in tokens[i + 1:i + 1 + WINDOW]]
        in_quotes = token[0] in QUOTES or (token.rstrip(".,;:!?")[-1:] or " ") in QUOTES
        if in_quotes or any(t in REPORTING for t in before):
            quoted_sum += w
        else:
            plain_sum += w
            kinds.add(term)
            top = max(top, w)
            address += any(t in SECOND_PERSON for t in before + after)
    n = len(tokens)
    return [np.log1p(plain_sum), plain_sum / n ** 0.5, 20 * plain_sum / n, top, float(len(kinds)),
            np.log1p(quoted_sum), np.log1p(address), np.log1p(len(hits)), np.log1p(n) / 10]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and word beginning, by label, of one task."""
    seen = {(stem, toxic): Counter() for stem in (False, True) for toxic in (False, True)}

    def flush() -> Iterator[pa.RecordBatch]:
        for (stem, toxic), counts in seen.items():
            n = pa.array(list(counts.values()), pa.int64())
            none = pa.array(np.zeros(len(counts), dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([stem] * len(counts), pa.bool_()),
                 n if toxic else none, none if toxic else n], ["term", "stem", "toxic", "other"])
            counts.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            plain = {t.strip(EDGES) for t in text.lower().split()}
            seen[False, bool(toxic)].update(w for w in plain if len(w) >= 3)
            for n in STEM_LENGTHS:  # beginnings of one length only equal each other
                seen[True, bool(toxic)].update({w[:n] for w in plain if len(w) > n})
            if sum(map(len, seen.values())) > 600_000:
                yield from flush()
    yield from flush()


def choose_terms(rows: list, n_toxic: int, n_other: int) -> list[tuple[str, bool, float]]:
    """(term, is beginning, weight) from (term, stem, toxic, other) counts, best
    first, ranked by the signed log-likelihood ratio.  A word that carries nearly
    all of a beginning's toxic documents stands for it (words allow misspellings),
    else the longest such beginning; a term that a chosen one covers is left out."""
    def llr(a: int, b: int) -> float:
        def part(k: float, n: float, p: float) -> float:
            return (k * np.log(p) if k else 0.0) + ((n - k) * np.log1p(-p) if n > k else 0.0)
        p, p1, p2 = (a + b) / (n_toxic + n_other), a / n_toxic, b / n_other
        if p1 <= p2 or p >= 1:
            return 0.0
        return 2 * (part(a, n_toxic, p1) + part(b, n_other, p2) - part(a, n_toxic, p) - part(b, n_other, p))

    by_start: dict[str, list] = {}
    for r in rows:
        for n in STEM_LENGTHS:
            if len(r[0]) > n or (len(r[0]) == n and not r[1]):
                by_start.setdefault(r[0][:n], []).append(r)

    ranked = sorted(((llr(a, b), t, s, a, b) for t, s, a, b in rows), key=lambda r: (-r[0], r[1], not r[2]))
    out: list[tuple[str, bool, float]] = []
    for score, term, stem, a, b in ranked:
        if score < MIN_RATIO or len(out) >= TERMS:
            break
        if stem:
            near = [r for r in by_start.get(term, []) if r[2] >= 0.9 * a]
            whole = [r for r in near if not r[1]]
            if near:
                term, stem, a, b = max(whole or near, key=lambda r: (r[2] if whole else len(r[0]), r[0]))
        if any(term.startswith(t) or (stem and t.startswith(term)) or t == term for t, s, _ in out if s or stem or t == term):
            continue
        out.append((term, bool(stem), float(np.log((a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_other + 1))))))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps for logistic regression with a small ridge; last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9),
                               x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Lexicon and weights; a few kilobytes, sent with the tasks."""

    def __init__(self, terms: list[tuple[str, bool, float]], share: float):
        self.terms = [(t, s, w >= FUZZY_FROM) for t, s, w in terms]
        self.weight = np.array([w for _, _, w in terms])
        # a misspelling is weaker evidence than the term; train() lowers it by what it saw
        self.fuzzy = self.weight * 0.5
        self.share = share
        self.w: np.ndarray | None = None

    def rows(self, texts: list[str], match: Matcher) -> np.ndarray:
        return np.array([features(t, match, self.weight, self.fuzzy) for t in texts]).reshape(-1, FEATURES)

    def score(self, texts: list[str], match: Matcher) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.share)
        z = np.hstack([self.rows(texts, match), np.ones((len(texts), 1))]) @ self.w
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max("toxic").cast("boolean").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # at most `rows` rows of an id and a flag; copies of a text count once
    texts = materialize(docs.select("doc_id", text_of().alias("text"))
                        .join(F.broadcast(sample), "doc_id")
                        .groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_other = n.get(True, 0), n.get(False, 0)
    if not n_toxic or not n_other:
        return Model([], float(n_toxic > 0))
    counts = (texts.mapInArrow(_count_terms, "term string, stem boolean, toxic long, other long")
              .groupBy("term", "stem").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
              .where((F.col("a") >= MIN_DOCS) & (F.col("a") / n_toxic > 2 * F.col("b") / n_other)))
    # the best candidates by the difference of shares, a bounded number
    top = counts.orderBy(F.desc(F.col("a") / n_toxic - F.col("b") / n_other), "term", "stem").limit(40 * TERMS)
    model = Model(choose_terms([tuple(r) for r in top.collect()], n_toxic, n_other), n_toxic / (n_toxic + n_other))

    def misspelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, seen = matcher(model.terms), Counter()
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                hits = {h[0] for h in map(match.__getitem__, text.split()) if h and h[1]}
                seen.update((t, toxic) for t in hits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.bool_()),
             pa.array(list(seen.values()), pa.int64())], ["term", "toxic", "n"])

    # two rows a term
    seen = {(r["term"], r["toxic"]): r["n"] for r in texts.mapInArrow(
        misspelt, "term long, toxic boolean, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n")).collect()}
    for i, w in enumerate(model.weight):
        a, b = seen.get((i, True), 0), seen.get((i, False), 0)
        learned = np.log((a + 0.5) / (n_toxic + 1) / ((b + 0.5) / (n_other + 1)))
        model.fuzzy[i] = min(0.5 * w, max(0.0, learned))

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(model.terms)
        for b in batches:
            x = model.rows(b.column("text").to_pylist(), match)
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    # at most `rows` rows of FEATURES numbers
    got = texts.mapInArrow(feature_rows, "toxic boolean, x array<double>").toPandas()
    model.w = fit_logistic(np.array(got.x.tolist()), got.toxic.to_numpy(dtype=float))
    return model


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(model.terms)
        for b in batches:
            s = model.score(b.column("__text").to_pylist(), match)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in b.schema.names if c != "__text"], pa.array(s)],
                [*[c for c in b.schema.names if c != "__text"], "__score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column __score."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn("__text", text_of()).mapInArrow(_scorer(model), f"{fields}, __score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
                      F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The documents whose score is below the cut, all columns kept."""
    return scored(docs, train(docs, labels)).where(F.col("__score") < cut).drop("__score")
