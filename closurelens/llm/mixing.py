"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words; at least one a document) are summed in cells of source, language
and topic.  Each round scales the cells to the targets of one dimension after
the other (a grouped sum and a join back each) until no factor moves by more
than ``TOLERANCE`` or ``ROUNDS`` is reached; marginals that the non-empty cells
cannot meet together are then met as closely as raking does, the topic exactly.
A document is kept with probability min(1, c * weight), where c is solved from the
cell sums so that the kept tokens reach ``KEEP`` of all tokens in expectation.  Where
this is cut at 1, ``repeats`` = c * weight (1 elsewhere) says how often a kept
document counts, so that tokens times repeats have the raked shares in expectation
and a rare cell cannot shrink the others.  The draw is a hash of the row, so it is
the same in every run.

Targets default to tempered shares (share ** power, normalised): large sources
give way to small ones.  A table without a column ``topic`` gets one: k-means
over the form of the text (word length, lines, digits, symbols, size).  It is
fitted on all rows, counted in cells of the form rounded to ``GRID``, and applied
to every row.

Defined results: null text = empty text; null source, lang or topic is a
category of its own, written "(none)"; a target list need not sum to one;
categories without a target get weight 0 and are never kept; repeated rows with
equal columns are kept or left together; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closurelens.llm.common import text_of
from closurelens.session import materialize

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.8, "lang": 0.9, "topic": 0.95}
TOPICS = 6
TOLERANCE, ROUNDS = 1e-4, 25
SEED = 17
#: expected share of the tokens that is kept
KEEP = 0.75
#: step of each measure in the counted cells
GRID = {"__f_word": 0.25, "__f_lines": 0.02, "__f_digits": 0.02, "__f_symbols": 0.02, "__f_size": 0.25}


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _form(t: Column) -> dict[str, Column]:
    n = F.greatest(F.length(t), F.lit(1))
    return {"__f_word": n / F.col("n_tokens"), "__f_lines": _count(t, "\n") / F.col("n_tokens"),
            "__f_digits": _count(t, "0123456789") / n, "__f_symbols": _count(t, "|#*$%&!=@<>{}[]_") / n,
            "__f_size": F.log1p(F.col("n_tokens"))}


def measure(docs: DataFrame) -> DataFrame:
    """docs with n_tokens and, if it has no topic, the measures of the form of the text."""
    t = text_of()
    spaces = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    out = docs.withColumn("n_tokens", F.when(spaces == "", 1).otherwise(F.size(F.split(spaces, r"\s+"))).cast("long"))
    return out if "topic" in docs.columns else out.withColumns(_form(t))


def fit_topics(forms: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Fits the topics on all measured rows; returns the step that puts topic in place of the measures."""
    if "topic" in forms.columns:
        return lambda measured: measured
    names = list(GRID)
    cells = materialize(forms.groupBy(*[(F.round(F.col(f) / g) * g).alias(f) for f, g in GRID.items()])
                        .agg(F.count("*").cast("double").alias("__rows")).sortWithinPartitions(*names), "topic-cells")
    rows = F.col("__rows")
    n_cells = cells.count()
    if n_cells < 2:  # one form of text, or no text at all
        return lambda measured: measured.drop(*names).withColumn("topic", F.lit("topic0"))
    moments = cells.agg(F.sum(rows), *[F.sum(F.col(f) * rows) for f in names],
                        *[F.sum(F.col(f) * F.col(f) * rows) for f in names]).first()
    scaled = {}
    for i, f in enumerate(names):
        mean = moments[1 + i] / moments[0]
        spread = max(0.0, moments[1 + len(names) + i] / moments[0] - mean * mean) ** 0.5
        scaled[f] = (F.col(f) - mean) / (spread if spread > 1e-6 else 1.0)
    assemble = VectorAssembler(inputCols=names, outputCol="__x")
    means = KMeans(featuresCol="__x", predictionCol="__topic", weightCol="__rows", k=min(TOPICS, n_cells), seed=SEED, maxIter=10).fit(
        assemble.transform(cells.withColumns(scaled)))

    def predict(measured: DataFrame) -> DataFrame:
        out = means.transform(assemble.transform(measured.withColumns(scaled)))
        return out.withColumn("topic", F.concat(F.lit("topic"), F.col("__topic").cast("string"))).drop(
            "__x", "__topic", *names)

    return predict


def _category(d: str) -> Column:
    return F.coalesce(F.col(d).cast("string"), F.lit("(none)"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """cells (source, lang, topic, tokens) with w, the raked tokens."""
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for r in range(ROUNDS):
        now = now.withColumn("__old", F.col("w"))
        for d in DIMENSIONS:
            factor = (now.groupBy(d).agg(F.sum("w").alias("__sum")).join(targets[d], d, "left")
                      .select(d, F.when(F.col("__sum") > 0, F.coalesce("want", F.lit(0.0)) / F.col("__sum"))
                              .otherwise(0.0).alias("__factor")))
            now = now.join(factor, d).withColumn("w", F.col("w") * F.col("__factor")).drop("__factor")
        now = materialize(now, "rake-round")
        moved = now.agg(F.max(F.abs(F.col("w") / F.when(F.col("__old") > 0, F.col("__old")) - 1))).first()[0]
        now = now.drop("__old")
        if moved is None or (r > 0 and moved <= TOLERANCE):
            break
    return now


def tempered_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """Tokens wanted of each category: total times its tempered share."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    out = {}
    for d in DIMENSIONS:
        part = cells.groupBy(d).agg(F.pow(F.sum("tokens") / F.lit(float(total or 1)), POWERS[d]).alias("share"))
        mass = part.agg(F.sum("share")).first()[0] or 1.0
        out[d] = part.select(d, (F.col("share") / mass * float(total)).alias("want"))
    return out


def given_targets(cells: DataFrame, shares: dict[str, dict[str, float]]) -> dict[str, DataFrame]:
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    spark = cells.sparkSession
    return {d: spark.createDataFrame([(k, total * v / sum(s.values())) for k, v in s.items()], f"{d} string, want double")
            for d, s in shares.items()} | {d: t for d, t in tempered_targets(cells).items() if d not in shares}


def keep_factor(raked: DataFrame, keep: float) -> float:
    """c with sum(tokens * min(1, c * weight)) = keep * all tokens.  Each round takes the
    cells cut at 1 from the sums and solves for the rest; c only grows, so it ends once no
    cell joins them.  All cells of weight above 0 are cut if their tokens do not suffice."""
    live = raked.where("weight > 0")
    want = keep * float(raked.agg(F.sum("tokens")).first()[0] or 0)
    c = 0.0
    while True:
        cut = F.col("weight") * c >= 1
        whole, free, low = live.agg(F.sum(F.when(cut, F.col("tokens"))), F.sum(F.when(~cut, F.col("tokens") * F.col("weight"))),
                                    F.min("weight")).first()
        if free is None:  # all cells are cut
            return max(c, 1 / low) if low else 1.0
        new = (want - float(whole or 0)) / free
        if new <= c * (1 + 1e-12):
            return c
        c = new


def cell_weights(tagged: DataFrame, shares: dict[str, dict[str, float]] | None = None, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, weight, probability, repeats) of every cell."""
    cells = materialize(tagged.select(*[_category(d).alias(d) for d in DIMENSIONS], "n_tokens")
                        .groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    raked = rake(cells, given_targets(cells, shares or {})).withColumn("weight", F.col("w") / F.col("tokens"))
    scaled = F.col("weight") * F.lit(keep_factor(raked, keep))
    return raked.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), scaled).alias("probability"),
                        F.greatest(F.lit(1.0), scaled).alias("repeats"))


def _draw() -> Column:
    """A number in [0, 1) that depends on the row alone."""
    key = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("n_tokens"), *[_category(d) for d in DIMENSIONS])
    return F.pmod(key, F.lit(1 << 53)) / float(1 << 53)


def _weighed(tagged: DataFrame, weights: DataFrame) -> DataFrame:
    cell = weights.select(*[F.col(d).alias(f"__c_{d}") for d in DIMENSIONS], "weight", "probability", "repeats")
    same = [_category(d) == F.col(f"__c_{d}") for d in DIMENSIONS]
    return tagged.join(cell, same[0] & same[1] & same[2]).withColumn(
        "selected", (_draw() < F.col("probability")).cast("int")).drop(*[f"__c_{d}" for d in DIMENSIONS])


def _inputs(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, "doc_id", "text", "source", "lang", *["topic"] * ("topic" in docs.columns))


def mix_report(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, repeats, selected of every document."""
    forms = materialize(measure(_inputs(docs)).drop("text"), "mix-forms")
    tagged = fit_topics(forms)(forms).select("doc_id", *DIMENSIONS, "n_tokens")
    return _weighed(tagged, cell_weights(tagged, shares))


def sample_to_targets(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled documents with their columns, topic, n_tokens, weight, probability and repeats
    (each in place of a column of that name; a topic of the documents is taken as their topic)."""
    forms = materialize(measure(_inputs(docs)).drop("text"), "mix-forms")
    topics = fit_topics(forms)
    rows = topics(measure(_inputs(docs, F.struct("*").alias("__row"))))
    kept = _weighed(rows, cell_weights(topics(forms), shares)).where("selected = 1")
    added = ["topic", "n_tokens", "weight", "probability", "repeats"]
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns if c not in added], *added)
