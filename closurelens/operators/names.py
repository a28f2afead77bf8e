"""Merchant-name pipeline (names script): first-pass cleaning with English
recovery, frequency vocabulary, brand extraction for HOLD names, union, and
the embedding-ready cleanup (X25-X36, A5, A6, J14-J16, U2, F10, F14, F15).

Everything is a column expression or an aggregation.  The only value that
reaches the driver is the brand dictionary, which is bounded by
``brand_top_n`` (500 in the reference)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def clean_names(df: DataFrame, raw: str = "raw_name") -> DataFrame:
    """First pass + recovery (J14 as a row-wise coalesce): adds
    ``clean_name`` and ``result`` (equal at this stage)."""
    out = tx.clean_name_stages(df, raw, "_first")
    out = out.withColumn("clean_name", F.coalesce(F.col("_first"), tx.recover_english(raw))).drop("_first")
    return out.withColumn("result", F.col("clean_name"))


def vocabulary(cleaned: DataFrame, top_n: int = 500, min_len: int = 2) -> DataFrame:
    """Top-n frequent results among non-HOLD rows (A5); ``!= HOLD`` keeps
    nulls in the vocabulary source like pandas (F10, trap 5), but null and
    short values are not counted.  Ties broken by name (trap 26).  Ordered
    longest first for matching (O7)."""
    src = cleaned.where(~F.col("result").eqNullSafe(F.lit(tx.HOLD)))
    counts = (src.where(F.length("result") >= min_len)
              .groupBy("result").agg(F.count(F.lit(1)).alias("freq")))
    top = counts.orderBy(F.col("freq").desc(), F.col("result")).limit(top_n)
    return top.select(F.col("result").alias("brand"), "freq", F.length("result").alias("len"))


def brand_dictionary(cleaned: DataFrame, top_n: int = 500) -> list[str]:
    """The matching order of the vocabulary: longest first, then frequency,
    then name (bounded by ``top_n``)."""
    rows = vocabulary(cleaned, top_n).orderBy(F.col("len").desc(), F.col("freq").desc(),
                                              F.col("brand")).collect()
    return [r["brand"] for r in rows]


#: characters of the grams that the dictionary is indexed by; shorter brands are their own gram
GRAM = 3
#: dictionaries up to this many brands, of some 100 bytes each, are broadcast; larger ones are joined by a shuffle
BROADCAST_BRANDS = 100_000


def brand_index(brands: Sequence[str]) -> list[tuple[int, str, str, str | None]]:
    """(order, brand, gram, pattern): one gram per brand, the one that the fewest brands
    hold (the first among equal ones), so that common beginnings do not gather
    brands.  Brands of two characters or less with a Latin letter must stand alone
    and have a pattern.  Repeated and empty brands count where they stand first."""
    rows = [(i, b) for i, b in enumerate(dict.fromkeys(brands))]
    grams = {b: [b[k:k + GRAM] for k in range(max(1, len(b) - GRAM + 1))] for _, b in rows}
    held = Counter(g for gs in grams.values() for g in set(gs))
    out = []
    for i, b in rows:
        alone = len(b) <= 2 and re.search(r"[a-z]", b)
        pattern = r"(?U)\b\Q" + b.replace("\\E", "\\E\\\\E\\Q") + r"\E\b" if alone else None
        out.append((i, b, min(grams[b], key=lambda g: held[g]), pattern))
    return out


def extract_brand(df: DataFrame, brands: Sequence[str], name: str = "name_for_brand",
                  out: str = "brand") -> DataFrame:
    """First dictionary brand found in the name (J15), null if there is none.

    A name that contains a brand contains the brand's gram, so the grams of the
    distinct names are joined to an inverted index of the brands, and only brands
    that share their gram are verified; the smallest order wins.  A name thus
    costs its length, not the size of the dictionary.  Null names have no brand;
    an empty dictionary finds none."""
    if not brands:
        return df.withColumn(out, F.lit(None).cast("string"))
    spark = df.sparkSession
    index = spark.createDataFrame(brand_index(brands), "_order int, _brand string, _gram string, _pattern string")
    if len(brands) <= BROADCAST_BRANDS:
        index = F.broadcast(index)
    names = df.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    places = F.sequence(F.lit(1), F.greatest(F.length("_name"), F.lit(1)))

    def cut(length: int) -> Column:
        return F.transform(places, lambda i: F.substring(F.col("_name"), i, F.lit(length)))

    cuts = [cut(g) for g in range(1, GRAM + 1)]
    grams = names.select("_name", F.explode(F.array_distinct(F.concat(*cuts, F.array(F.lit(""))))).alias("_gram"))
    found = F.when(F.col("_pattern").isNull(), F.col("_name").contains(F.col("_brand"))).otherwise(
        F.regexp(F.col("_name"), F.col("_pattern")))
    best = (grams.join(index, "_gram").where(found).groupBy("_name")
            .agg(F.min(F.struct("_order", "_brand")).alias("_best")))
    return (df.join(best, df[name] == best["_name"], "left")
            .withColumn(out, F.col("_best._brand")).drop("_name", "_best"))


def resolve_hold(cleaned: DataFrame, brands: Sequence[str], min_brand_freq: int = 500,
                 stop_words: Sequence[str] = tx.STOP_WORDS, raw: str = "raw_name") -> DataFrame:
    """HOLD rows get the dictionary brand found in their raw name; only
    brands seen at least ``min_brand_freq`` times among HOLD rows are kept
    (A6 + J16 as an aggregate and a broadcast semi join of at most
    ``len(brands)`` rows); stop words are dropped (X34)."""
    from ..session import materialize
    hold = cleaned.where(F.col("result") == tx.HOLD).withColumn("name_for_brand", tx.strip_company(raw))
    # the HOLD rows with their brand are written once: the dictionary scan
    # runs once per row, and predicates added downstream (semi join,
    # embedding filters) read a stored column instead of re-running it
    hold = materialize(extract_brand(hold, brands).select("uid", raw, "brand"), "hold-brands")
    # brands frequent enough and not stop words: a table of at most
    # len(brands) rows, applied as a broadcast semi join.  The stop-word test
    # is an aggregate output, so the optimizer does not infer (and push into
    # both scans) a predicate on the per-row brand expression.
    stop = F.col("brand").isin(list(stop_words)) if stop_words else F.lit(False)
    freq = (hold.where(F.col("brand").isNotNull()).groupBy("brand")
            .agg(F.count(F.lit(1)).alias("n"), F.max(stop.cast("int")).alias("_stop"))
            .where((F.col("n") >= min_brand_freq) & (F.col("_stop") == 0)).select("brand"))
    kept = hold.join(F.broadcast(freq), "brand", "left_semi")
    return kept.select("uid", raw, F.col("brand").alias("clean_name"), F.col("brand").alias("result"))


def final_names(cleaned: DataFrame, brands: Sequence[str], min_brand_freq: int = 500,
                raw: str = "raw_name") -> DataFrame:
    """Non-HOLD rows UNION ALL resolved HOLD rows (U2); unresolved HOLD rows
    are dropped."""
    keep = cleaned.where(~F.col("result").eqNullSafe(F.lit(tx.HOLD))).select("uid", raw, "clean_name", "result")
    return keep.unionByName(resolve_hold(cleaned, brands, min_brand_freq, raw=raw))


def embed_ready(names: DataFrame) -> DataFrame:
    """Synonym map, lowercase, drop nulls and digit-only non-years, special
    characters cleaned, drop names of one character or less (X35, X36, F14)."""
    syn = F.create_map(*[F.lit(x) for kv in tx.BRAND_SYNONYMS.items() for x in kv])

    def std(c):
        return F.lower(F.coalesce(syn[F.col(c)], F.col(c)))

    out = names.withColumns({"clean_name": std("clean_name"), "result": std("result")})
    out = out.where(F.col("clean_name").isNotNull() & tx.only_digits_not_year("clean_name"))
    out = out.withColumn("clean_name", tx.special_tokens("clean_name"))
    out = out.withColumn("result", tx.special_tokens("result"))
    return out.where(F.length(F.trim("clean_name")) > 1)
