"""Merchant-name cleaning expressions (X25-X36).  Python's ``re`` is
Unicode-aware, Java's ``\\w \\s \\b`` are ASCII unless ``(?U)`` is set, so every
pattern that relies on them carries ``(?U)`` (trap 4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLD = "HOLD"
# fixed values: literal removals of the reference, in its order
COMPANY_MARKS = ["(주)", "( 주)", "(주", "주)", "( 주"]
COMPANY_WORD = "주식회사"
TEMPORARY_MARKS = ["-한시적", " -한시적", "(한시적)"]
# fixed values: the reference's name patterns, in the order they are applied
# ((?U) added where Python's Unicode \s \w \b must be kept in Java)
WHITESPACE_RUN = r"(?U)\s+"
ENGLISH_IN_PARENS = r"\(([^)]*[a-z][^)]*)\)"
PARENTHESISED = r"\([^)]*\)"
BRANCH_SUFFIX = "(지점|점|센터|분점)"
TRAILING_BRANCH = r"(?U)\s+\S{1,20}(지점|점|센터|분점)$"
GLUED_BRANCH = "[가-힣a-z0-9]{2,}(지점|점|센터|분점)$"
SINGLE_SYMBOL = r"(?U)^[^\w\s]$"
LATIN_IN_PARENS = r"\(([^)]*[a-zA-Z][^)]*)\)"
BRACKETS = r"[()]"
COMPANY_MARK_SPACED = r"(?U)\s*\( ?주\)?\s*"
NOT_NAME_CHAR = r"(?U)[^가-힣a-z0-9\s\-&.·]"
DIGITS_ONLY = r"^[0-9]+$"
# fixed values: brand synonyms (exact values, applied before lowercasing)
BRAND_SYNONYMS = {
    "씨유": "CU", "씨유 CU": "CU", "CU": "CU",
    "지에스25": "GS25", "지에스25 GS": "GS25", "지에스25 GS25": "GS25", "GS25": "GS25",
    "이디야": "이디야커피", "이디야커피": "이디야커피",
}
# fixed values: words that are not brands
STOP_WORDS = ["중앙", "잡화", "우리", "우정", "제일", "그린", "대성", "드림", "타임", "스타",
              "마루", "명가", "정성", "코코", "현대"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Whitespace runs -> one space, trimmed."""
    return F.trim(F.regexp_replace(_c(c), WHITESPACE_RUN, " "))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def remove_literals(c, literals) -> Column:
    out = _c(c)
    for lit in literals:
        out = F.replace(out, F.lit(lit), F.lit(""))
    return out


def english_in_parens(c) -> Column:
    """All bracketed texts containing a lowercase Latin letter."""
    return F.regexp_extract_all(_c(c), F.lit(ENGLISH_IN_PARENS), 1)


def clean_name_stages(df, raw: str, out: str):
    """First-pass cleaning of raw merchant names (X25-X31) as staged
    projections: each intermediate is its own column, so the optimizer does
    not inline (and duplicate) the regex chain into every branch.  ``out`` is
    the cleaned name, ``HOLD`` for a branch glued to the name, or null."""
    s = remove_literals(collapse_ws(raw), COMPANY_MARKS + [COMPANY_WORD] + TEMPORARY_MARKS)
    df = df.withColumn("_s", s)
    df = df.withColumn("_eng", english_in_parens("_s"))
    df = df.withColumn("_s", F.regexp_replace(F.trim(F.regexp_replace("_s", PARENTHESISED, "")),
                                              TRAILING_BRANCH, ""))
    df = df.withColumn("_t", strip_ws("_s"))
    t, has_eng, null = F.col("_t"), F.size("_eng") > 0, F.lit(None).cast("string")
    df = df.withColumn(out, F.when(F.col(raw).isNull(), null)
                       .when(F.col("_s").rlike(GLUED_BRANCH), F.lit(HOLD))
                       .when(F.col("_s").rlike(SINGLE_SYMBOL), null)
                       .when(t == "", null)
                       .when((t == "주") & ~has_eng, null)
                       .when(has_eng, F.concat(t, F.lit(" "), F.array_join("_eng", " ")))
                       .otherwise(t))
    return df.drop("_s", "_eng", "_t")


def recover_english(c) -> Column:
    """Bracketed Latin text kept when the first pass gave nothing: brackets
    dropped, stripped, lowercased (X32).  The literal text 'null' counts as
    missing (F15)."""
    c = _c(c)
    rec = F.lower(strip_ws(F.regexp_replace(c, BRACKETS, "")))
    ok = c.rlike(LATIN_IN_PARENS)
    return F.when(ok & (rec != "null"), rec)


def strip_company(c) -> Column:
    """Second-pass cleanup of HOLD names before brand lookup."""
    s = F.regexp_replace(_c(c), COMPANY_MARK_SPACED, "")
    return strip_ws(F.replace(s, F.lit(COMPANY_WORD), F.lit("")))


def special_tokens(c) -> Column:
    """Embedding cleanup (X36): brackets dropped, ',' and '/' to spaces,
    characters outside Hangul / a-z / digits / space / - & . middle-dot
    removed, whitespace collapsed."""
    s = F.regexp_replace(_c(c), BRACKETS, "")
    s = F.translate(s, ",/", "  ")
    s = F.regexp_replace(s, NOT_NAME_CHAR, "")
    return strip_ws(F.regexp_replace(s, WHITESPACE_RUN, " "))


def only_digits_not_year(c) -> Column:
    """True unless the value is all digits with a length other than 4."""
    c = _c(c)
    return ~c.rlike(DIGITS_ONLY) | (F.length(c) == 4)
