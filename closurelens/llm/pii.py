"""Personal data: regular expressions propose spans, checksums confirm them and
context words adjust the score (DataFrame functions only).

Spans are code point offsets, end exclusive.  Spark gives the matches of a
pattern but not their places; splitting the text at the same pattern gives the
text between them, and running sums of both lengths are the places.  Patterns
use possessive repeats and start at the edge of a run, so that long runs of
digits or letters take linear time and no stack.

Kinds, in order: email, ip, card, phone (always kept when their check holds)
and the proposed iban and ssn, which need a score of ``ACCEPT``: a prior, plus
``CHECKED`` when the checksum or number rule holds, plus or minus ``CONTEXT``
when a telling word stands within ``NEAR`` code points before the span.

Defined results: null text = empty text, which has no spans; one result row per
input row, repeated or null ids included; an empty table gives no rows; columns
other than doc_id and text are not read (``redact`` keeps them unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closurelens.llm.common import text_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: texts without these characters are not searched for the kind
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.1}
CHECKED, CONTEXT, ACCEPT, NEAR = 0.4, 0.2, 0.6, 40
FOR_WORDS = {
    "email": "mail|contact|contacto|kontakt|courriel",
    "ip": "ip|address|adresse|host|server|login",
    "card": "card|visa|mastercard|karte|carte|tarjeta|credit",
    "phone": "phone|tel|call|fax|mobile|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
AGAINST_WORDS = "isbn|serial|invoice|order|version|part|sku"
_SPAN = "array<struct<start:int,end:int,m:string>>"


def _matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    need = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(need, found).otherwise(F.array().cast("array<string>"))


def _placed(text: Column, matches: Column, kind: str) -> Column:
    """Spans of the matches: running sums of the lengths between and of them."""
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(matches))
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("skip"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["skip"]
        b = a + F.length(x["m"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(
            a.alias("start"), b.alias("end"), x["m"].alias("m")))).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(steps, start, step, lambda s: s["out"])).otherwise(
        F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]+", "")


def _luhn(d: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        x = (F.ascii(F.substr(d, i, F.lit(1))) - 48) * (F.lit(1) + (F.length(d) - i) % 2)
        return s + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _mod97(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(s: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (s * 100 + code - 55) % 97).otherwise((s * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _holds(kind: str, m: Column) -> Column:
    """The checksum or number rule of a kind."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.substr(p, F.greatest(F.lit(1), F.length(p) - 2)).cast("int") <= 255))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(12, 19) & _luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & _mod97(m)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, text: Column, x: Column, holds: Column) -> Column:
    before = F.lower(F.substr(text, F.greatest(F.lit(1), x["start"] + 1 - NEAR),
                              F.least(x["start"], F.lit(NEAR))))
    return (F.lit(PRIOR[kind]) + F.when(holds, CHECKED).otherwise(0.0)
            + F.when(before.rlike(rf"\b({FOR_WORDS[kind]})\b"), CONTEXT).otherwise(0.0)
            - F.when(before.rlike(rf"\b({AGAINST_WORDS})\b"), CONTEXT).otherwise(0.0))


def _scored(kind: str, text: Column, spans: Column) -> Column:
    """(start, kind number, end, score) of the spans that stay."""
    def one(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                        x["end"].alias("end"), F.round(_score(kind, text, x, F.lit(True)), 3).alias("score"))

    kept = F.transform(F.filter(spans, lambda x: _holds(kind, x["m"])), one)
    return kept if kind in BASE else F.filter(kept, lambda x: x["score"] >= ACCEPT)


def pii_spans(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Adds ``spans``: array of (start, kind, end, score) in order of start and
    kind, for the string column ``text``."""
    t = F.col(text)
    df = docs.withColumns({f"__m_{k}": _matches(t, k) for k in KINDS})
    df = df.withColumns({f"__p_{k}": _placed(t, F.col(f"__m_{k}"), k) for k in KINDS})
    df = df.withColumn("spans", F.array_sort(F.concat(*[_scored(k, t, F.col(f"__p_{k}")) for k in KINDS])))
    return df.drop(*[f"__{a}_{k}" for a in "mp" for k in KINDS])


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans
    and all spans, one row per document."""
    found = pii_spans(docs.select("doc_id", text_of().alias("__text")))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {i})) as long)").alias(f"n_{k}")
              for i, k in enumerate(BASE)]
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"),
                        _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets (of
    overlapping spans the first names the stretch); n_chars follows the new text."""
    found = pii_spans(docs.withColumn("__text", text_of()).withColumnRenamed("spans", "__spans_in")
                      if "spans" in docs.columns else docs.withColumn("__text", text_of()))
    t, names = F.col("__text"), F.array(*[F.lit(k.upper()) for k in KINDS])

    def step(s: Column, x: Column) -> Column:
        new = x["start"] >= s["at"]
        tag = F.concat(s["out"], F.substr(t, s["at"] + 1, x["start"] - s["at"]),
                       F.lit("<"), F.get(names, x["kind"]), F.lit(">"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"),
                        F.when(new, tag).otherwise(s["out"]).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda s: F.concat(s["out"], F.substr(t, s["at"] + 1)))
    df = found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).drop("spans", "__text")
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                           .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return df.withColumnRenamed("__spans_in", "spans") if "spans" in docs.columns else df


#: the same report in DuckDB, where a pattern takes linear time by itself
_PLACES = """list_transform(range(1, len(m_{k}) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p_{k}[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda x: length(x))), 0) AS BIGINT), 'm': m_{k}[i]}})"""
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SQL_HOLDS = {
    "email": "true",
    "ip": r"len(list_filter(string_split(x.m, '.'), lambda q: length(ltrim(q, '0')) > 3 OR CAST(right(q, 3) AS INT) > 255)) = 0",
    "card": r"""length(regexp_replace(x.m, '[^0-9]+', '', 'g')) BETWEEN 12 AND 19 AND list_sum(list_transform(
  string_split(reverse(regexp_replace(x.m, '[^0-9]+', '', 'g')), ''),
  lambda c, j: CASE WHEN j % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN CAST(c AS INT) * 2 - 9 ELSE CAST(c AS INT) * 2 END)) % 10 = 0""",
    "phone": "length(regexp_replace(x.m, '[^0-9]+', '', 'g')) BETWEEN 9 AND 15",
}


def oracle() -> str:
    """SQL of ``pii_report``'s base columns; the proposed kinds add nothing on the
    given tables, whose texts hold neither of them."""
    found = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS p_{k}"
                      for k, p in _SQL_PATTERNS.items())
    spans = ", ".join(
        f"list_transform(list_filter({_PLACES.format(k=k)}, lambda x: {_SQL_HOLDS[k]}), "
        f"lambda x: {{'s': x.s, 'k': {i}, 'e': x.s + length(x.m)}}) AS s_{k}" for i, k in enumerate(_SQL_PATTERNS))
    names = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {found} FROM d),
s AS (SELECT doc_id, {spans} FROM f),
w AS (SELECT *, coalesce(array_to_string(list_transform(
  list_sort(s_email || s_ip || s_card || s_phone), lambda x: [{names}][x.k + 1] || ':' || x.s || ':' || x.e), ','), '') AS spans FROM s)
SELECT doc_id, {', '.join(f'CAST(len(s_{k}) AS BIGINT) AS n_{k}' for k in BASE)}, sha256(spans) AS base_sha256, spans FROM w"""
