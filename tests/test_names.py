"""Name-cleaning rules on hand-written rows (Hangul, brackets, glued
branches, symbols, digits, NBSP) against a direct Python transcription of
the rules' intent."""

import pytest

from closurelens.functions import text as tx
from closurelens.operators import names as nm

CASES = [
    ("(주)스타벅스 서면점", "스타벅스"),
    ("cu해운대점", tx.HOLD),                  # brand glued to the branch
    ("GS25(gs25 haeundae)", "GS25 gs25 haeundae"),
    ("!", None),
    ("주식회사  이디야   커피", "이디야 커피"),
    ("(STARBUCKS)", "starbucks"),               # recovered: uppercase only in brackets
    ("(null)", None),                           # recovered text 'null' is dropped
    ("주(abc)", "주 abc"),
    ("(주)", None),
    ("맘스터치-한시적", "맘스터치"),
    ("  나이스  치킨 ", "나이스 치킨"),     # NBSP is whitespace for (?U)\s
    ("파리바게뜨 센텀시티점", "파리바게뜨"),
    (None, None),
    ("", None),
]


def test_first_pass(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(CASES)], "uid long, raw_name string")
    got = {r["uid"]: r["clean_name"] for r in nm.clean_names(df).collect()}
    for i, (raw, exp) in enumerate(CASES):
        assert got[i] == exp, (raw, got[i], exp)


def test_embedding_rules(spark):
    rows = [(1, "x", "씨유", "씨유"), (2, "x", "12²", "12²"), (3, "x", "2024", "2024"), (4, "x", "123", "123"),
            (5, "x", "a/b,c (d)!", "a/b,c (d)!"), (6, "x", "가", "가"), (7, "x", None, None)]
    df = spark.createDataFrame(rows, "uid long, raw_name string, clean_name string, result string")
    got = {r["uid"]: r["clean_name"] for r in nm.embed_ready(df).collect()}
    assert got == {1: "cu", 2: "12", 3: "2024", 5: "a b c d"}


def test_brand_extraction_longest_first_and_word_boundary(spark):
    rows = [(1, "스타벅스리저브점", tx.HOLD), (2, "abc cu해운대점", tx.HOLD), (3, "cute점", tx.HOLD)]
    df = spark.createDataFrame([(u, r, c, c) for u, r, c in rows], "uid long, raw_name string, clean_name string, result string")
    out = nm.extract_brand(df.withColumn("name_for_brand", tx.strip_company("raw_name")),
                           ["스타벅스리저브", "스타벅스", "cu"])
    got = {r["uid"]: r["brand"] for r in out.collect()}
    # longest brand first; 'cu' needs a word boundary ('cute' does not match; Hangul after 'cu' is a word char)
    assert got == {1: "스타벅스리저브", 2: None, 3: None}


@pytest.mark.parametrize("name,expected", [("대저1동", "대저제1동"), ("대저제1동", "대저제1동"), ("반여2동", "반여제2동")])
def test_dong_infix_idempotent(spark, name, expected):
    from closurelens.operators.population import insert_je
    df = spark.createDataFrame([(name,)], "d string")
    once = df.select(insert_je("d", None).alias("d"))
    twice = once.select(insert_je("d", None).alias("d"))
    assert once.first()["d"] == expected and twice.first()["d"] == expected


def test_brand_index_equals_a_scan_of_50_000_brands(spark):
    import random
    import re
    rng = random.Random(5)
    letters = "가나다라마바사아abcde1 "
    brands = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60_000)))[:50_000]
    brands = sorted(brands, key=lambda b: (-len(b), b)) + ["a", "가", "a\\E", ""]
    names = [None, "", "a", "x a y", "zz"] + ["".join(rng.choice(letters + "zq") for _ in range(rng.randint(1, 25))) for _ in range(60)]

    def word(c):
        return c.isalnum() or c == "_"

    def alone(b, n):
        at = [m.start() for m in re.finditer("(?=" + re.escape(b) + ")", n)]
        edge = lambda i: (i > 0 and word(n[i - 1])) != (i < len(n) and word(n[i]))
        return any(edge(i) and edge(i + len(b)) for i in at)

    def first(n):
        return next((b for b in brands if (alone(b, n) if len(b) <= 2 and re.search("[a-z]", b) else b in n)), None)

    df = spark.createDataFrame([(i, n) for i, n in enumerate(names * 2)], "uid int, name_for_brand string")
    out = nm.extract_brand(df, brands)
    assert out.columns == ["uid", "name_for_brand", "brand"]
    got = {r.uid: r.brand for r in out.collect()}
    assert got == {i: None if n is None else first(n) for i, n in enumerate(names * 2)}
    # only brands that share a gram are verified
    held = [g for _, _, g, _ in nm.brand_index(brands)]
    assert max(held.count(g) for g in set(held[:2_000])) < 500
