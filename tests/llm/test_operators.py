"""Operators for training data against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from closurelens.llm import (decontaminate, html_extract, mixing, ngram_join, pii, secrets_ledger,
                             substring_dedup, toxicity, va_search, warc)
from closurelens.llm.common import connected_components, min_matches, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


ODD = [None, "", "   ", "one", "two words", "same text here", "same text here", "x" * 50_000, "word " * 3_000]


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# ---- 5 ------------------------------------------------------------------------------------

def near_copies(rng):
    out = []
    for _ in range(12):
        base = words(rng, rng.randint(30, 200)).split()
        out.append(" ".join(base))
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
    return out


def test_ngram_join_matches_brute_force(spark):
    texts = near_copies(random.Random(3)) + ODD
    s = [shingles(t or "") for t in texts]
    n = len(texts)
    linked = [[i != j and ((texts[i] or "") == (texts[j] or "") or bool(s[i] | s[j]) and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]))
               for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i]] + [root[j] for j in range(n) if linked[i][j]]) for i in range(n)]
    got = {r.doc_id: r for r in ngram_join.ngram_jaccard_join(docs_of(spark, texts)).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(linked[i]) for i in range(n)}
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(root))
    kept = ngram_join.keep_one_of_each(docs_of(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == set(root)


def test_ngram_join_empty_and_tiles(spark, monkeypatch):
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    rng = random.Random(5)
    sets = [np.unique(np.array(rng.sample(range(400), 300), dtype=np.uint64)) for _ in range(80)]
    i, j = map(np.array, zip(*[(a, b) for a in range(80) for b in range(a)]))
    want = [len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert ngram_join.exact_similar(sets, i, j, 0.6).tolist() == want
    assert min_matches(32, 0.8, 1e-6) < 0.8 * 32


def test_components(spark):
    rng = random.Random(1)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    root = {x: x for p in e for x in p}
    for _ in range(200):
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a long, b long"), "t").collect()}
    assert got == {x: r for x, r in root.items() if any((a == x or b == x) and a != b for a, b in e)}


# ---- 2 ------------------------------------------------------------------------------------

def test_paragraph_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 4)
    rng = random.Random(21)
    texts = []
    for _ in range(4):
        base = words(rng, 90).split()
        for _ in range(9):
            new = list(base)
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(90)] = words(rng, 1)
            texts.append(" ".join(new))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.86:  # far enough above for the bands
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(docs_of(spark, texts)).collect()
           if r.kind == "paragraph"}
    for i in range(len(texts)):
        if i != root[i]:
            assert got[i] == got[root[i]]
    assert all(len({i // 9 for i in got if got[i] == c}) == 1 for c in got.values())


def test_inline_passages_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(8)
    passages = [words(rng, rng.randint(55, 90)) for _ in range(6)]
    texts = [f"{words(rng, 80)} {p} {words(rng, 80)}" for p in passages for _ in range(3)]
    clean = [words(rng, 150) for _ in range(10)]
    rows = substring_dedup.repeated_passages(docs_of(spark, texts + clean)).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    classes = {}
    for r in rows:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert {tuple(sorted(c)) for c in classes.values()} == {(3 * k, 3 * k + 1, 3 * k + 2) for k in range(6)}
    assert all(r.removed == (r.doc_id % 3 > 0) for r in rows)


def test_near_paragraphs_and_odd_documents(spark):
    rng = random.Random(9)
    base = words(rng, 120).split()
    edited = list(base)
    edited[60] = "edit"
    texts = [words(rng, 5) + "\n" + " ".join(base), " ".join(edited) + "\n" + words(rng, 6)] + ODD
    rows = [r for r in substring_dedup.repeated_passages(docs_of(spark, texts)).collect() if r.kind == "paragraph"]
    assert {r.doc_id for r in rows} == {0, 1} and len({r.class_id for r in rows}) == 1
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert left[0] == texts[0] and "edit" not in left[1] and left[2] is None and len(left) == len(texts)
    assert substring_dedup.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_short_paragraphs_are_units(spark):
    rng = random.Random(21)
    notes = [words(rng, n) for n in (5, 6, 9, 14, 23)]
    texts = ["\n".join([words(rng, 30), n, words(rng, 30)]) for n in notes for _ in range(3)]
    rows = [r for r in substring_dedup.repeated_passages(docs_of(spark, texts)).collect() if r.kind == "paragraph"]
    assert {(r.doc_id, r.word_start, r.n_words, r.removed) for r in rows} == {
        (i, 30, len(notes[i // 3].split()), i % 3 > 0) for i in range(len(texts))}
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert all((notes[i // 3] in left[i]) == (i % 3 == 0) for i in left)


def test_inline_passages_are_returned_and_removed_whole(spark):
    rng = random.Random(31)
    passages = [words(rng, n) for n in (24, 30, 40, 60, 90)] + ["tick tock " * 20]
    around = [[words(rng, 80) for _ in range(2)] for _ in range(3 * len(passages))]
    texts = [f"{a} {passages[i // 3].strip()} {b}" for i, (a, b) in enumerate(around)]
    cover = {}
    for r in substring_dedup.repeated_passages(docs_of(spark, texts)).collect():
        cover.setdefault(r.doc_id, set()).update(range(r.word_start, r.word_start + r.n_words))
    for i in range(len(texts)):
        assert cover[i] >= set(range(80, 80 + len(passages[i // 3].split()))), i
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    for i, (a, b) in enumerate(around):
        kept = set(range(80)) | set(range(80 + len(passages[i // 3].split()), len(texts[i].split())))
        want = texts[i] if i % 3 == 0 else " ".join(texts[i].split()[j] for j in sorted(kept - cover[i]))
        assert left[i] == want


# ---- 8 ------------------------------------------------------------------------------------

def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = [words(rng, rng.randint(12, 40)) for _ in range(8)] + ["too short", None, ""]
    texts = []
    for k in range(30):
        w = items[k % 8].split()
        if k % 3 == 1:
            w[rng.randrange(len(w))] = "edit"
        if k % 3 == 2:
            w = w[:len(w) // 2]
        texts.append(f"{words(rng, 20)} {' '.join(w).upper()}! {words(rng, 10)}")
    texts += [*ODD, items[0], words(rng, 50)]

    def grams(t):
        w = (t or "").lower().translate(str.maketrans("", "", string.punctuation)).split()
        return [" ".join(w[i:i + 5]) for i in range(len(w) - 4)]

    want = {}
    for d, t in enumerate(texts):
        s = grams(t)
        for i, x in enumerate(items):
            b = Counter(grams(x))
            n = sum(b.values())
            for a in range(max(1, len(s) - n + 1)) if b and s else ():
                c = Counter(s[a:a + n])
                want[d, i] = max(want.get((d, i), 0), sum((b & c).values()) / sum((b | c).values()))
    want = {k: v for k, v in want.items() if v >= 0.8}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    left = decontaminate.decontaminate(docs_of(spark, texts), bench)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs_of(spark, texts), none).count() == 0


# ---- 3, 4 ---------------------------------------------------------------------------------

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_pii(t):
    out = []
    for k, (kind, p) in enumerate(PII.items()):
        for m in re.finditer(p, t):
            d = re.sub(r"\D", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(PII)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_matches_the_base_patterns(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab.@-+1 2().3é_4") for _ in range(300)) for _ in range(60)]
    texts += ["a@b.c_d@e.f x@y z@.q a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1112",
              "+1 (017) 555-7713 +++1 2", "9" * 40_000, "a" * 60_000 + "@b.co", "1." * 20_000, "é👍 4111111111111111 @", *ODD]
    got = {r.doc_id: r for r in pii.pii_report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = base_pii(t or "")
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (i, base, got[i].spans)
        assert got[i].n_card == base.count("card:")


def test_pii_proposed_kinds_and_redaction(spark):
    texts = ["my IBAN DE89370400440532013000, thanks", "DE89370400440532013001", "ssn 123-45-6789", "part 123-45-6789",
             "mail bob@x.org or +1 (017) 555-7713 now", None]
    got = [r.spans for r in pii.pii_report(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == "iban:8:30" and got[1] == "" and got[2] == "ssn:4:15" and got[3] == ""
    clean = pii.redact(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert clean[4].text == "mail <EMAIL> or <PHONE> now" and clean[4].n_chars == len(clean[4].text)
    assert clean[5].text is None and clean[1].text == texts[1]


def test_secret_ledger_scans_unseen_blobs_only(spark):
    texts = ["password = 'hunter22' token:abc", "AKIA" + "A1" * 9, "z" + "0a" * 12 + " TOKEN=x", "-----BEGIN RSA PRIVATE KEY-----", *ODD]
    ledger = secrets_ledger.new_ledger(spark)
    first = {r.doc_id: r for r in secrets_ledger.scan(docs_of(spark, texts), ledger).collect()}
    assert first[0].spans == "assign:0:20" and first[1].n_access == 1 and first[2].n_hex == 1
    assert first[3].spans.startswith("private_key:") and first[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    n = secrets_ledger.read_ledger(spark, ledger).count()
    assert n == len({t or "" for t in texts})
    again = secrets_ledger.scan(docs_of(spark, [*texts, texts[0], "new secret=abcdef"], list(range(len(texts))) + [90, None]), ledger)
    assert {r.doc_id: r.spans for r in again.collect()}[90] == first[0].spans
    assert secrets_ledger.read_ledger(spark, ledger).count() == n + 1
    assert secrets_ledger.scan(spark.createDataFrame([], DOCS), ledger).count() == 0


# ---- 1, 7, 9 ------------------------------------------------------------------------------

def test_crf_on_pages_not_trained_on(spark):
    crf = html_extract.model()
    for page in html_extract.labelled_pages(2, seed=77):
        found = html_extract.blocks_of(page)
        assert crf.decode(found) == [int(b.main) for b in found]


def test_html_extraction_of_odd_pages(spark):
    rows = [(1, "u", "<nav><a href=/>Home page</a></nav><article><h1>T</h1><p>a &amp;\n b&nbsp;c<p>d <i>e</i></article><footer>f</footer>"),
            (None, None, None), (3, "u", ""), (4, "u", "<script>x</script><style>p{}"), (5, "u", "<div>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == "T\na & b c\nd e" and got[1].n_chars == len(got[1].text)
    assert all(got[k].text == "" and got[k].n_chars == 0 for k in (None, 3, 4, 5))
    assert html_extract.extract(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "u1", "same"), (7, "u7", "same"), (7, "u7", "same"), (3, None, ""), (9, "http://x/é", "héllo \r\n\r\n" * 400),
            (None, "n", "alone"), (5, "u", None), (6, "u6", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write(df, folder, roll=300)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(rows) and manifest.count() > 1
    got = warc.read(spark, manifest, folder).collect()
    by = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert by == Counter({(1, "revisit", 7): 1, (7, "response", None): 1, (7, "revisit", 7): 1, (3, "revisit", 5): 1,
                          (9, "response", None): 1, (None, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1})
    assert {r.page_id: r.payload_digest for r in got}[6] == warc.digest(b"other")
    again = warc.write(df, shared_dir(spark, "warc-test"), roll=300)
    assert {r.sha256 for r in again.collect()} == {r.sha256 for r in manifest.collect()}
    assert warc.round_trip(df.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(df, min_bytes=10**6).collect()} == {"response"}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)]) for i in range(300)]
    rows += [(300, rows[50][1]), (301, None), (302, [1.0, None]), (303, [float("nan")]), (350, [0.5]), (350, [0.5]), (None, [1.0])]
    rows += [(1000 + i, [9.0] * 12) for i in range(120)]  # copies at the top of half of the queries
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = {i: np.pad(np.floor(256 * np.array(v)).astype(int), (0, 12 - len(v))) for i, v in rows
          if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {(q, r + 1, c, -s) for q in ok if q % 50 == 0
            for r, (s, c) in enumerate(sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q)[:5])}
    assert {tuple(r) for r in va_search.top_k(df).collect()} == want
    assert va_search.top_k(df.limit(0)).count() == 0


# ---- 10, 6 --------------------------------------------------------------------------------

def test_levenshtein_trie_matches_edit_distance():
    def lev(a, b):
        r = list(range(len(b) + 1))
        for x in a:
            n = [r[0] + 1]
            for j, y in enumerate(b):
                n.append(min(r[j] + (x != y), r[j + 1] + 1, n[j] + 1))
            r = n
        return r[-1]

    rng = random.Random(1)
    terms = list(dict.fromkeys("".join(rng.choice("abcd") for _ in range(rng.randint(4, 10))) for _ in range(20)))
    trie = toxicity.Trie([(t, False, True) for t in terms])
    for _ in range(2000):
        t = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            t.insert(rng.randint(0, len(t)), rng.choice("abcd")) if rng.random() < 0.5 else t.pop(rng.randrange(len(t)))
        t = "".join(t)
        want = min(((lev(t, w), i) for i, w in enumerate(terms) if lev(t, w) <= toxicity.edits_allowed(w)), default=None)
        assert trie.find(t) == (want and (want[1], want[0]))


def test_toxicity_misspelling_quotation_and_odd_inputs(spark):
    rng = random.Random(12)
    bad = ["idiot", "worthless", "moron"]
    texts = [words(rng, 40) + (f" you {rng.choice(bad)} {rng.choice(bad)} " if i % 4 == 0 else " ") + words(rng, 20) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(spark, texts), labels)
    match = toxicity.matcher(model.terms)
    plain = words(rng, 30)
    score = model.score([plain, plain + " you 1diot wortless idiot", plain + ' he said "idiot"', "", "x" * 100_000], match)
    assert score[1] > 0.5 > score[0] and score[2] < score[1] and (score[[0, 3, 4]] < 0.5).all()
    got = toxicity.toxicity_report(docs_of(spark, texts + ODD), labels).toPandas()
    assert len(got) == len(texts) + len(ODD) and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 400)]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.95
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_report(docs_of(spark, ODD), empty).collect()} == {0.0}
    kept = toxicity.drop_toxic(docs_of(spark, texts), labels)
    assert kept.columns == docs_of(spark, []).columns and 280 <= kept.count() <= 320


def test_raking_reaches_the_targets(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(5, 60)), rng.choice(["en", "de"]), rng.choice("abc"), rng.choice("xyz")) for i in range(600)]
    rows += [(None, None, None, None, None), (9000, "", "en", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    shares = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.2, "y": 0.3, "z": 0.5}}
    got = mixing.mix_report(df, shares).toPandas()
    assert len(got) == len(rows)
    for d, want in shares.items():
        mass = (got.weight * got.n_tokens).groupby(got[d]).sum()
        assert all(abs(mass[k] / mass.sum() - v) < 1e-3 for k, v in want.items())
    assert got.probability.max() == 1 and ((got.probability >= 0) & (got.probability <= 1)).all()
    expected = (got.probability * got.n_tokens).sum()
    assert abs((got.selected * got.n_tokens).sum() / expected - 1) < 0.15
    assert mixing.mix_report(df.drop("topic").limit(0)).count() == 0
    again = mixing.mix_report(df.drop("topic")).toPandas()
    assert len(again) == len(rows) and again.topic.notna().all() and again.topic.nunique() > 1
    same = mixing.mix_report(docs_of(spark, ["one form"] * 4)).toPandas()
    assert len(same) == 4 and same.topic.nunique() == 1


def test_a_rare_cell_does_not_shrink_the_others(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 40), "en", rng.choice("aab"), "x") for i in range(2000)]
    df = spark.createDataFrame(rows + [(9000, "one", None, "stray", "x")], "doc_id long, text string, lang string, source string, topic string")
    got = mixing.mix_report(df).toPandas()
    mass = got.probability * got.n_tokens
    assert abs(mass.sum() / got.n_tokens.sum() - mixing.KEEP) < 1e-6
    stray = got[got.doc_id == 9000].iloc[0]
    assert stray.probability == 1 and stray.repeats > 1
    ratio = got.probability * got.repeats / got.weight
    assert ratio.max() / ratio.min() - 1 < 1e-9


@pytest.mark.parametrize("name", ["op3_pii", "op4_secret_scan", "op7_warc", "op9_exact_top_k"])
def test_queries_match_sql(spark, name):
    from closurelens.llm.queries import QUERIES, SQL
    from tests.oracle_check import duck, norm

    df = QUERIES[name](spark, SF)
    cur = duck(SF).execute(SQL[name])
    cols = [c[0] for c in cur.description]
    want = Counter(repr([norm(x) for _, x in sorted(zip(cols, r))]) for r in cur.fetchall())
    assert Counter(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == want


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "mixing"]
    out = corpus_pipeline.run(spark, SF)
    assert set(docs_of(spark, []).columns) <= set(out.columns) and 0 < out.count() < 200


def test_raking_equals_numpy(spark):
    """The raked weights are those of a plain loop over an array of cells."""
    import numpy as np

    rng = np.random.default_rng(5)
    cells = np.zeros((4, 3, 2))
    rows = []
    for i, cell in enumerate(rng.integers(0, 24, 300)):
        s, l, t = np.unravel_index(cell, cells.shape)
        n = int(rng.integers(1, 40))
        cells[s, l, t] += n
        rows.append((i, " ".join(["w"] * n), f"s{s}", f"l{l}", f"t{t}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    w, total = cells.copy(), cells.sum()
    wants = []
    for axis, name in enumerate(mixing.DIMENSIONS):
        share = (cells.sum(axis=tuple({0, 1, 2} - {axis})) / total) ** mixing.POWERS[name]
        wants.append(share / share.sum() * total)
    for _ in range(mixing.ROUNDS * 4):
        for axis, want in enumerate(wants):
            has = w.sum(axis=tuple({0, 1, 2} - {axis}))
            w *= (want / np.where(has > 0, has, 1)).reshape([-1 if a == axis else 1 for a in range(3)])
    for r in mixing.mix_report(df).collect():
        at = int(r.source[1:]), int(r.lang[1:]), int(r.topic[1:])
        assert r.weight == pytest.approx(w[at] / cells[at], rel=1e-3)


def test_sample_keeps_clashing_columns(spark):
    df = docs_of(spark, ["some words here"] * 20 + [None, ""]).withColumns(
        {"__x": F.lit("a"), "__row": F.lit("b"), "__f_word": F.lit("c"), "selected": F.lit("d"), "weight": F.lit("e")})
    got = mixing.sample_to_targets(df)
    assert set(df.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    for r in got.collect():
        assert (r["__x"], r["__row"], r["__f_word"], r["selected"]) == ("a", "b", "c", "d") and r["weight"] != "e"


def test_warc_files_depend_on_the_pages_alone(spark):
    """5,000 pages written from two layouts under two partition settings: the same files."""
    rng = random.Random(9)
    rows = [(i if i % 3 else 7, f"http://h/{i}", words(rng, rng.randint(0, 200)) if i % 5 else "copy") for i in range(5000)]
    rows += [(None, None, None), (None, "http://n", "no id"), (7, "http://h/x", "copy"), (8, "http://long", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts, pages in (("8", df), ("13", df.repartition(3, "url"))):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            folder = shared_dir(spark, "warc-test")
            manifest = warc.write(pages, folder, roll=20_000)
            seen.append(sorted((r.path.rsplit("/", 1)[1], r.n_records, r.n_bytes, r.sha256) for r in manifest.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len(seen[0]) > 20 and sum(r[1] for r in seen[0]) == len(rows)
    got = warc.read(spark, manifest, folder).toPandas()
    assert sorted(got.payload_bytes) == sorted(len((h or "").encode()) for _, _, h in rows)
    assert ((got.payload_digest == warc.digest(b"copy")) & (got.record_type == "response")).sum() == 1


NESTED = [
    ("<p title=it's>Hello there, this is the text of a page.</p>", "Hello there, this is the text of a page."),
    ("<body><article><h1>Title here</h1><p>First paragraph is long enough to be read as text.</p><aside>Side words stand here."
     "</aside><p>Second paragraph goes on with the story told.</p><footer>Foot of it.</footer><form>Fill it in</form>"
     "<div class='cookie-notice'>We use things.</div></article>",
     "Title here\nFirst paragraph is long enough to be read as text.\nSecond paragraph goes on with the story told."),
    ("<body><dialog>Please accept it all.</dialog><article><h1>Title here</h1><p>First paragraph is long enough to be read.</p></article>",
     "Title here\nFirst paragraph is long enough to be read."),
    ("<body><div><a href=/a>Home</a> <a href=/b>News</a></div><div><h1>Title here</h1><p>First paragraph is long enough to be "
     "read as text.</p><p>Second one goes on with the story that was told.</p></div><div><a href=/d>Next</a></div>",
     "Title here\nFirst paragraph is long enough to be read as text.\nSecond one goes on with the story that was told."),
    ("<body><article><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><title>no</title><text>drawn</text></svg> "
     "hold.</p></article>", "The formula x=2 and drawn hold."),
    ("<body><div data-x=\"" + "y " * 6000 + "\" class=sidebar><p>Words at the side.</p></div><article><p>The text stands here, as told."
     "</p></article>", "The text stands here, as told."),
]


@pytest.mark.parametrize("page,text", NESTED)
def test_html_nested_boilerplate_and_markup(page, text):
    assert html_extract.main_text(page, html_extract.model()) == text


def test_viterbi_equals_enumeration():
    from itertools import product

    crf = html_extract.model()
    m0, m1, start = crf.moves
    for page in html_extract.labelled_pages(1, seed=5):
        found = html_extract.blocks_of(page)[:9]
        gains = [sum(crf.gain.get(f, 0.0) for f in html_extract.block_features(b)) for b in found]

        def score(labels):
            moves = start[labels[0]] + sum((m0, m1)[a][b] for a, b in zip(labels, labels[1:]))
            return moves + sum(g for g, k in zip(gains, labels) if k)

        best = max(map(score, product((0, 1), repeat=len(found))))
        assert score(crf.decode(found)) == pytest.approx(best)


def test_secret_ledger_written_twice_and_letters_of_either_case(spark):
    ledger = secrets_ledger.new_ledger(spark)
    df = docs_of(spark, ["PassWord = hunter2hunter2", "pa\u017f\u017fword=hunter2hunter2", "to\u212aen=hunter2hunter2", None, ""])
    first = {r.doc_id: (r.n_assign, r.spans) for r in secrets_ledger.scan(df, ledger).collect()}
    assert [first[i][0] for i in sorted(first)] == [1, 0, 0, 0, 0]
    path = f"{ledger}/rules={secrets_ledger.RULE_VERSION}"
    secrets_ledger.materialize(spark.read.parquet(path), "twice").write.mode("append").parquet(path)
    again = secrets_ledger.scan(df, ledger).collect()
    assert len(again) == 5 and {r.doc_id: (r.n_assign, r.spans) for r in again} == first
