"""Grid-cell join equals brute force, including points on cell edges and
distances at the radius."""

import math
import random

from pyspark.sql import functions as F

from closurelens.functions.geo import EARTH_RADIUS_M, cell_size_deg
from closurelens.operators import geojoin as gj


def _hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return EARTH_RADIUS_M * 2 * math.asin(math.sqrt(h))


def test_within_distance_equals_brute_force(spark):
    rnd = random.Random(7)
    dlat, dlon = cell_size_deg(100.0)
    left, right = [], []
    for i in range(400):
        # cluster points near a few cell corners so pairs straddle cell edges
        cy, cx = rnd.randint(0, 5), rnd.randint(0, 5)
        left.append((i, 35.0 + cy * dlat + rnd.uniform(-0.0012, 0.0012), 129.0 + cx * dlon + rnd.uniform(-0.0012, 0.0012)))
        right.append((i, 35.0 + cy * dlat + rnd.uniform(-0.0012, 0.0012), 129.0 + cx * dlon + rnd.uniform(-0.0012, 0.0012)))
    L = spark.createDataFrame(left, "id long, lat double, lon double")
    R = spark.createDataFrame(right, "id long, lat double, lon double")
    got = {(r["l_id"], r["r_id"]) for r in gj.within_distance(L, R, 100.0).collect()}
    exp = {(a[0], b[0]) for a in left for b in right if _hav(a[1:], b[1:]) <= 100.0}
    assert got == exp and len(exp) > 50
    got_left = {(r["l_id"], r["r_id"]) for r in gj.within_distance(L, R, 100.0, explode="left").collect()}
    assert got_left == exp


def test_similarity_bands_inclusive_and_empty_names(spark):
    rows = [(1, "abcdefghij", 35.0, 129.0)]
    mer = [(10, "abcdefghiX", 35.0, 129.0),      # sim 0.9 at 0 m -> band 1
           (11, "abcdefgXYZ", 35.0 + 45 / 111195, 129.0),  # sim 0.7 at 45 m -> band 2
           (12, "abcdefgXYZ", 35.0 + 60 / 111195, 129.0),  # sim 0.7 at 60 m -> no
           (13, "", 35.0, 129.0)]
    E = spark.createDataFrame(rows, "id long, name string, lat double, lon double")
    M = spark.createDataFrame(mer, "id long, name string, lat double, lon double")
    got = {r["m_id"] for r in gj.fuzzy_geo_match(E, M).collect()}
    assert got == {10, 11}
    best = gj.best_match(gj.fuzzy_geo_match(E, M)).first()
    assert best["m_id"] == 10


def test_plans_have_no_cartesian_product(spark):
    from closurelens.plans import registry
    d = "/root/testdata/sf0.001"
    for name in ("fuzzy_geo_match", "near_station", "panel_counts"):
        plan = registry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan, name


def test_hot_cell_salting_keeps_pairs_exact(spark):
    rnd = random.Random(11)
    # one dense cell (a third of all rows) plus scattered points
    left = [(i, 35.0 + rnd.uniform(0, 0.0005), 129.0 + rnd.uniform(0, 0.0005)) for i in range(300)]
    left += [(1000 + i, 35.0 + rnd.uniform(0, 0.02), 129.0 + rnd.uniform(0, 0.02)) for i in range(600)]
    right = [(i, 35.0 + rnd.uniform(0, 0.0006), 129.0 + rnd.uniform(0, 0.0006)) for i in range(200)]
    L = spark.createDataFrame(left, "id long, lat double, lon double")
    R = spark.createDataFrame(right, "id long, lat double, lon double")
    exp = {(a[0], b[0]) for a in left for b in right if _hav(a[1:], b[1:]) <= 100.0}
    salted = gj.within_distance(L, R, 100.0, hot_rows=50)
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    got = [(r["l_id"], r["r_id"]) for r in salted.collect()]
    assert len(got) == len(set(got)) and set(got) == exp


def test_grid_join_everywhere(spark):
    import random

    from closurelens.functions.geo import EARTH_RADIUS_M as R
    from closurelens.operators.geojoin import within_distance
    rng = random.Random(4)
    pts = [(0, 89.9, 10.0), (1, 89.9, 10.4), (2, 89.99999, 0.0), (3, 89.99999, 180.0), (4, 10.0, 179.9999),
           (5, 10.0, -179.9999), (6, 5.0, 129.0), (7, 5.0, 489.0), (8, -90.0, 3.0), (9, -89.9999, 77.0)]
    pts += [(10 + i, rng.choice((0, 60, -85)) + rng.random() * 0.004, rng.random() * 0.004) for i in range(200)]

    def dist(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * R * math.asin(math.sqrt(h))

    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    for hot in (2_000_000, 3):
        got = {(r.l_id, r.r_id) for r in within_distance(df, df, 100.0, hot_rows=hot).collect()}
        assert got == {(a[0], b[0]) for a in pts for b in pts if dist(a, b) <= 100.0}
    assert {(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)} <= got


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def _edited(rnd, name, letters):
    out = list(name)
    for _ in range(rnd.randint(0, 4)):
        at = rnd.randint(0, len(out))
        step = rnd.choice("ids")
        if step == "i" or not out:
            out.insert(at, rnd.choice(letters))
        elif step == "d":
            del out[min(at, len(out) - 1)]
        else:
            out[min(at, len(out) - 1)] = rnd.choice(letters)
    return "".join(out)


def test_segment_signatures_lose_no_pair(spark):
    rnd = random.Random(3)
    letters = "ab카페é"
    left = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 16))) for _ in range(150)] + [None, "a", "ab"]
    right = [_edited(rnd, rnd.choice(left[:150]), letters) for _ in range(250)] + [None, "", "a"]
    L = spark.createDataFrame([(1, n) for n in left], "k int, e string")
    R = spark.createDataFrame([(1, n) for n in right] + [(2, n) for n in left], "k int, m string")
    for sim in (0.55, 0.7, 0.9):
        got = {(r.e, r.m) for r in gj.similar_names(L, R, ["k"], "e", "m", sim).collect()}
        exp = {(a, b) for a in left for b in right if a and b and 1 - _lev(a, b) / max(len(a), len(b)) >= sim}
        assert got == exp and len(exp) > 20


def test_hot_building_meets_by_name(spark):
    """Equal rows with every cell, some cells and no cell taken by name; candidates of
    a hot cell grow with its rows, not with their square."""
    rnd = random.Random(8)

    def name():
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))

    def rows(n):
        est = [(i, name(), 35.0 + rnd.uniform(0, 0.0004), 129.0) for i in range(n)]
        mer = [(i, _edited(rnd, e[1], "xyz"), e[2], e[3]) for i, e in enumerate(est)]
        far = [(n + i, name(), 35.1 + rnd.uniform(0, 0.01), 129.0) for i in range(40)]
        schema = "id long, name string, lat double, lon double"
        return spark.createDataFrame(est + far, schema), spark.createDataFrame(mer + far, schema)

    E, M = rows(300)
    results = [sorted((r.e_id, r.m_id, r.similarity_score) for r in gj.fuzzy_geo_match(E, M, hot_pairs=h).collect())
               for h in (None, 0, 10_000, 10 ** 9)]
    assert results[0] == results[1] == results[2] == results[3] and len(results[0]) > 150
    met = []
    for n in (400, 1600):
        E, M = rows(n)
        pre = gj._candidates(E.toDF("e_id", "e_name", "e_lat", "e_lon"), M.toDF("m_id", "m_name", "m_lat", "m_lon"),
                             100.0, 0.7, 1000)
        met.append(pre.count())
    assert met[1] < 6 * met[0] and met[1] < 1600 * 1600 / 50


def _crowd(spark):
    """Few places and names, repeated ids, whole rows that come twice and nulls."""
    rnd = random.Random(21)
    names = ["alpha bolt", "alpha boltx", "beta ring", None]

    def rows(n, shift):
        out = [(rnd.randint(0, n // 2), rnd.choice(names), 35.0 + rnd.randint(0, 4) * 0.0003 + shift, 129.0) for _ in range(n)]
        return out + out[:5] + [(None, "beta ring", 35.0 + shift, 129.0), (3, "beta ring", None, 129.0), (4, "beta ring", 0.0 * -1, 0.0)]

    schema = "id long, name string, lat double, lon double"
    return [spark.createDataFrame(rows(n, s), schema) for n, s in ((90, 0.0), (70, 0.0001))]


def test_no_side_of_the_cell_join_is_broadcast(spark):
    """Small files unpack to 27 copies a row; only the lists of hot cells and classes are sent to all tasks."""
    from closurelens.plans import registry
    for name in ("haversine", "name_similarity", "fuzzy_geo_match"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line and "Inner" in line and "_n#" not in line]
        assert joins and all("SortMergeJoin" in line for line in joins), (name, joins)


def test_members_multiply_classes_out(spark):
    E, M = _crowd(spark)
    e, m = E.collect(), M.collect()
    exp = sorted(((a.id is None, a.id or 0), (b.id is None, b.id or 0)) for a in e for b in m
                 if None not in (a.lat, b.lat) and _hav((a.lat, a.lon), (b.lat, b.lon)) <= 100.0)
    at = ["lat", "lon"]
    near = gj._near_places(E.select(*at).distinct(), M.select(*at).distinct(), 100.0, "l_", "r_")
    for rows in (1000, 4):
        got = gj.members(near, E, M, at, "l_", "r_", rows).collect()
        assert sorted(((r.l_id is None, r.l_id or 0), (r.r_id is None, r.r_id or 0)) for r in got) == exp
    keys = ["name", *at]
    named = gj._near_places(E.select(*keys).distinct(), M.select(*keys).distinct(), 100.0, "l_", "r_")
    for rows in (1000, 4):
        got = gj.members(named, E, M, keys, "l_", "r_", rows).collect()
        assert sorted(((r.l_id is None, r.l_id or 0), (r.r_id is None, r.r_id or 0)) for r in got) == exp
        assert any(r.l_name is None for r in got)
    got = gj.within_distance(E, M, 100.0)
    assert got.columns == ["l_id", "l_name", "l_lat", "l_lon", "r_id", "r_name", "r_lat", "r_lon", "distance_m"]
    assert got.count() == len(exp) > 2000


def test_best_pairs_are_the_best_of_all_pairs(spark):
    E, M = _crowd(spark)
    every, some = gj.fuzzy_geo_match(E, M), gj.best_pairs(E, M)
    assert some.columns == every.columns and some.count() <= E.count() < every.count()
    best = [sorted(map(str, gj.best_match(p).select("e_id", "m_id", "distance_m", "similarity_score").collect()))
            for p in (every, some)]
    assert best[0] == best[1] and len(best[0]) > 20


def test_pairs_of_rows_are_neither_measured_nor_rounded_one_by_one(spark):
    """What an equal place or name shares is computed before its rows are multiplied out."""
    from closurelens.plans import registry
    for name, within in (("haversine", "asin("), ("name_similarity", "levenshtein(")):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
        last = plan.index("explode(_r")
        assert "round(" not in plan[:last] and within not in plan[:last], name
        assert "round(" in plan[last:] and within in plan[last:], name
        if name == "name_similarity":  # no join, so no shuffle, of pairs of names
            assert "join" not in plan[:plan.index(within)], name


def test_members_share_what_equal_names_have(spark):
    """Names in classes of places against brute force, in whole and in dealt classes, with null
    names and ids, rows that come twice and classes of several units."""
    E, M = _crowd(spark)
    e, m = E.collect(), M.collect()

    def sim(a, b):
        return None if None in (a, b) else round(1 - _lev(a, b) / max(len(a), len(b)), 6)

    exp = sorted(str((a.id, a.name, b.id, b.name, sim(a.name, b.name))) for a in e for b in m
                 if None not in (a.lat, b.lat) and _hav((a.lat, a.lon), (b.lat, b.lon)) <= 100.0)
    at = ["lat", "lon"]
    near = gj._near_places(E.select(*at).distinct(), M.select(*at).distinct(), 100.0, "e_", "m_")
    add = {"s": F.round(gj.name_similarity("e_name", "m_name"), 6)}
    for rows in (1000, 4):
        got = gj.members(near, E, M, at, "e_", "m_", rows, by=["name"], columns=["id"], add=add)
        assert got.columns == ["e_name", "e_id", "m_name", "m_id", "distance_m", "s"]
        assert sorted(str((r.e_id, r.e_name, r.m_id, r.m_name, r.s)) for r in got.collect()) == exp
    assert max(sum(1 for a in e if a.lat == b.lat) for b in e) > gj.UNIT_ROWS
    got = gj.within_distance(E, M, 100.0, digits=1, columns=["id"])
    assert got.columns == ["l_id", "r_id", "distance_m"]
    rows = got.collect()
    assert len(rows) == len(exp) and all(r.distance_m == round(r.distance_m, 1) for r in rows) and any(r.l_id is None for r in rows)
