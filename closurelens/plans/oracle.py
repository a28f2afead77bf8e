"""DuckDB SQL equivalents of the registered queries (the correctness gate).

The fixture CTEs mirror :mod:`closurelens.sources.fixtures`.  The panel is
written the way the reference writes it (month x store cross join and
filter), so the oracle checks our interval expansion against the literal
definition.  ``R(x, n)`` rounds like Spark's ``round`` on a double (HALF_UP
on the shortest decimal form); plain DuckDB ``round`` works on the binary
value and differs on inputs such as 0.285.
"""

from __future__ import annotations


def R(x: str, n: int = 2) -> str:
    # via the shortest decimal string, exactly what Spark rounds
    return f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {n}) AS DOUBLE)"


MONTHS = """months AS (
  SELECT strftime(d, '%Y-%m') AS month
  FROM generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2001-09-01', INTERVAL 1 MONTH) t(d))"""

STORES = """stores AS (
  SELECT o_orderkey AS store_id, r_name AS district, n_name AS dong,
         c_mktsegment || '/' || o_orderpriority AS industry,
         strftime(o_orderdate, '%Y-%m') AS open_month,
         CASE WHEN o_orderstatus <> 'O' THEN strftime(ls.last_ship, '%Y-%m') END AS close_month,
         CAST(o_orderkey % 3 = 0 AS INTEGER) AS affiliated,
         CAST(o_custkey % 4 = 0 AS INTEGER) AS near_station
  FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) ls
    ON ls.l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

ALIVE = """alive AS (
  SELECT m.month, s.*,
         (CAST(substr(m.month, 1, 4) AS INTEGER) - CAST(substr(s.open_month, 1, 4) AS INTEGER)) * 12
         + CAST(substr(m.month, 6, 2) AS INTEGER) - CAST(substr(s.open_month, 6, 2) AS INTEGER) AS months_open
  FROM months m CROSS JOIN stores s
  WHERE s.open_month <= m.month AND (s.close_month IS NULL OR s.close_month > m.month))"""

PALIVE = """palive AS (
  SELECT month, district, dong, industry, count(*) AS alive,
         count(*) FILTER (WHERE affiliated = 1) AS affiliated,
         count(*) FILTER (WHERE near_station = 1) AS near_station,
         avg(months_open) AS avg_months
  FROM alive GROUP BY month, district, dong, industry)"""

PCLOSED = """pclosed AS (
  SELECT m.month, district, dong, industry, count(*) AS closed
  FROM stores s JOIN months m ON s.close_month = m.month
  GROUP BY m.month, district, dong, industry)"""

COUNTS = f"""counts AS (
  SELECT coalesce(a.month, c.month) AS month, coalesce(a.district, c.district) AS district,
         coalesce(a.dong, c.dong) AS dong, coalesce(a.industry, c.industry) AS industry,
         coalesce(a.alive, 0) AS alive, coalesce(c.closed, 0) AS closed,
         coalesce(a.alive, 0) + coalesce(c.closed, 0) AS total,
         coalesce(a.affiliated, 0) AS affiliated, coalesce(a.near_station, 0) AS near_station,
         {R("coalesce(a.avg_months, 0) / 12.0")} AS avg_years
  FROM palive a FULL OUTER JOIN pclosed c
    ON a.month = c.month AND a.district = c.district AND a.dong = c.dong AND a.industry = c.industry)"""


def _rate(num: str) -> str:
    return R(f"CASE WHEN total > 0 THEN {num} / total ELSE 0 END")


RATES = f"""rates AS (
  SELECT month, district,
         CASE WHEN dong IN ('대저1동', '대저2동', '명지1동', '명지2동')
              THEN regexp_replace(dong, '([가-힣]+)(\\d+)동$', '\\1제\\2동') ELSE dong END AS dong,
         industry, total,
         {_rate("alive")} AS survival_rate, {_rate("closed")} AS closure_rate,
         {_rate("near_station")} AS station_rate, {_rate("affiliated")} AS affiliation_rate,
         avg_years
  FROM counts WHERE dong <> '신호동')"""

# X13 without look-behind (RE2): insert, then undo a doubled infix
_JE_ALL = "replace(regexp_replace({c}, '([가-힣]+)(\\d+)동', '\\1제\\2동', 'g'), '제제', '제')"

TX = f"""tx_raw AS (
  SELECT strftime(l_shipdate, '%Y%m') AS year_month, n_name AS dong,
         c_mktsegment || '/' || o_orderpriority AS industry,
         count(*) AS tx_count, {R("sum(l_extendedprice)")} AS tx_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL),
txm AS (
  SELECT substr(year_month, 1, 4) || '-' || substr(year_month, 5, 2) AS month,
         {_JE_ALL.format(c="dong")} AS dong, industry, tx_count, tx_amount,
         {R("CASE WHEN tx_count > 0 THEN tx_amount / tx_count ELSE 0 END")} AS avg_ticket
  FROM tx_raw)"""

PTX = """ptx AS (SELECT * FROM rates LEFT JOIN txm USING (month, dong, industry))"""

IMP = """sz AS (
  SELECT month, district, dong, industry, total, survival_rate, closure_rate, station_rate,
         affiliation_rate, avg_years, tx_count IS NULL AS _missing,
         CASE WHEN affiliation_rate = 0 THEN 0 ELSE tx_count END AS tx_count,
         CASE WHEN affiliation_rate = 0 THEN 0 ELSE tx_amount END AS tx_amount,
         CASE WHEN affiliation_rate = 0 THEN 0 ELSE avg_ticket END AS avg_ticket
  FROM ptx),
mn AS (
  SELECT *, avg(tx_count) OVER w AS m_c, avg(tx_amount) OVER w AS m_a, avg(avg_ticket) OVER w AS m_t
  FROM sz WINDOW w AS (PARTITION BY dong, industry)),
imp AS (
  SELECT month, district, dong, industry, total, survival_rate, closure_rate, station_rate,
         affiliation_rate, avg_years,
         CASE WHEN affiliation_rate = 0 AND _missing THEN 'structural_zero'
              WHEN affiliation_rate = 0 THEN 'zero_override'
              WHEN NOT _missing THEN 'present'
              WHEN m_c IS NULL THEN 'no_mean'
              WHEN m_c = 0 THEN 'zero_mean'
              ELSE 'imputed' END AS impute_status,
         CAST(coalesce(CASE WHEN tx_count IS NULL THEN m_c ELSE tx_count END, 0) AS DOUBLE) AS tx_count,
         CAST(coalesce(CASE WHEN tx_amount IS NULL THEN m_a ELSE tx_amount END, 0) AS DOUBLE) AS tx_amount,
         CAST(coalesce(CASE WHEN avg_ticket IS NULL THEN m_t ELSE avg_ticket END, 0) AS DOUBLE) AS avg_ticket
  FROM mn),
excl AS (
  SELECT * FROM imp WHERE (month, dong, industry) NOT IN (
    SELECT (month, dong, industry) FROM imp WHERE impute_status IN ('zero_mean', 'no_mean'))),
cleaned AS (
  SELECT month,
         CASE WHEN dong IN ('NATION_1', 'NATION_6') THEN 'AMERICAS'
              WHEN dong IN ('NATION_2') AND district = 'ASIA' THEN 'EAST ASIA'
              ELSE district END AS district,
         dong, industry, total, survival_rate, closure_rate, station_rate, affiliation_rate,
         avg_years, tx_count, tx_amount, avg_ticket
  FROM excl)"""


def _ratio_cols() -> str:
    parts = []
    for band, col, values in (("status", "l_linestatus", ["F", "O"]),
                              ("flag", "l_returnflag", ["A", "N", "R"]),
                              ("line", "l_linenumber", [1, 2, 3, 4, 5, 6, 7])):
        for v in values:
            lit = f"'{v}'" if isinstance(v, str) else str(v)
            parts.append(f"{R(f'coalesce(sum(CASE WHEN {col} = {lit} THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 0)', 4)} AS {band}_{str(v).lower()}_ratio")
    return ",\n         ".join(parts)


POP = f"""pop_raw AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS month, r_name AS district, n_name AS dong,
         count(*) AS visitors, sum(l_quantity) AS residents,
         {_ratio_cols()},
         {R("sum(l_extendedprice)")} AS spend_total
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
pop AS (
  SELECT * REPLACE (
    CASE WHEN dong IN ('NATION_1', 'NATION_6') THEN 'AMERICAS'
         WHEN dong IN ('NATION_2') AND district = 'ASIA' THEN 'EAST ASIA'
         ELSE district END AS district,
    CASE WHEN dong IN ('대저1동', '대저2동', '명지1동', '명지2동')
         THEN regexp_replace(dong, '([가-힣]+)(\\d+)동$', '\\1제\\2동') ELSE dong END AS dong)
  FROM pop_raw)"""

PANEL_CTES = [MONTHS, STORES, ALIVE, PALIVE, PCLOSED, COUNTS, RATES, TX, PTX, IMP, POP]
FULL = """full_panel AS (SELECT * FROM cleaned LEFT JOIN pop USING (month, district, dong))"""


def with_ctes(body: str, ctes=None) -> str:
    return "WITH " + ",\n".join(ctes or PANEL_CTES) + "\n" + body


def _r6(cols) -> str:
    return ", ".join(f"{R(c, 6)} AS {c}" for c in cols)


SQL: dict[str, str] = {}

SQL["month_dim"] = with_ctes("""
SELECT m.month, CAST(coalesce(o.n, 0) AS BIGINT) AS opened, CAST(coalesce(c.n, 0) AS BIGINT) AS closed
FROM months m
LEFT JOIN (SELECT open_month AS month, count(*) AS n FROM stores GROUP BY 1) o USING (month)
LEFT JOIN (SELECT close_month AS month, count(*) AS n FROM stores GROUP BY 1) c USING (month)""")

SQL["months_between"] = with_ctes("""
SELECT store_id, open_month, close_month,
       (CAST(substr(close_month, 1, 4) AS INTEGER) - CAST(substr(open_month, 1, 4) AS INTEGER)) * 12
       + CAST(substr(close_month, 6, 2) AS INTEGER) - CAST(substr(open_month, 6, 2) AS INTEGER) AS months_open
FROM stores""")

SQL["panel_alive"] = with_ctes("SELECT * FROM palive")
SQL["panel_closed"] = with_ctes("SELECT * FROM pclosed")
SQL["panel_counts"] = with_ctes("SELECT * FROM counts")
SQL["panel_rates"] = with_ctes("SELECT * FROM rates")
SQL["tx_monthly"] = with_ctes("SELECT * FROM txm")
SQL["avg_ticket"] = with_ctes("SELECT month, dong, industry, avg_ticket FROM txm")
SQL["panel_tx"] = with_ctes("SELECT * FROM ptx")
SQL["structural_zero"] = with_ctes("SELECT * EXCLUDE (_missing) FROM sz")
SQL["group_mean"] = with_ctes(f"""
SELECT month, district, dong, industry, {R('m_c', 6)} AS mean_tx_count,
       {R('m_a', 6)} AS mean_tx_amount, {R('m_t', 6)} AS mean_avg_ticket FROM mn""")
SQL["impute_group_mean"] = with_ctes(f"""
SELECT * REPLACE ({_r6(['tx_count', 'tx_amount', 'avg_ticket'])}) FROM imp""")
SQL["impute_exclude"] = with_ctes(f"""
SELECT * REPLACE ({_r6(['tx_count', 'tx_amount', 'avg_ticket'])}) FROM cleaned""")
SQL["impute_audit"] = with_ctes("SELECT impute_status, count(*) AS rows FROM imp GROUP BY 1")
SQL["ratio_pivot"] = with_ctes("SELECT * FROM pop_raw")
SQL["repair_keys"] = with_ctes("SELECT * FROM pop")
SQL["normalize_dong"] = """WITH dn AS (
  SELECT c_custkey AS id,
         ['대저', '명지', '서대신', '안락', '명장', '반여', '좌', '우'][c_nationkey % 8 + 1]
         || CASE WHEN c_custkey % 2 = 0 THEN '제' ELSE '' END || CAST(c_custkey % 3 + 1 AS VARCHAR) || '동' AS dong_raw
  FROM customer)
SELECT id, dong_raw,
       CASE WHEN dong_raw IN ('대저1동', '대저2동', '명지1동', '명지2동')
            THEN regexp_replace(dong_raw, '([가-힣]+)(\\d+)동$', '\\1제\\2동') ELSE dong_raw END AS dong_targeted,
       """ + _JE_ALL.format(c="dong_raw") + """ AS dong_all
FROM dn"""
SQL["panel_full"] = with_ctes(f"""
SELECT * REPLACE ({_r6(['tx_count', 'tx_amount', 'avg_ticket'])}) FROM full_panel""",
                              PANEL_CTES + [FULL])
SQL["key_diff"] = with_ctes("""
(SELECT district, dong, 'panel_only' AS side FROM (
   SELECT DISTINCT district, dong FROM cleaned EXCEPT SELECT DISTINCT district, dong FROM pop))
UNION ALL
(SELECT district, dong, 'population_only' AS side FROM (
   SELECT DISTINCT district, dong FROM pop EXCEPT SELECT DISTINCT district, dong FROM cleaned))""")


# ---------------------------------------------------------------- features, stats, risk
FEATS = """enc AS (
  SELECT *, CAST(dense_rank() OVER (ORDER BY industry) - 1 AS INTEGER) AS industry_code,
         CAST(dense_rank() OVER (ORDER BY dong) - 1 AS INTEGER) AS dong_code,
         CAST(dense_rank() OVER (ORDER BY district) - 1 AS INTEGER) AS district_code
  FROM full_panel),
feats AS (
  SELECT * REPLACE (ln(1 + visitors) AS visitors, ln(1 + residents) AS residents,
                    ln(1 + spend_total) AS spend_total),
         affiliation_rate - avg(affiliation_rate) OVER (PARTITION BY district, dong ORDER BY month, industry
                                                       ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS aff_trend,
         CAST(month(CAST(month || '-01' AS DATE)) AS INTEGER) AS month_num,
         CAST(closure_rate > 0 AS INTEGER) AS closed_label
  FROM enc),
risk_rr AS (
  SELECT *, p * 0.8 + (1 - affiliation_rate) * 0.1 + (1 - visitors) * 0.05 + (1 - station_rate) * 0.05 AS risk_raw
  FROM (SELECT *, 0.5 * (1 - station_rate) + 0.5 * (1 - affiliation_rate) AS p FROM feats)),
risk AS (
  SELECT *, CASE WHEN mx > mn THEN (risk_raw - mn) / (mx - mn) ELSE 0 END AS risk_score
  FROM risk_rr, (SELECT min(risk_raw) AS mn, max(risk_raw) AS mx FROM risk_rr)),
clustered AS (
  SELECT *, ln(1 + spend_total) AS spend_total_log, ln(1 + visitors) AS visitors_log,
         ln(1 + avg_ticket) AS avg_ticket_log,
         CAST(closure_rate > 0.1 AS INTEGER) * 2 + CAST(affiliation_rate > 0.3 AS INTEGER) AS cluster
  FROM full_panel)"""

FCTES = PANEL_CTES + [FULL, FEATS]
KEYS4 = "month, district, dong, industry"
FEATURES = (["affiliation_rate", "station_rate", "tx_count", "tx_amount", "avg_ticket", "visitors",
             "residents", "status_f_ratio", "status_o_ratio", "flag_a_ratio", "flag_n_ratio",
             "flag_r_ratio"] + [f"line_{i}_ratio" for i in range(1, 8)]
            + ["spend_total", "industry_code", "dong_code", "district_code", "aff_trend"])
RAW_CLUSTER = ["closure_rate", "affiliation_rate", "visitors", "avg_years", "avg_ticket",
               "station_rate", "spend_total"]
CLUSTER_REPORT = ["closure_rate", "affiliation_rate", "avg_years", "station_rate",
                  "spend_total_log", "visitors_log", "avg_ticket_log"]


def F_(body: str) -> str:
    return with_ctes(body, FCTES)


SQL["label_encode"] = F_(f"SELECT {KEYS4}, industry_code, dong_code, district_code FROM feats")
SQL["closure_label"] = F_(f"SELECT {KEYS4}, closure_rate, closed_label FROM feats")
SQL["log_features"] = F_(f"SELECT {KEYS4}, {_r6(['visitors', 'residents', 'spend_total'])} FROM feats")
SQL["rolling_mean"] = F_(f"""SELECT {KEYS4}, affiliation_rate,
  {R('avg(affiliation_rate) OVER (PARTITION BY district, dong ORDER BY month, industry ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 6)} AS aff_rolling
FROM full_panel""")
SQL["rolling_trend"] = F_(f"SELECT {KEYS4}, {R('aff_trend', 6)} AS aff_trend, month_num FROM feats")

_z = ", ".join(
    f"{R(f'CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END', 6)} AS {c}_z" for c in CLUSTER_REPORT)
_zstats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in CLUSTER_REPORT)
_znn = " AND ".join(f"{c} IS NOT NULL" for c in CLUSTER_REPORT)
SQL["standardize"] = F_(f"""SELECT {KEYS4}, {_z}
FROM (SELECT * FROM clustered WHERE {_znn}) x, (SELECT {_zstats} FROM clustered WHERE {_znn}) s""")

SQL["class_weights"] = F_(f"""SELECT rows, pos, neg, {R('neg / pos', 6)} AS scale_pos_weight,
  {R('rows / (2 * pos)', 6)} AS weight_pos, {R('rows / (2 * neg)', 6)} AS weight_neg
FROM (SELECT count(*) AS rows, CAST(sum(closed_label) AS BIGINT) AS pos,
             count(*) - CAST(sum(closed_label) AS BIGINT) AS neg FROM feats)""")

SQL["null_profile"] = F_(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM feats" for c in FEATURES))

SQL["describe"] = F_(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST(count({c}) AS DOUBLE) AS count, {R(f'avg({c})', 6)} AS mean,
  {R(f'stddev_samp({c})', 6)} AS std, {R(f'min({c})', 6)} AS min,
  {R(f'quantile_cont({c}, 0.25)', 6)} AS q25, {R(f'quantile_cont({c}, 0.5)', 6)} AS q50,
  {R(f'quantile_cont({c}, 0.75)', 6)} AS q75, {R(f'max({c})', 6)} AS max FROM full_panel""" for c in RAW_CLUSTER))

SQL["histogram"] = F_(f"""SELECT feature, bin, {R('lo + (bin - 1) * ((hi - lo) / 30)', 6)} AS bin_lo,
  {R('lo + bin * ((hi - lo) / 30)', 6)} AS bin_hi, count(*) AS count
FROM (SELECT feature, value, lo, hi,
        CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 30) + 1, 30) ELSE 1 END AS INTEGER) AS bin
      FROM (SELECT feature, CAST(value AS DOUBLE) AS value FROM
              (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in RAW_CLUSTER)} FROM full_panel)
               ON {', '.join(RAW_CLUSTER)} INTO NAME feature VALUE value)) l
      JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM
              (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in RAW_CLUSTER)} FROM full_panel)
               ON {', '.join(RAW_CLUSTER)} INTO NAME feature VALUE value) GROUP BY feature) r USING (feature))
GROUP BY feature, bin, lo, hi""")

SQL["corr_target"] = F_(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'corr(CAST({c} AS DOUBLE), CAST(closed_label AS DOUBLE))', 6)} AS corr FROM feats"
    for c in FEATURES))

_pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
_cm = "SELECT " + ", ".join(
    f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS \"{a}|{b}\"" for a, b in _pairs) + " FROM feats"
SQL["corr_matrix"] = F_(f"""SELECT feature_a, feature_b, {R('c', 6)} AS corr FROM (
  SELECT split_part(pair, '|', 1) AS feature_a, split_part(pair, '|', 2) AS feature_b, c
  FROM (UNPIVOT ({_cm}) ON COLUMNS(*) INTO NAME pair VALUE c)
  UNION ALL
  SELECT split_part(pair, '|', 2), split_part(pair, '|', 1), c
  FROM (UNPIVOT ({_cm}) ON COLUMNS(*) INTO NAME pair VALUE c)
  WHERE split_part(pair, '|', 1) <> split_part(pair, '|', 2))""")

_mi_long = ("(UNPIVOT (SELECT closed_label AS y, "
            + ", ".join(f"CAST(coalesce(CAST({c} AS DOUBLE), 0) AS DOUBLE) AS {c}" for c in FEATURES)
            + f" FROM feats) ON {', '.join(FEATURES)} INTO NAME feature VALUE value)")
MI = f"""mi_long AS (SELECT * FROM {_mi_long}),
mi_rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM mi_long GROUP BY feature),
mi_cells AS (
  SELECT feature, CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 10), 9) ELSE 0 END AS bin,
         y, count(*) AS n
  FROM mi_long JOIN mi_rng USING (feature) GROUP BY ALL),
mi_t AS (
  SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, bin) AS nx,
         sum(n) OVER (PARTITION BY feature, y) AS ny FROM mi_cells),
mi AS (SELECT feature, {R('sum((n / nn) * ln((n * nn) / (nx * ny)))', 6)} AS mutual_info FROM mi_t GROUP BY feature)"""
SQL["mutual_info"] = with_ctes("SELECT * FROM mi", FCTES + [MI])
MI_QUANTILES = """mq_r AS (SELECT feature, y, floor((rank() OVER (PARTITION BY feature ORDER BY value) - 1) * 10
    / count(*) OVER (PARTITION BY feature)) AS bin FROM mi_long),
mq_cells AS (SELECT feature, bin, y, count(*) AS n FROM mq_r GROUP BY ALL),
mq_t AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, bin) AS nx,
         sum(n) OVER (PARTITION BY feature, y) AS ny FROM mq_cells)"""
_mi_long_cte = MI.split("\nmi_rng")[0].rstrip(",")
SQL["mutual_info_quantiles"] = with_ctes(
    f"SELECT feature, {R('sum((n / nn) * ln((n * nn) / (nx * ny)))', 6)} AS mutual_info FROM mq_t GROUP BY feature",
    FCTES + [_mi_long_cte, MI_QUANTILES])


def _psi(x: str) -> str:
    """The digamma function of a whole number of 1 or more: eight steps and a series."""
    z = f"({x} + 8.0::DOUBLE)"
    return (f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z}**2) + 1 / (120 * {z}**4) - 1 / (252 * {z}**6) + 1 / (240 * {z}**8)"
            + "".join(f" - 1 / ({x} + {j}.0::DOUBLE)" for j in range(8)) + ")")


_sides = [(f, j) for j in (1, 2, 3) for f in ("lag", "lead")]
MI_NEIGHBOURS = f"""mk_c AS (SELECT feature, y, value + 0.0 AS value, count(*) AS n FROM mi_long GROUP BY ALL),
mk_s AS (SELECT feature, y, sum(n) AS ny FROM mk_c GROUP BY ALL HAVING sum(n) > 1),
mk AS (SELECT mk_c.*, ny FROM mk_c JOIN mk_s USING (feature, y)),
mk_w AS (SELECT *, {', '.join(f'abs({f}(value, {j}) OVER w - value) AS d_{f}{j}, {f}(n, {j}) OVER w AS n_{f}{j}' for f, j in _sides)}
  FROM mk WINDOW w AS (PARTITION BY feature, y ORDER BY value)),
mk_l AS (SELECT feature, y, value, n, ny, list_sort(flatten([list_transform(range(least(3, n - 1)::BIGINT), lambda k: 0.0::DOUBLE),
  {', '.join(f'list_transform(range(least(3, coalesce(n_{f}{j}, 0))::BIGINT), lambda k: d_{f}{j})' for f, j in _sides)}]))[least(3, ny - 1)::BIGINT] AS d FROM mk_w),
mk_m AS (SELECT a.feature, a.y, a.value, any_value(a.n) AS n, any_value(a.ny) AS ny, any_value(a.d) AS d, sum(b.n) AS m
  FROM mk_l a JOIN mk b ON a.feature = b.feature AND (a.d = 0 AND b.value = a.value
    OR b.value > a.value - a.d AND b.value < a.value + a.d) GROUP BY a.feature, a.y, a.value),
mk_t AS (SELECT feature, {_psi('sum(n)')} + sum(n * ({_psi('CASE WHEN d = 0 THEN n ELSE least(3, ny - 1) END')}
  - {_psi('ny')} - {_psi('m')})) / sum(n) AS v FROM mk_m GROUP BY feature)"""
SQL["mutual_info_neighbours"] = with_ctes(
    f"SELECT feature, {R('greatest(v, 0)', 6)} AS mutual_info FROM mk_t", FCTES + [_mi_long_cte, MI_NEIGHBOURS])
_grp = {"status": ["status_f_ratio", "status_o_ratio"], "flag": ["flag_a_ratio", "flag_n_ratio", "flag_r_ratio"],
        "line": [f"line_{i}_ratio" for i in range(1, 8)], "trade": ["tx_count", "tx_amount"]}
_case = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(f) for f in fs)}) THEN '{g}'" for g, fs in _grp.items()) + " END"
SQL["mi_group_top"] = with_ctes(f"""SELECT "group", feature, mutual_info FROM (
  SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY mutual_info DESC, feature) AS rn
  FROM (SELECT {_case} AS "group", feature, mutual_info FROM mi) WHERE "group" IS NOT NULL) WHERE rn = 1""",
                                FCTES + [MI])

SQL["risk_score"] = F_(f"SELECT {KEYS4}, {_r6(['p', 'risk_raw', 'risk_score'])} FROM risk")


def _top(keys: list[str], where: str = "", label: bool = False) -> str:
    k = ", ".join(keys)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    lab = ", " + " || ' - ' || ".join(keys) + " AS area" if label else ""
    cond = f"WHERE {nn}" + (f" AND {where}" if where else "")
    return f"""SELECT {k}, {R('avg(risk_score)', 6)} AS mean_risk{lab} FROM risk {cond}
GROUP BY {k} ORDER BY mean_risk DESC, {k} LIMIT 10"""


SQL["risk_by_dong"] = F_(_top(["dong"]))
SQL["risk_by_industry"] = F_(_top(["industry"]))
SQL["risk_by_district_industry"] = F_(_top(["district", "industry"], label=True))
SQL["risk_benchmarks"] = F_(f"""SELECT
  (SELECT {R('avg(m)', 6)} FROM (SELECT avg(risk_score) AS m FROM risk WHERE dong IS NOT NULL GROUP BY dong)) AS dong_mean_of_means,
  (SELECT {R('avg(m)', 6)} FROM (SELECT avg(risk_score) AS m FROM risk WHERE industry IS NOT NULL GROUP BY industry)) AS industry_mean_of_means,
  (SELECT {R('avg(m)', 6)} FROM (SELECT avg(risk_score) AS m FROM risk WHERE district IS NOT NULL AND industry IS NOT NULL GROUP BY district, industry)) AS district_industry_mean_of_means,
  (SELECT {R('avg(risk_score)', 6)} FROM risk) AS row_mean""")

SQL["cluster_profile"] = F_("SELECT cluster, " + ", ".join(f"{R(R(f'avg({c})', 9), 3)} AS {c}" for c in CLUSTER_REPORT)
                            + " FROM clustered GROUP BY cluster")
SQL["cluster_sizes"] = F_("SELECT cluster, count(*) AS rows FROM clustered GROUP BY cluster")
ROLES = """prof AS (SELECT cluster, avg(closure_rate) AS cl, avg(affiliation_rate) AS af FROM {src} GROUP BY cluster),
dz AS (SELECT cluster AS danger FROM prof ORDER BY cl DESC, cluster LIMIT 1),
op AS (SELECT cluster AS opp FROM prof WHERE cluster <> (SELECT danger FROM dz) ORDER BY af ASC, cluster LIMIT 1),
roles AS (SELECT *, CASE WHEN cluster = (SELECT danger FROM dz) THEN 'danger'
                         WHEN cluster = (SELECT opp FROM op) THEN 'opportunity' ELSE 'other' END AS role FROM {src})"""


def _pct(c: str, cond: str) -> str:
    return R(R(R(f"avg(CASE WHEN {cond} THEN {c} END)", 9) + " * 100", 9), 2)


SQL["cluster_kpi"] = with_ctes(f"""SELECT
  {_pct('closure_rate', "role = 'danger'")} AS danger_closure_pct,
  {_pct('affiliation_rate', "role = 'danger'")} AS danger_affiliation_pct,
  {_pct('closure_rate', "role = 'opportunity'")} AS opportunity_closure_pct,
  {_pct('affiliation_rate', "role = 'opportunity'")} AS opportunity_affiliation_pct,
  {_pct('closure_rate', "role <> 'danger'")} AS non_danger_closure_pct,
  {_pct('affiliation_rate', "role <> 'danger'")} AS non_danger_affiliation_pct
FROM roles""", FCTES + [ROLES.format(src="clustered")])
SQL["cluster_top_areas"] = with_ctes(
    _top(["dong"]).replace("FROM risk", "FROM roles").replace("WHERE dong IS NOT NULL", "WHERE dong IS NOT NULL AND role = 'danger'"),
    FCTES + ["rc AS (SELECT *, CAST(closure_rate > 0.1 AS INTEGER) * 2 + CAST(affiliation_rate > 0.3 AS INTEGER) AS cluster FROM risk)",
             ROLES.format(src="rc")])


# ---------------------------------------------------------------- sources, cleaning, metrics
SQL["scan_not_null"] = with_ctes("SELECT store_id AS uid, dong, close_month FROM stores WHERE close_month IS NOT NULL",
                                 [STORES])
SQL["csv_roundtrip"] = SQL["panel_rates"]
SQL["parse_numeric"] = """SELECT id, amount_text, TRY_CAST(replace(amount_text, ',', '') AS DOUBLE) AS amount
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a'
             ELSE format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) END AS amount_text FROM orders)"""
LIC = """lic AS (
  SELECT o_orderkey AS id, o_orderdate AS open_date,
         CASE WHEN o_orderstatus = 'F' THEN strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER), '%Y-%m-%d')
              WHEN o_orderstatus = 'P' THEN 'unknown' END AS close_text
  FROM orders),
licp AS (SELECT *, try_strptime(close_text, '%Y-%m-%d') AS close_date FROM lic)"""
SQL["study_window_filter"] = with_ctes("""
SELECT id, strftime(open_date, '%Y-%m-%d') AS open_date, close_text, strftime(close_date, '%Y-%m-%d') AS close_date,
       CAST(close_date IS NOT NULL AS INTEGER) AS closed_flag
FROM licp
WHERE open_date <= TIMESTAMP '2001-09-30' AND (close_date IS NULL OR close_date BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2001-09-30')""",
                                       [LIC])
SQL["drop_incomplete"] = with_ctes("""
SELECT id, strftime(open_date, '%Y-%m-%d') AS open_date, coalesce(close_text, '') AS close_text,
       strftime(close_date, '%Y-%m-%d') AS close_date
FROM licp WHERE open_date IS NOT NULL AND close_date IS NOT NULL""", [LIC])
SQL["mode_fill"] = """WITH src AS (
  SELECT c_custkey AS unique_id, CAST(c_nationkey AS VARCHAR) AS legal_dong_code,
         nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END, '') AS dong,
         nullif(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE substr(c_mktsegment, 1, 2) END, '') AS dong_code
  FROM customer),
v AS (SELECT * FROM src WHERE dong IS NOT NULL AND dong_code IS NOT NULL),
m1 AS (SELECT legal_dong_code, m_dong FROM (
  SELECT legal_dong_code, dong AS m_dong, row_number() OVER (PARTITION BY legal_dong_code ORDER BY count(*) DESC, dong) AS rn
  FROM v GROUP BY legal_dong_code, dong) WHERE rn = 1),
m2 AS (SELECT legal_dong_code, m_code FROM (
  SELECT legal_dong_code, dong_code AS m_code, row_number() OVER (PARTITION BY legal_dong_code ORDER BY count(*) DESC, dong_code) AS rn
  FROM v GROUP BY legal_dong_code, dong_code) WHERE rn = 1)
SELECT unique_id, legal_dong_code, coalesce(dong, m_dong) AS dong, coalesce(dong_code, m_code) AS dong_code
FROM src LEFT JOIN m1 USING (legal_dong_code) LEFT JOIN m2 USING (legal_dong_code)"""
SQL["json_flatten"] = """SELECT event_id AS uid, user_id, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.text') AS text, json_extract_string(props, '$.level1') AS level1,
       json_extract_string(props, '$.level2') AS level2
FROM events"""
SCORED = """scored AS (
  SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
         """ + R("o_totalprice / 500000", 2) + """ AS p FROM orders),
sp AS (SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM scored),
sc AS (SELECT p AS score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY p)"""
SQL["confusion"] = with_ctes("SELECT y AS actual, pred AS predicted, count(*) AS count FROM sp GROUP BY 1, 2", [SCORED])
_cls = []
for k in (0, 1):
    _cls.append(f"""SELECT '{k}' AS class, coalesce(tp / nullif(pp, 0), 0) AS precision,
       coalesce(tp / nullif(support, 0), 0) AS recall, CAST(support AS BIGINT) AS support
FROM (SELECT CAST(count(*) FILTER (WHERE y = {k} AND pred = {k}) AS DOUBLE) AS tp,
             CAST(count(*) FILTER (WHERE pred = {k}) AS DOUBLE) AS pp,
             count(*) FILTER (WHERE y = {k}) AS support FROM sp)""")
SQL["class_report"] = with_ctes(f"""pr AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
FROM ({' UNION ALL '.join(_cls)})),
allr AS (
  SELECT class, precision, recall, f1, support FROM pr
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pr
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pr)
SELECT class, {R('precision', 6)} AS precision, {R('recall', 6)} AS recall, {R('f1', 6)} AS f1, support FROM allr""",
                                [SCORED]).replace("WITH scored", "WITH scored", 1).replace(
    ")\npr AS", "),\npr AS", 1)
SQL["roc_auc"] = with_ctes(f"""SELECT {R('sum(pos * (cum_neg - neg) + 0.5 * pos * neg) / (sum(pos) * sum(neg))', 6)} AS roc_auc
FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM sc)""",
                           [SCORED])
SQL["average_precision"] = with_ctes(f"""SELECT {R('sum(pos * cum_pos / (cum_pos + cum_neg)) / sum(pos)', 6)} AS average_precision
FROM (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM sc
      WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", [SCORED])


# ---------------------------------------------------------------- merchant names
NAMES = r"""raw AS (
  SELECT p_partkey AS uid,
         CASE p_partkey % 10 WHEN 0 THEN '(주)' || p_name WHEN 1 THEN p_name || ' 서면점'
              WHEN 2 THEN replace(p_name, ' ', '') || '점' WHEN 3 THEN p_name || '(brand)'
              WHEN 4 THEN '(' || upper(p_name) || ')' WHEN 5 THEN '주식회사  ' || p_name
              WHEN 6 THEN p_name || '(한시적)' WHEN 7 THEN '!' WHEN 8 THEN NULL
              ELSE replace(p_name, ' ', '') END AS raw_name
  FROM part),
s1 AS (SELECT uid, raw_name, trim(regexp_replace(raw_name, '\s+', ' ', 'g')) AS s FROM raw),
s2 AS (SELECT uid, raw_name,
         replace(replace(replace(replace(replace(replace(replace(replace(replace(s, '(주)', ''), '( 주)', ''),
           '(주', ''), '주)', ''), '( 주', ''), '주식회사', ''), '-한시적', ''), ' -한시적', ''), '(한시적)', '') AS s
       FROM s1),
s3 AS (SELECT uid, raw_name, regexp_extract_all(s, '\(([^)]*[a-z][^)]*)\)', 1) AS eng,
              trim(regexp_replace(s, '\([^)]*\)', '', 'g')) AS s FROM s2),
s4 AS (SELECT uid, raw_name, eng, regexp_replace(s, '\s+\S{1,20}(지점|점|센터|분점)$', '') AS s FROM s3),
c1 AS (SELECT uid, raw_name,
         CASE WHEN raw_name IS NULL THEN NULL
              WHEN regexp_matches(s, '[가-힣a-z0-9]{2,}(지점|점|센터|분점)$') THEN 'HOLD'
              WHEN regexp_full_match(s, '[^\w\s]') THEN NULL
              WHEN trim(s) = '' THEN NULL
              WHEN trim(s) = '주' AND len(eng) = 0 THEN NULL
              WHEN len(eng) > 0 THEN trim(s) || ' ' || array_to_string(eng, ' ')
              ELSE trim(s) END AS first
       FROM s4),
names_clean AS (
  SELECT uid, raw_name,
         coalesce(first, CASE WHEN regexp_matches(raw_name, '\(([^)]*[a-zA-Z][^)]*)\)')
                                   AND lower(trim(regexp_replace(raw_name, '[()]', '', 'g'))) <> 'null'
                              THEN lower(trim(regexp_replace(raw_name, '[()]', '', 'g'))) END) AS clean_name
  FROM c1),
vocab AS (
  SELECT clean_name AS brand, count(*) AS freq, CAST(length(clean_name) AS INTEGER) AS len
  FROM names_clean WHERE clean_name IS DISTINCT FROM 'HOLD' AND length(clean_name) >= 2
  GROUP BY clean_name ORDER BY freq DESC, brand LIMIT 500),
hold AS (
  SELECT uid, raw_name, trim(replace(regexp_replace(raw_name, '\s*\( ?주\)?\s*', '', 'g'), '주식회사', '')) AS nb
  FROM names_clean WHERE clean_name = 'HOLD'),
cand AS (
  SELECT h.uid, h.raw_name, v.brand,
         row_number() OVER (PARTITION BY h.uid ORDER BY v.len DESC, v.freq DESC, v.brand) AS rn
  FROM hold h JOIN vocab v
    ON CASE WHEN v.len <= 2 AND regexp_matches(v.brand, '[a-z]') THEN regexp_matches(h.nb, '\b' || v.brand || '\b')
            ELSE contains(h.nb, v.brand) END),
hb AS (SELECT uid, raw_name, brand FROM cand WHERE rn = 1),
hk AS (SELECT uid, raw_name, brand AS clean_name, brand AS result FROM hb
       WHERE brand IN (SELECT brand FROM hb GROUP BY brand HAVING count(*) >= 3)
         AND brand NOT IN ('중앙', '잡화', '우리', '우정', '제일', '그린', '대성', '드림', '타임', '스타',
                           '마루', '명가', '정성', '코코', '현대')),
names_final AS (
  SELECT uid, raw_name, clean_name, clean_name AS result FROM names_clean WHERE clean_name IS DISTINCT FROM 'HOLD'
  UNION ALL SELECT * FROM hk),
syn AS (
  SELECT uid, raw_name,
         lower(CASE clean_name WHEN '씨유' THEN 'CU' WHEN '씨유 CU' THEN 'CU' WHEN '지에스25' THEN 'GS25'
               WHEN '지에스25 GS' THEN 'GS25' WHEN '지에스25 GS25' THEN 'GS25' WHEN '이디야' THEN '이디야커피'
               ELSE clean_name END) AS clean_name,
         lower(CASE result WHEN '씨유' THEN 'CU' WHEN '씨유 CU' THEN 'CU' WHEN '지에스25' THEN 'GS25'
               WHEN '지에스25 GS' THEN 'GS25' WHEN '지에스25 GS25' THEN 'GS25' WHEN '이디야' THEN '이디야커피'
               ELSE result END) AS result
  FROM names_final),
embed AS (
  SELECT uid, raw_name,
         trim(regexp_replace(regexp_replace(translate(regexp_replace(clean_name, '[()]', '', 'g'), ',/', '  '),
              '[^가-힣a-z0-9\s\-&.·]', '', 'g'), '\s+', ' ', 'g')) AS clean_name,
         trim(regexp_replace(regexp_replace(translate(regexp_replace(result, '[()]', '', 'g'), ',/', '  '),
              '[^가-힣a-z0-9\s\-&.·]', '', 'g'), '\s+', ' ', 'g')) AS result
  FROM syn
  WHERE clean_name IS NOT NULL AND (NOT regexp_full_match(clean_name, '[0-9]+') OR length(clean_name) = 4))"""

SQL["names_clean"] = with_ctes("SELECT uid, raw_name, clean_name, clean_name AS result FROM names_clean", [NAMES])
SQL["names_vocab"] = with_ctes("SELECT * FROM vocab", [NAMES])
SQL["brand_extract"] = with_ctes("SELECT * FROM hk", [NAMES])
SQL["names_final"] = with_ctes("SELECT * FROM names_final", [NAMES])
SQL["names_embed_ready"] = with_ctes("SELECT * FROM embed WHERE length(trim(clean_name)) > 1", [NAMES])


# ---------------------------------------------------------------- spatial and fuzzy joins
def _hav(a: str, b: str) -> str:
    return (f"6371000.0 * 2 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + "
            f"cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))")


GEO = """geo_est AS (
  SELECT p_partkey AS id, p_name AS name,
         CAST(35.1 AS DOUBLE) + CAST(p_partkey % 40 AS DOUBLE) * CAST(0.0003 AS DOUBLE) AS lat,
         CAST(129.0 AS DOUBLE) + CAST((p_partkey // 40) % 25 AS DOUBLE) * CAST(0.0003 AS DOUBLE) AS lon
  FROM part WHERE p_size <= 25),
geo_mer AS (
  SELECT p_partkey AS id, p_name AS name,
         CAST(35.1 AS DOUBLE) + CAST(p_partkey % 40 AS DOUBLE) * CAST(0.0003 AS DOUBLE) + CAST(0.0001 AS DOUBLE) AS lat,
         CAST(129.0 AS DOUBLE) + CAST((p_partkey // 40) % 25 AS DOUBLE) * CAST(0.0003 AS DOUBLE) AS lon
  FROM part WHERE p_size > 25),
pairs AS (
  SELECT e.id AS e_id, e.name AS e_name, e.lat AS e_lat, e.lon AS e_lon,
         m.id AS m_id, m.name AS m_name, m.lat AS m_lat, m.lon AS m_lon,
         """ + _hav("e", "m") + """ AS distance_m,
         1 - levenshtein(e.name, m.name) / greatest(length(e.name), length(m.name)) AS similarity_score
  FROM geo_est e CROSS JOIN geo_mer m),
matched AS (
  SELECT * FROM pairs
  WHERE (similarity_score >= 0.9 AND distance_m <= 100)
     OR (similarity_score >= 0.7 AND similarity_score < 0.9 AND distance_m <= 50)),
best AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY e_id ORDER BY similarity_score DESC, distance_m, m_id) AS rn
    FROM matched) WHERE rn = 1)"""
PTS = """pts AS (
  SELECT c_custkey AS id, CAST(35.1 AS DOUBLE) + CAST(c_custkey % 100 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lat,
         CAST(129.0 AS DOUBLE) + CAST(c_custkey // 100 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lon
  FROM customer),
sta AS (
  SELECT s_suppkey AS station_id, CAST(35.1 AS DOUBLE) + CAST(s_suppkey % 10 AS DOUBLE) * CAST(0.02 AS DOUBLE) AS lat,
         CAST(129.0 AS DOUBLE) + CAST(s_suppkey // 10 AS DOUBLE) * CAST(0.003 AS DOUBLE) AS lon
  FROM supplier),
pd AS (SELECT p.id, s.station_id, """ + _hav("p", "s") + """ AS distance_m FROM pts p CROSS JOIN sta s)"""

_M = ["e_id", "e_name", "e_lat", "e_lon", "m_id", "m_name", "m_lat", "m_lon"]
SQL["haversine"] = with_ctes(f"SELECT e_id, m_id, {R('distance_m', 6)} AS distance_m FROM pairs WHERE distance_m <= 100", [GEO])
SQL["name_similarity"] = with_ctes(f"""SELECT e_id, m_id, e_name, m_name, {R('similarity_score', 6)} AS similarity_score
FROM pairs WHERE distance_m <= 100""", [GEO])
SQL["fuzzy_geo_match"] = with_ctes(f"""SELECT {', '.join(_M)}, {R('distance_m', 6)} AS distance_m,
  {R('similarity_score', 6)} AS similarity_score FROM matched""", [GEO])
SQL["best_match"] = with_ctes(f"""SELECT {', '.join(_M)}, {R('distance_m', 6)} AS distance_m,
  {R('similarity_score', 6)} AS similarity_score FROM best""", [GEO])
SQL["affiliation_flag"] = with_ctes("""SELECT id, name, CASE WHEN id IN (SELECT e_id FROM best) THEN 1 ELSE 0 END AS affiliated
FROM geo_est""", [GEO])
SQL["near_station"] = with_ctes(f"""SELECT id, {R('lat', 6)} AS lat, {R('lon', 6)} AS lon,
  CASE WHEN id IN (SELECT id FROM pd WHERE distance_m <= 500) THEN 1 ELSE 0 END AS near_station FROM pts""", [PTS])
SQL["reverse_geocode"] = with_ctes(f"""SELECT p.id, {R('p.lat', 6)} AS lat, {R('p.lon', 6)} AS lon, b.station_id,
  {R('b.distance_m', 6)} AS distance_m
FROM pts p LEFT JOIN (
  SELECT id, station_id, distance_m FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance_m, station_id) AS rn FROM pd)
  WHERE rn = 1) b USING (id)""", [PTS])

SQL["incremental_append"] = SQL["reverse_geocode"]

SQL["industry_map"] = with_ctes("""SELECT store_id, industry, split_part(industry, '/', 1) AS industry_code,
  CASE split_part(industry, '/', 1) WHEN 'AUTOMOBILE' THEN 'retail' WHEN 'BUILDING' THEN 'construction'
       WHEN 'FURNITURE' THEN 'retail' WHEN 'HOUSEHOLD' THEN 'services' WHEN 'MACHINERY' THEN 'manufacturing'
  END AS industry_group
FROM stores""", [STORES])

# binned Gaussian KDE (512 bins, 50 grid points, Scott bandwidth); the grid x
# bins product is fine for an oracle
DENS = """dx AS (SELECT CAST(closure_rate AS DOUBLE) AS x FROM full_panel
           WHERE closure_rate IS NOT NULL AND NOT isnan(closure_rate)),
ds AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, stddev_samp(x) AS sd FROM dx),
db AS (SELECT CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 512), 511) ELSE 0 END AS b,
              count(*) AS c FROM dx, ds GROUP BY 1),
dm AS (SELECT lo + (b + 0.5) * ((hi - lo) / 512) AS m, c FROM db, ds),
dg AS (SELECT lo + i * (hi - lo) / 49 AS x FROM ds, range(0, 50) t(i)),
dh AS (SELECT greatest(coalesce(sd, 0) * pow(CAST(n AS DOUBLE), -0.2), 1e-12) AS h, n FROM ds)"""
SQL["density"] = with_ctes(f"""SELECT 'closure_rate' AS feature, {R('dg.x', 6)} AS x,
       {R('sum(c * exp(-0.5 * pow((dg.x - m) / h, 2))) / (n * h * 2.5066282746310002)', 6)} AS density
FROM dg, dm, dh GROUP BY dg.x, h, n""", FCTES + [DENS])
SQL["incremental_append_stream"] = SQL["reverse_geocode"]

# samples, split and folds by the MD5 of the seed and the row key
_hash = "CAST('0x' || substr(md5(concat_ws('|', '42', month, district, dong, industry)), 1, 15) AS BIGINT)"
SQL["hash_split"] = F_(f"SELECT {KEYS4}, closed_label, CASE WHEN {_hash} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM feats")
SQL["hash_sample"] = F_(f"SELECT {KEYS4}, closed_label FROM feats ORDER BY {_hash}, {KEYS4} LIMIT 5000")
SQL["stratified_folds"] = F_(f"""SELECT {KEYS4}, closed_label, CAST((row_number() OVER (PARTITION BY closed_label
  ORDER BY {_hash}, {KEYS4}) - 1) % 3 AS INTEGER) AS fold FROM feats""")
