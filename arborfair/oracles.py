"""DuckDB SQL that computes the registered queries another way, from the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

LINES = """lines AS (
  SELECT *, l_extendedprice * (1 - l_discount) AS net,
         CASE WHEN l_extendedprice * (1 - l_discount) >= 50000 THEN 1 ELSE 0 END AS y
  FROM lineitem)"""

CUSTOMERS = """customers AS (
  SELECT c_custkey, c_acctbal, CAST(c_nationkey AS VARCHAR) AS nation, c_nationkey, c_mktsegment, r_name,
         CASE WHEN c_acctbal + 1000 * n_regionkey >= 6500 THEN 1 ELSE 0 END AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

SCORED = CUSTOMERS + """, scored AS (
  SELECT *, CASE WHEN c_acctbal <= 4500 THEN CASE WHEN c_nationkey % 5 IN (3, 4) THEN 'LL' ELSE 'LR' END ELSE 'R' END AS leaf,
         CASE WHEN c_acctbal <= 4500 AND c_nationkey % 5 NOT IN (3, 4) THEN 0 ELSE 1 END AS p
  FROM customers)"""

SCORED_BALANCE = CUSTOMERS + """, scored AS (
  SELECT *, CASE WHEN c_acctbal <= 5000 THEN 0 ELSE 1 END AS p FROM customers)"""

NULLS = """src AS (
  SELECT l_quantity, nullif(l_tax, 0) AS tax, CASE WHEN l_linenumber = 7 THEN -9 ELSE l_linenumber END AS line,
         CASE WHEN l_linenumber > 4 THEN l_discount END AS rare, l_returnflag,
         CASE WHEN l_extendedprice * (1 - l_discount) >= 50000 THEN 1 ELSE 0 END AS y
  FROM lineitem)"""


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


# -- cleaning ----------------------------------------------------------------------------

add("drop_incomplete_counts", f"""WITH {NULLS}
SELECT count(*) AS n_rows, count(*) FILTER (tax IS NOT NULL AND rare IS NOT NULL) AS n_kept,
       count(*) FILTER (tax IS NULL OR rare IS NULL) AS n_dropped FROM src""")

add("clean_recipe", f"""WITH {NULLS}, c AS (
  SELECT l_quantity, tax, CASE WHEN line NOT IN (-9, -8, -7) THEN line END AS line, y FROM src)
SELECT y, count(*) AS n, round(sum(tax), 4) AS tax, CAST(sum(line) AS BIGINT) AS line,
       CAST((SELECT CASE WHEN avg(CASE WHEN rare IS NULL THEN 1.0 ELSE 0 END) > 0.5 THEN 3 ELSE 4 END FROM src) AS INTEGER) AS n_features
FROM c WHERE tax IS NOT NULL AND line IS NOT NULL GROUP BY y""")

add("class_balance", """SELECT event_type AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 8) AS share
FROM events GROUP BY event_type""")

add("column_null_profile", f"""WITH {NULLS}
SELECT 'l_quantity' AS "column", count(*) FILTER (l_quantity IS NULL) AS n_null, round(count(*) FILTER (l_quantity IS NULL) / count(*), 8) AS null_fraction FROM src
UNION ALL SELECT 'tax', count(*) FILTER (tax IS NULL), round(count(*) FILTER (tax IS NULL) / count(*), 8) FROM src
UNION ALL SELECT 'rare', count(*) FILTER (rare IS NULL), round(count(*) FILTER (rare IS NULL) / count(*), 8) FROM src""")

add("sparse_columns", f"""WITH {NULLS}
SELECT l_returnflag, count(*) AS n, count(tax) AS n_tax,
       (SELECT 'l_quantity,tax,line,' || CASE WHEN avg(CASE WHEN rare IS NULL THEN 1.0 ELSE 0 END) > 0.5 THEN '' ELSE 'rare,' END || 'l_returnflag,y' FROM src) AS "columns"
FROM src GROUP BY l_returnflag""")

add("median_impute", f"""WITH {NULLS}
SELECT y, count(*) AS n_tax, round(sum(coalesce(tax, (SELECT median(tax) FROM src))), 4) AS tax,
       round(sum(l_quantity), 4) AS quantity FROM src GROUP BY y""")

add("sentinel_null", f"""WITH {NULLS}
SELECT CASE WHEN line IN (-9, -8, -7) THEN NULL ELSE line END AS line, count(*) AS n FROM src GROUP BY 1""")

add("numeric_coercion", """SELECT TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE substr(o_orderpriority, 1, 1) END AS DOUBLE) AS priority,
       count(*) AS n FROM orders GROUP BY 1""")

add("recode_default", """SELECT CASE c_nationkey % 9 WHEN 1 THEN 'white' WHEN 2 THEN 'black' WHEN 3 THEN 'hispanic' WHEN 4 THEN 'asian' ELSE 'other' END AS race,
       count(*) AS n FROM customer GROUP BY 1""")

add("conditional_rename", f"""WITH {LINES}
SELECT y, round(sum(l_quantity), 4) AS quantity, round(max(l_extendedprice), 4) AS price, round(min(l_discount), 4) AS discount
FROM lines GROUP BY y""")

add("label_rules", """SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f, 0 AS raw_f,
       CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS "class",
       CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) > 0 THEN 1 ELSE 0 END AS positive, count(*) AS n
FROM orders GROUP BY ALL""")

add("allowed_labels", "SELECT label AS y, count(*) AS n FROM embeddings WHERE label IN (0, 1) GROUP BY 1")

add("target_profile", """SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events""")

# -- target and split --------------------------------------------------------------------

add("label_encode", """WITH k AS (SELECT DISTINCT event_type AS label FROM events),
c AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM k)
SELECT c.label, code, count(*) AS n FROM events JOIN c ON event_type = c.label GROUP BY ALL""")

add("median_binarize", """WITH m AS (SELECT median(value) AS m FROM events)
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value >= m THEN 1 ELSE 0 END) AS BIGINT) AS n_high, round(m, 8) AS median
FROM events, m GROUP BY event_type, m""")

SPLIT = """n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
t AS (SELECT CAST(ceil(0.3 * sum(n)) AS BIGINT) AS t, sum(n) AS total FROM n),
s AS (SELECT event_type, t * n / total AS share, t FROM n, t),
f AS (SELECT event_type, CAST(floor(share) AS BIGINT) AS base, t, row_number() OVER (ORDER BY round(share - floor(share), 12) DESC, event_type) AS r FROM s),
q AS (SELECT event_type, base + CASE WHEN r <= t - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS quota FROM f),
o AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':7'), event_id) AS r FROM events),
marked AS (SELECT o.event_id, o.event_type, o.r <= q.quota AS is_test FROM o JOIN q USING (event_type))"""

add("stratified_split_counts", f"WITH {SPLIT} SELECT event_type, is_test, count(*) AS n FROM marked GROUP BY ALL")
add("stratified_split_rows", f"WITH {SPLIT} SELECT event_id, event_type FROM marked WHERE is_test")
add("plain_split_rows", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS r FROM orders)
SELECT o_orderkey FROM o WHERE r <= (SELECT ceil(0.2 * count(*)) FROM orders)""")

# -- binary features ---------------------------------------------------------------------


def kept(source: str, columns: list[str], m: int) -> str:
    """CTE ``kept``: the values kept per column, thinned by rank, with midpoints."""
    parts = " UNION ALL ".join(
        f"SELECT DISTINCT {i} AS ord, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL"
        for i, c in enumerate(columns))
    return f"""dist AS ({parts}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY col) AS n FROM dist),
thin AS (SELECT * FROM ranked WHERE n <= {m + 1} OR r IN (SELECT (i * (n - 1)) // {m} FROM range(0, {m + 1}) g(i))),
kept AS (SELECT ord, col, v, row_number() OVER (PARTITION BY col ORDER BY v) - 1 AS k,
         (v + lead(v) OVER (PARTITION BY col ORDER BY v)) / 2.0 AS thr FROM thin)"""


def tests(source: str, numeric: list[str], categorical: list[str], m: int) -> str:
    """CTEs ending in ``tests(fid, col, thr, cat)``: thresholds first, then categories."""
    cats = " UNION ALL ".join(
        f"SELECT DISTINCT {len(numeric) + i} AS ord, '{c}' AS col, {c} AS cat FROM {source}"
        for i, c in enumerate(categorical)) or "SELECT 0 AS ord, '' AS col, '' AS cat WHERE false"
    return kept(source, numeric, m) + f""", cats AS ({cats}),
listed AS (SELECT ord, col, thr, NULL AS cat FROM kept WHERE thr IS NOT NULL
           UNION ALL SELECT ord, col, NULL, cat FROM cats),
tests AS (SELECT CAST(row_number() OVER (ORDER BY ord, thr, cat) - 1 AS INTEGER) AS fid, col, thr, cat FROM listed)"""


def answers(source: str, numeric: list[str], categorical: list[str]) -> str:
    """CTEs ``combos`` (distinct rows with a number and class counts) and ``hits(id, fid)``, the true answers."""
    cols = ", ".join([*numeric, *categorical])
    values = " UNION ALL ".join(
        [f"SELECT id, '{c}' AS col, CAST({c} AS DOUBLE) AS v, NULL AS s FROM combos" for c in numeric]
        + [f"SELECT id, '{c}', NULL, {c} FROM combos" for c in categorical])
    return f"""combos AS (SELECT {cols}, row_number() OVER () AS id, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1
  FROM {source} GROUP BY {cols}),
vals AS ({values}),
hits AS (SELECT id, fid FROM vals JOIN tests ON vals.col = tests.col AND (v <= thr OR s = cat))"""


def entropy(a: str, b: str) -> str:
    def term(x: str) -> str:
        return f"(CASE WHEN {x} > 0 THEN -({x} / ({a} + {b})) * log2({x} / ({a} + {b})) ELSE 0 END)"

    return f"({term(a)} + {term(b)})"


LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linestatus"]

add("midpoint_thresholds", f"""WITH {LINES}, {kept('lines', LINE_NUMERIC, 10)}
SELECT col AS "column", CAST(k AS INTEGER) AS rank, round(v, 8) AS value, round(thr, 8) AS threshold FROM kept""")

add("category_vocabulary", """SELECT 0 AS feature, 'p_brand' AS "column", p_brand AS category FROM part GROUP BY ALL
UNION ALL SELECT 1, 'p_type', p_type FROM part GROUP BY ALL""")

add("binarize_matrix", f"""WITH {CUSTOMERS}, {kept('customers', ['c_acctbal'], 4)},
t AS (SELECT max(thr) FILTER (k = 0) AS a, max(thr) FILTER (k = 1) AS b, max(thr) FILTER (k = 2) AS c, max(thr) FILTER (k = 3) AS d FROM kept),
s AS (SELECT list(c_mktsegment ORDER BY c_mktsegment) AS s FROM (SELECT DISTINCT c_mktsegment FROM customers))
SELECT c_custkey, CAST(c_acctbal <= a AS INTEGER) AS t0, CAST(c_acctbal <= b AS INTEGER) AS t1, CAST(c_acctbal <= c AS INTEGER) AS t2,
       CAST(c_acctbal <= d AS INTEGER) AS t3, CAST(c_mktsegment = s[1] AS INTEGER) AS t4, CAST(c_mktsegment = s[2] AS INTEGER) AS t5,
       CAST(c_mktsegment = s[3] AS INTEGER) AS t6, CAST(c_mktsegment = s[4] AS INTEGER) AS t7, CAST(c_mktsegment = s[5] AS INTEGER) AS t8
FROM customers, t, s""")

add("one_hot", """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS t0, CAST(o_orderstatus = 'O' AS INTEGER) AS t1,
       CAST(o_orderstatus = 'P' AS INTEGER) AS t2, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS t3,
       CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS t4, CAST(o_orderpriority = '3-MEDIUM' AS INTEGER) AS t5,
       CAST(o_orderpriority = '4-NOT SPECIFIED' AS INTEGER) AS t6, CAST(o_orderpriority = '5-LOW' AS INTEGER) AS t7
FROM orders""")

add("feature_names", f"""WITH {LINES}, {tests('lines', ['l_quantity'], ['l_returnflag'], 3)}
SELECT fid, col AS "column", CASE WHEN cat IS NULL THEN '<=' ELSE '=' END AS op, cat AS category,
       CASE WHEN cat IS NULL THEN col || ' <= ' || CAST(thr AS VARCHAR) ELSE col || '=' || cat END AS name FROM tests""")

add("feature_map", f"""WITH {LINES}, {tests('lines', LINE_NUMERIC, LINE_CATEGORICAL, 10)}
SELECT CAST(list_position({LINE_NUMERIC + LINE_CATEGORICAL}, col) - 1 AS INTEGER) AS input, CAST(count(*) AS INTEGER) AS n,
       min(fid) AS first_fid, max(fid) AS last_fid FROM tests GROUP BY col""")

add("inverse_binarize", f"""WITH {LINES}, {kept('lines', ['l_discount', 'l_quantity'], 10)},
d AS (SELECT l_discount AS x, min(v) AS back FROM (SELECT DISTINCT l_discount FROM lines) JOIN kept ON col = 'l_discount' AND (thr IS NULL OR l_discount <= thr) GROUP BY 1),
q AS (SELECT l_quantity AS x, min(v) AS back FROM (SELECT DISTINCT l_quantity FROM lines) JOIN kept ON col = 'l_quantity' AND (thr IS NULL OR l_quantity <= thr) GROUP BY 1)
SELECT round(d.back, 8) AS l_discount, round(q.back, 8) AS l_quantity, count(*) AS n
FROM lines JOIN d ON l_discount = d.x JOIN q ON l_quantity = q.x GROUP BY 1, 2""")

# -- split statistics --------------------------------------------------------------------

add("gini_impurity", f"""WITH {LINES}, c AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b FROM lines GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2, 8) AS gini, round({entropy('a', 'b')}, 8) AS entropy FROM c""")

add("variance_impurity", f"""WITH {LINES} SELECT l_returnflag, round(var_pop(net) / 1e6, 4) AS variance FROM lines GROUP BY 1""")

add("majority_leaf", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY user_id) AS t FROM c)
SELECT user_id, event_type AS majority, CAST(t AS BIGINT) AS n, CAST(t - n AS BIGINT) AS errors FROM r WHERE r = 1""")


def gini_gain(l0: str, l1: str, t0: str, t1: str) -> str:
    def g(a: str, b: str) -> str:
        return f"(1.0 - (({a}) / ({a} + {b})) ** 2 - (({b}) / ({a} + {b})) ** 2)"

    r0, r1 = f"({t0} - {l0})", f"({t1} - {l1})"
    n = f"({t0} + {t1})"
    return (f"({g(t0, t1)} - (({l0} + {l1}) / {n}) * {g(l0, l1)} - (({r0} + {r1}) / {n}) * {g(r0, r1)})")


def numeric_splits(source: str, columns: list[str], prefix: str = "ns", min_leaf: int = 10) -> str:
    """CTE ``<prefix>_best(node, feature, thr, gain, l0, l1)`` over ``source`` with a column node."""
    long = " UNION ALL ".join(
        f"SELECT node, {i} AS feature, CAST({c} AS DOUBLE) AS v, y FROM {source}" for i, c in enumerate(columns))
    p = prefix
    return f"""{p}_v AS (SELECT node, feature, v, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM ({long}) GROUP BY 1, 2, 3),
{p}_c AS (SELECT node, feature, (v + lead(v) OVER w) / 2.0 AS thr, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1,
  sum(c0) OVER (PARTITION BY node, feature) AS t0, sum(c1) OVER (PARTITION BY node, feature) AS t1 FROM {p}_v
  WINDOW w AS (PARTITION BY node, feature ORDER BY v)),
{p}_g AS (SELECT *, {gini_gain('l0', 'l1', 't0', 't1')} AS gain FROM {p}_c
  WHERE thr IS NOT NULL AND l0 + l1 >= {min_leaf} AND t0 + t1 - l0 - l1 >= {min_leaf}),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY node, feature ORDER BY round(gain, 12) DESC, thr) AS r FROM {p}_g WHERE round(gain, 12) > 0),
{p}_best AS (SELECT node, feature, thr, gain, l0, l1 FROM {p}_r WHERE r = 1)"""


def category_splits(source: str, columns: list[str], prefix: str = "cs", first: int = 0, min_leaf: int = 10) -> str:
    """CTE ``<prefix>_best(node, feature, gain, cats)``: prefixes of the categories by target mean."""
    long = " UNION ALL ".join(
        f"SELECT node, {first + i} AS feature, {c} AS v, y FROM {source}" for i, c in enumerate(columns))
    p = prefix
    return f"""{p}_v AS (SELECT node, feature, v, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM ({long}) GROUP BY 1, 2, 3),
{p}_o AS (SELECT *, row_number() OVER (PARTITION BY node, feature ORDER BY round(c1 / (c0 + c1), 12), v) AS k FROM {p}_v),
{p}_c AS (SELECT node, feature, k, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, count(*) OVER (PARTITION BY node, feature) AS kk,
  sum(c0) OVER (PARTITION BY node, feature) AS t0, sum(c1) OVER (PARTITION BY node, feature) AS t1 FROM {p}_o
  WINDOW w AS (PARTITION BY node, feature ORDER BY k)),
{p}_g AS (SELECT *, {gini_gain('l0', 'l1', 't0', 't1')} AS gain FROM {p}_c
  WHERE k < kk AND l0 + l1 >= {min_leaf} AND t0 + t1 - l0 - l1 >= {min_leaf}),
{p}_r AS (SELECT *, row_number() OVER (PARTITION BY node, feature ORDER BY round(gain, 12) DESC, k) AS r FROM {p}_g WHERE round(gain, 12) > 0),
{p}_best AS (SELECT b.node, b.feature, b.gain, b.l0, b.l1, string_agg(o.v, ',' ORDER BY o.v) AS cats
  FROM {p}_r b JOIN {p}_o o ON o.node = b.node AND o.feature = b.feature AND o.k <= b.k WHERE r = 1 GROUP BY ALL)"""


add("best_numeric_split_clf", f"""WITH {LINES}, src AS (SELECT 0 AS node, * FROM lines), {numeric_splits('src', LINE_NUMERIC)}
SELECT CAST(feature AS INTEGER) AS feature, round(thr, 8) AS threshold, round(gain, 8) AS gain, CAST(l0 AS BIGINT) AS left_0, CAST(l1 AS BIGINT) AS left_1 FROM ns_best""")

add("best_numeric_split_by_node", f"""WITH {LINES}, src AS (SELECT ascii(l_returnflag) AS node, * FROM lines), {numeric_splits('src', LINE_NUMERIC)}
SELECT CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, round(thr, 8) AS threshold, round(gain, 8) AS gain FROM ns_best""")


def variance_split(source: str, columns: list[str], y: str, scale: str, digits: int) -> str:
    """CTE ``vs_best(feature, thr, gain, n)`` of a regression target centred at its mean."""
    long = " UNION ALL ".join(
        f"SELECT {i} AS feature, CAST({c} AS DOUBLE) AS v, {y} - (SELECT avg({y}) FROM {source}) AS y FROM {source}"
        for i, c in enumerate(columns))
    return f"""vs_v AS (SELECT feature, v, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM ({long}) GROUP BY 1, 2),
vs_c AS (SELECT feature, (v + lead(v) OVER w) / 2.0 AS thr, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss,
  sum(n) OVER f AS tn, sum(s) OVER f AS ts, sum(ss) OVER f AS tss FROM vs_v
  WINDOW w AS (PARTITION BY feature ORDER BY v), f AS (PARTITION BY feature)),
vs_g AS (SELECT *, tss / tn - (ts / tn) ** 2 AS parent, (n / tn) * (ss / n - (s / n) ** 2) + ((tn - n) / tn) * ((tss - ss) / (tn - n) - ((ts - s) / (tn - n)) ** 2) AS inner_var
  FROM vs_c WHERE thr IS NOT NULL AND n >= 10 AND tn - n >= 10),
vs_best AS (SELECT feature, thr, parent - inner_var AS gain, n, s, row_number() OVER (PARTITION BY feature ORDER BY round((parent - inner_var) / parent, 12) DESC, thr) AS r FROM vs_g)"""


add("best_numeric_split_reg", f"""WITH {LINES}, {variance_split('lines', ['l_extendedprice', 'l_discount'], 'net', '1e6', 4)}
SELECT CAST(feature AS INTEGER) AS feature, round(thr, 6) AS threshold, round(gain / 1e6, 4) AS gain, CAST(n AS BIGINT) AS left_n FROM vs_best WHERE r = 1""")

add("best_categorical_split_binary", f"""WITH {CUSTOMERS}, src AS (SELECT 0 AS node, * FROM customers), {category_splits('src', ['nation', 'c_mktsegment'])}
SELECT CAST(feature AS INTEGER) AS feature, round(gain, 8) AS gain, cats AS left_categories FROM cs_best""")

add("best_categorical_split_regression", f"""WITH {CUSTOMERS},
long AS (SELECT 0 AS feature, nation AS v, c_acctbal - (SELECT avg(c_acctbal) FROM customers) AS y FROM customers
  UNION ALL SELECT 1, c_mktsegment, c_acctbal - (SELECT avg(c_acctbal) FROM customers) FROM customers),
v AS (SELECT feature, v, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM long GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(s / n, 12), v) AS k FROM v),
c AS (SELECT feature, k, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss,
  sum(n) OVER f AS tn, sum(s) OVER f AS ts, sum(ss) OVER f AS tss FROM o WINDOW w AS (PARTITION BY feature ORDER BY k), f AS (PARTITION BY feature)),
g AS (SELECT *, tss / tn - (ts / tn) ** 2 AS parent, (n / tn) * (ss / n - (s / n) ** 2) + ((tn - n) / tn) * ((tss - ss) / (tn - n) - ((ts - s) / (tn - n)) ** 2) AS inner_var
  FROM c WHERE n >= 10 AND tn - n >= 10),
b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round((parent - inner_var) / parent, 12) DESC, k) AS r FROM g)
SELECT CAST(b.feature AS INTEGER) AS feature, round((parent - inner_var) / 1e3, 5) AS gain, string_agg(o.v, ',' ORDER BY o.v) AS left_categories
FROM b JOIN o ON o.feature = b.feature AND o.k <= b.k WHERE r = 1 GROUP BY b.feature, b.parent, b.inner_var""")

_G4 = "1.0 - " + " - ".join("(%s / (%s)) ** 2" % (f"{{0}}{c}", " + ".join(f"{{0}}{d}" for d in range(4))) for c in range(4))


def _gini4(prefix: str) -> str:
    return "(" + _G4.replace("{0}", prefix) + ")"


add("best_categorical_split_multiclass", f"""WITH long AS (
  SELECT 0 AS feature, o_orderpriority AS v, o_custkey % 4 AS y FROM orders
  UNION ALL SELECT 1, o_orderstatus, o_custkey % 4 FROM orders),
v AS (SELECT feature, v, {", ".join(f"count(*) FILTER (y = {c}) AS c{c}" for c in range(4))} FROM long GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY feature) AS k FROM v),
m AS (SELECT f.feature, f.k, x.m FROM (SELECT DISTINCT feature, k FROM o) f, range(1, 1024) x(m) WHERE x.m < (1::BIGINT << f.k) AND bit_count(x.m) <= f.k // 2),
s AS (SELECT m.feature, m.m, {", ".join(f"sum(o.c{c}) AS l{c}" for c in range(4))}, string_agg(o.v, ',' ORDER BY o.v) AS cats
  FROM m JOIN o ON o.feature = m.feature AND ((m.m >> (o.k - 1 - o.i)) & 1) = 1 GROUP BY 1, 2),
t AS (SELECT feature, {", ".join(f"sum(c{c}) AS t{c}" for c in range(4))} FROM o GROUP BY 1),
g AS (SELECT s.feature, s.m, s.cats, {", ".join(f"l{c}, t{c} - l{c} AS r{c}, t{c}" for c in range(4))} FROM s JOIN t ON s.feature = t.feature),
h AS (SELECT *, l0 + l1 + l2 + l3 AS nl, r0 + r1 + r2 + r3 AS nr FROM g),
e AS (SELECT *, {_gini4('t')} - (nl / (nl + nr)) * {_gini4('l')} - (nr / (nl + nr)) * {_gini4('r')} AS gain FROM h WHERE nl >= 10 AND nr >= 10),
b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 12) DESC, bit_count(m), m DESC) AS r FROM e WHERE round(gain, 12) > 0)
SELECT CAST(feature AS INTEGER) AS feature, round(gain, 10) AS gain, cats AS left_categories FROM b WHERE r = 1""")

BEST_OF_ALL = """(SELECT node, feature, thr, NULL AS cats, gain, l0, l1 FROM {n}_best UNION ALL SELECT node, feature, NULL, cats, gain, l0, l1 FROM {c}_best)"""

add("best_split_of_all", f"""WITH {CUSTOMERS}, src AS (SELECT 0 AS node, * FROM customers), {numeric_splits('src', ['c_acctbal'])},
{category_splits('src', ['nation', 'c_mktsegment'], first=1)},
u AS (SELECT *, row_number() OVER (ORDER BY round(gain, 12) DESC, feature) AS r FROM {BEST_OF_ALL.format(n='ns', c='cs')})
SELECT CAST(feature AS INTEGER) AS feature, round(thr, 8) AS threshold, round(gain, 8) AS gain, cats AS left_categories FROM u WHERE r = 1""")

TEST_COUNTS = f"""{LINES}, {tests('lines', LINE_NUMERIC, LINE_CATEGORICAL, 10)}, {answers('lines', LINE_NUMERIC, LINE_CATEGORICAL)},
tot AS (SELECT sum(n0) AS a, sum(n1) AS b FROM combos),
cnt AS (SELECT tests.fid, coalesce(sum(n0), 0) AS p, coalesce(sum(n1), 0) AS q FROM tests LEFT JOIN hits ON tests.fid = hits.fid LEFT JOIN combos ON hits.id = combos.id GROUP BY 1),
gains AS (SELECT fid, p, q, a, b, CASE WHEN p + q = 0 OR p + q = a + b THEN -1.0 ELSE {entropy('a', 'b')} - ((p + q) / (a + b)) * {entropy('p', 'q')}
  - ((a + b - p - q) / (a + b)) * {entropy('(a - p)', '(b - q)')} END AS gain FROM cnt, tot)"""

add("feature_entropy_gain", f"WITH {TEST_COUNTS} SELECT fid, round(gain, 8) AS gain FROM gains")
add("top_k_features", f"""WITH {TEST_COUNTS}, r AS (SELECT fid, gain, row_number() OVER (ORDER BY round(gain, 12) DESC, fid) - 1 AS r FROM gains)
SELECT CAST(r AS INTEGER) AS rank, fid, round(gain, 8) AS gain FROM r WHERE r < 8""")

add("leaf_loss", f"""WITH {LINES} SELECT l_returnflag, round(least(sum(y), count(*) - sum(y)) / (SELECT count(*) FROM lines) + 0.0001, 8) AS loss FROM lines GROUP BY 1""")

# -- learners ----------------------------------------------------------------------------


def cart_two_levels() -> str:
    """Two levels of greedy splits on customers, as CTEs, and the nodes they give."""
    both = "(SELECT * FROM {b} WHERE r = 1)"
    return f"""{CUSTOMERS}, s0 AS (SELECT 0 AS node, * FROM customers),
{numeric_splits('s0', ['c_acctbal'], 'n0')}, {category_splits('s0', ['nation', 'c_mktsegment'], 'k0', 1)},
b0 AS (SELECT *, row_number() OVER (ORDER BY round(gain, 12) DESC, feature) AS r FROM {BEST_OF_ALL.format(n='n0', c='k0')}),
s1 AS (SELECT CASE WHEN (feature = 0 AND c_acctbal <= thr) OR (feature = 1 AND list_contains(string_split(cats, ','), nation))
    OR (feature = 2 AND list_contains(string_split(cats, ','), c_mktsegment)) THEN 1 ELSE 2 END AS node, customers.*
  FROM customers, {both.format(b='b0')}),
{numeric_splits('s1', ['c_acctbal'], 'n1')}, {category_splits('s1', ['nation', 'c_mktsegment'], 'k1', 1)},
b1 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, feature) AS r FROM {BEST_OF_ALL.format(n='n1', c='k1')}),
s2 AS (SELECT s1.node, s1.y, b.feature AS f, CASE WHEN (feature = 0 AND c_acctbal <= thr) OR (feature = 1 AND list_contains(string_split(cats, ','), nation))
    OR (feature = 2 AND list_contains(string_split(cats, ','), c_mktsegment)) THEN 'L' ELSE 'R' END AS side
  FROM s1 LEFT JOIN {both.format(b='b1')} b ON s1.node = b.node)"""


add("cart_tree_nodes", f"""WITH {cart_two_levels()},
nm AS (SELECT ['c_acctbal', 'nation', 'c_mktsegment'] AS nm),
m AS (SELECT CASE node WHEN 1 THEN 'L' ELSE 'R' END || CASE WHEN f IS NULL THEN '' ELSE side END AS path, sum(y) AS p, count(*) AS n FROM s2 GROUP BY 1)
SELECT '' AS node_path, nm[feature + 1] AS feature, round(thr, 6) AS threshold, cats AS left_categories, CAST(NULL AS DOUBLE) AS prediction, (SELECT count(*) FROM customers) AS n FROM b0, nm WHERE r = 1
UNION ALL SELECT CASE b1.node WHEN 1 THEN 'L' ELSE 'R' END, nm[feature + 1], round(thr, 6), cats, NULL, (SELECT count(*) FROM s1 WHERE s1.node = b1.node) FROM b1, nm WHERE r = 1
UNION ALL SELECT path, NULL, NULL, NULL, CASE WHEN p > n - p THEN 1.0 ELSE 0.0 END, n FROM m""")

add("used_features", f"""WITH {cart_two_levels()}, nm AS (SELECT ['c_acctbal', 'nation', 'c_mktsegment'] AS nm),
u AS (SELECT 0 AS node, nm[feature + 1] AS feature FROM b0, nm WHERE r = 1 UNION ALL SELECT node, nm[feature + 1] FROM b1, nm WHERE r = 1)
SELECT row_number() OVER (ORDER BY node) - 1 AS position, feature FROM u""")

def cart_nodes(source: str, numeric: list[str], categorical: list[str], depth: int) -> str:
    """CTEs that grow a two-class tree level by level, and a query for its nodes."""
    names = numeric + categorical
    left = " OR ".join(
        [f"(feature = {i} AND {c} <= thr)" for i, c in enumerate(numeric)]
        + [f"(feature = {len(numeric) + i} AND list_contains(string_split(cats, ','), {c}))" for i, c in enumerate(categorical)])
    ctes = [f"s0 AS (SELECT '' AS node, {', '.join(names)}, y FROM {source})"]
    shown = []
    for d in range(depth):
        ctes.append(numeric_splits(f"s{d}", numeric, f"n{d}"))
        parts = f"SELECT node, feature, thr, NULL AS cats, gain FROM n{d}_best"
        if categorical:
            ctes.append(category_splits(f"s{d}", categorical, f"k{d}", len(numeric)))
            parts += f" UNION ALL SELECT node, feature, NULL, cats, gain FROM k{d}_best"
        ctes.append(f"""r{d} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, feature) AS r FROM ({parts})),
b{d} AS (SELECT node, feature, thr, cats FROM r{d} WHERE r = 1),
s{d + 1} AS (SELECT s.node || CASE WHEN {left} THEN 'L' ELSE 'R' END AS node, {', '.join('s.' + c for c in names)}, s.y FROM s{d} s JOIN b{d} b ON s.node = b.node)""")
        shown.append(f"""SELECT b.node AS node_path, {names}[feature + 1] AS feature, round(thr, 6) AS threshold, cats AS left_categories,
  CAST(NULL AS DOUBLE) AS prediction, (SELECT count(*) FROM s{d} s WHERE s.node = b.node) AS n FROM b{d} b""")
        shown.append(f"""SELECT node, NULL, NULL, NULL, CASE WHEN sum(y) > count(*) - sum(y) THEN 1.0 ELSE 0.0 END, count(*)
FROM s{d} WHERE node NOT IN (SELECT node FROM b{d}) GROUP BY node""")
    shown.append(f"""SELECT node, NULL, NULL, NULL, CASE WHEN sum(y) > count(*) - sum(y) THEN 1.0 ELSE 0.0 END, count(*) FROM s{depth} GROUP BY node""")
    return ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(shown)


add("cart_deep", f"WITH {LINES}, {cart_nodes('lines', LINE_NUMERIC, LINE_CATEGORICAL, 4)}")

add("cart_predict", f"""WITH {CUSTOMERS}, src AS (SELECT 0 AS node, * FROM customers), {numeric_splits('src', ['c_acctbal'])},
s AS (SELECT CASE WHEN avg(y) FILTER (c_acctbal <= thr) > 0.5 THEN 1 ELSE 0 END AS l, CASE WHEN avg(y) FILTER (c_acctbal > thr) > 0.5 THEN 1 ELSE 0 END AS r
  FROM customers, ns_best)
SELECT c_custkey, CAST(CASE WHEN c_acctbal <= thr THEN l ELSE r END AS INTEGER) AS prediction FROM customers, ns_best, s""")

add("cart_regression", f"""WITH {LINES}, {variance_split('lines', ['l_extendedprice', 'l_discount'], 'net', '1', 4)},
b AS (SELECT feature, thr FROM vs_best WHERE r = 1 ORDER BY gain DESC LIMIT 1),
side AS (SELECT CASE WHEN (feature = 0 AND l_extendedprice <= thr) OR (feature = 1 AND l_discount <= thr) THEN 'L' ELSE 'R' END AS side, net FROM lines, b)
SELECT '' AS node_path, CASE feature WHEN 0 THEN 'l_extendedprice' ELSE 'l_discount' END AS feature, round(thr, 6) AS threshold,
  CAST(NULL AS VARCHAR) AS left_categories, CAST(NULL AS DOUBLE) AS prediction, (SELECT count(*) FROM lines) AS n FROM b
UNION ALL SELECT side, NULL, NULL, NULL, round(avg(net), 4), count(*) FROM side GROUP BY side""")

add("greedy_tree_one_split", f"""WITH {TEST_COUNTS},
best AS (SELECT *, row_number() OVER (ORDER BY round(gain, 12) DESC, fid) AS r FROM gains),
l AS (SELECT fid, least(a, b) / (a + b) + 0.001 AS leaf, (least(p, q) + least(a - p, b - q)) / (a + b) + 0.002 AS split FROM best WHERE r = 1)
SELECT CASE WHEN split < leaf THEN fid END AS root_fid, CAST(CASE WHEN split < leaf THEN 2 ELSE 1 END AS INTEGER) AS n_leaves, round(least(split, leaf), 8) AS objective FROM l""")

XOR = """xors AS (SELECT l_quantity, l_discount, l_tax, l_linestatus, CASE WHEN (l_quantity > 25) <> (l_linestatus = 'O') THEN 1 ELSE 0 END AS y FROM lineitem)"""
_XN, _XC = ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"]

add("optimal_depth2_tree", f"""WITH {XOR}, {tests('xors', _XN, _XC, 4)}, {answers('xors', _XN, _XC)},
tot AS (SELECT sum(n0) AS a, sum(n1) AS b, sum(n0) + sum(n1) AS n FROM combos),
bits AS (SELECT combos.id, tests.fid, n0, n1, hits.id IS NOT NULL AS v FROM combos CROSS JOIN tests LEFT JOIN hits ON hits.id = combos.id AND hits.fid = tests.fid),
pairs AS (SELECT x.fid AS f, x.v AS side, z.fid AS g, sum(x.n0) FILTER (z.v) AS p, sum(x.n1) FILTER (z.v) AS q, sum(x.n0) AS a, sum(x.n1) AS b
  FROM bits x JOIN bits z ON x.id = z.id GROUP BY 1, 2, 3),
pz AS (SELECT f, side, g, coalesce(p, 0) AS p, coalesce(q, 0) AS q, a, b FROM pairs),
one AS (SELECT DISTINCT f, side, least(pz.a, pz.b) / n + 0.001 AS leaf FROM pz, tot),
two AS (SELECT f, side, g, (least(p, q) + least(pz.a - p, pz.b - q)) / n + 0.002 AS loss FROM pz, tot WHERE p + q > 0 AND p + q < pz.a + pz.b),
bt AS (SELECT f, side, g, loss, row_number() OVER (PARTITION BY f, side ORDER BY round(loss, 12), g) AS r FROM two),
sub AS (SELECT one.f, one.side, CASE WHEN round(loss, 12) < round(leaf, 12) THEN loss ELSE leaf END AS loss,
  CASE WHEN round(loss, 12) < round(leaf, 12) THEN g ELSE -1 END AS g FROM one LEFT JOIN bt ON bt.f = one.f AND bt.side = one.side AND r = 1),
roots AS (SELECT t.f, t.g AS tg, e.g AS eg, t.loss + e.loss AS loss FROM sub t JOIN sub e ON t.f = e.f AND t.side AND NOT e.side),
pick AS (SELECT *, row_number() OVER (ORDER BY round(loss, 12), f) AS r FROM roots)
SELECT CAST(f AS INTEGER) AS root_fid, CAST(tg AS INTEGER) AS true_fid, CAST(eg AS INTEGER) AS false_fid,
  CAST(2 + CASE WHEN tg >= 0 THEN 1 ELSE 0 END + CASE WHEN eg >= 0 THEN 1 ELSE 0 END AS INTEGER) AS n_leaves, round(loss, 8) AS objective
FROM pick WHERE r = 1""")

# -- scoring and inspection --------------------------------------------------------------

add("leaf_assignment", f"WITH {SCORED} SELECT c_custkey, leaf, p FROM scored")
add("leaf_label_counts", f"WITH {SCORED} SELECT leaf AS leaf_id, y AS label, count(*) AS n FROM scored GROUP BY ALL")
add("fixed_tree_objective", f"""WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (p <> y) AS errors, CAST(3 AS BIGINT) AS n_leaves,
  round(count(*) FILTER (p <> y) / count(*) + 0.03, 8) AS objective FROM scored""")

# -- quality -----------------------------------------------------------------------------

add("accuracy_vs_baseline", f"""WITH {SCORED},
n AS (SELECT y, count(*) AS n FROM scored GROUP BY 1), t AS (SELECT CAST(ceil(0.25 * sum(n)) AS BIGINT) AS t, sum(n) AS total FROM n),
f AS (SELECT y, CAST(floor(t * n / total) AS BIGINT) AS base, t, row_number() OVER (ORDER BY round(t * n / total - floor(t * n / total), 12) DESC, y) AS r FROM n, t),
q AS (SELECT y, base + CASE WHEN r <= t - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS quota FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(c_custkey || ':3'), c_custkey) AS r FROM scored),
m AS (SELECT o.*, o.r <= q.quota AS is_test FROM o JOIN q ON o.y = q.y),
b AS (SELECT y AS maj FROM m WHERE NOT is_test GROUP BY y ORDER BY count(*) DESC, y LIMIT 1)
SELECT count(*) AS n, round(avg(CASE WHEN p = y THEN 1.0 ELSE 0 END), 8) AS accuracy, round(avg(CASE WHEN y = maj THEN 1.0 ELSE 0 END), 8) AS majority_baseline
FROM m, b WHERE is_test""")

add("regression_metrics", f"""WITH {LINES}, s AS (SELECT net, l_linenumber, CASE WHEN l_extendedprice <= 50000 THEN 25000.0 ELSE 70000.0 END AS p FROM lines),
m AS (SELECT avg(net) AS m FROM s WHERE l_linenumber > 2), e AS (SELECT net, p, avg(net) OVER () AS a FROM s WHERE l_linenumber <= 2)
SELECT count(*) AS n, round(sqrt(avg((net - p) ** 2)), 4) AS rmse, round(1 - sum((net - p) ** 2) / sum((net - a) ** 2), 8) AS r2,
  round(sqrt(avg((net - m) ** 2)), 4) AS baseline_rmse FROM e, m""")

# -- fairness ----------------------------------------------------------------------------


def _quartiles(source: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS attribute, unnest(list_sort(list_distinct(quantile_cont(v, [0.0, 0.25, 0.5, 0.75, 1.0])))) AS edge FROM ({source.format(c=c)})"
        for c in ("l_quantity", "l_extendedprice"))
    return f"""WITH e AS ({parts})
SELECT attribute, row_number() OVER (PARTITION BY attribute ORDER BY edge) - 1 AS position, round(edge, 6) AS edge FROM e"""


add("sensitive_quartiles_distinct", _quartiles("SELECT DISTINCT {c} AS v FROM lineitem"))
add("sensitive_quartiles_rows", _quartiles("SELECT {c} AS v FROM lineitem"))
add("sensitive_groups", """WITH e AS (SELECT quantile_cont(v, [0.25, 0.5, 0.75]) AS e FROM (SELECT DISTINCT l_quantity AS v FROM lineitem)),
g AS (SELECT l_quantity, CASE WHEN l_quantity <= e[1] THEN 1 WHEN l_quantity <= e[2] THEN 2 WHEN l_quantity <= e[3] THEN 3 ELSE 4 END AS g FROM lineitem, e)
SELECT min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM g GROUP BY g""")

GROUPS = """SELECT r_name AS "group", count(*) AS n, avg(CASE WHEN p = y THEN 1.0 ELSE 0 END) AS accuracy, avg(p) AS positive_rate,
  avg(p) FILTER (y = 1) AS tpr FROM scored GROUP BY r_name"""

add("group_fairness_table", f"""WITH {SCORED}, g AS ({GROUPS})
SELECT "group", n, round(accuracy, 8) AS accuracy, round(positive_rate, 8) AS positive_rate, round(tpr, 8) AS tpr, n < 50 AS small_group FROM g""")

add("group_fairness_small_groups", """WITH s AS (SELECT lang, CAST(quality AS INTEGER) AS y, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id))
SELECT lang AS "group", count(*) AS n, round(avg(CASE WHEN p = y THEN 1.0 ELSE 0 END), 8) AS accuracy, round(avg(p), 8) AS positive_rate,
  round(avg(p) FILTER (y = 1), 8) AS tpr, count(*) < 50 AS small_group FROM s GROUP BY lang""")

add("parity_summary", f"""WITH {SCORED_BALANCE}, g AS ({GROUPS}), l AS (SELECT * FROM g WHERE n >= 50)
SELECT count(*) AS n_groups, round(max(positive_rate) - min(positive_rate), 8) AS sp_diff, round(min(positive_rate) / max(positive_rate), 8) AS di_ratio,
  round(max(tpr) - min(tpr), 8) AS eo_diff FROM l""")

add("fairness_gap_dp", f"WITH {SCORED}, g AS ({GROUPS}) SELECT round(max(positive_rate) - min(positive_rate), 8) AS gap FROM g")
add("fairness_gap_eo", f"WITH {SCORED_BALANCE}, g AS ({GROUPS}) SELECT round(max(tpr) - min(tpr), 8) AS gap FROM g")

QUOTAS = """tr AS (SELECT avg(p) AS target FROM scored),
gq AS (SELECT r_name, count(*) AS n, CAST(sum(p) AS BIGINT) AS n_pos, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn,
  CAST(round_even(target * count(*), 0) AS BIGINT) AS desired, target FROM scored, tr GROUP BY r_name, target),
gd AS (SELECT *, CAST(CASE WHEN n_pos / n > target THEN -1 WHEN n_pos / n < target THEN 1 ELSE 0 END AS INTEGER) AS direction FROM gq),
qq AS (SELECT *, CAST(CASE direction WHEN -1 THEN greatest(n_pos - desired, 0) WHEN 1 THEN greatest(desired - n_pos, 0) ELSE 0 END AS BIGINT) AS quota FROM gd),
quotas AS (SELECT *, quota > 0 AND CASE WHEN direction = -1 THEN fp ELSE fn END >= quota AS wrong_first FROM qq)"""

add("calibration_quotas", f"WITH {SCORED}, {QUOTAS} SELECT r_name, n, n_pos, desired, direction, quota, wrong_first FROM quotas")

add("sample_calibration", f"""WITH {SCORED}, {QUOTAS},
o AS (SELECT s.c_custkey, s.r_name, s.p, direction, quota, row_number() OVER (PARTITION BY s.r_name ORDER BY
    CASE WHEN s.p = CASE WHEN direction = -1 THEN 1 ELSE 0 END AND (s.p <> s.y OR NOT wrong_first) THEN 0 ELSE 1 END,
    md5(s.c_custkey || ':42'), s.c_custkey) AS r FROM scored s JOIN quotas USING (r_name))
SELECT c_custkey, r_name, p, CAST(CASE WHEN r <= quota THEN CASE WHEN direction = -1 THEN 0 ELSE 1 END ELSE p END AS INTEGER) AS fair_prediction FROM o""")

add("leaf_override_scores", f"""WITH {SCORED},
cand AS (SELECT leaf AS leaf_id, CAST(1 - mode(p) AS INTEGER) AS candidate FROM scored GROUP BY leaf),
trial AS (SELECT leaf_id, candidate, r_name, y, p, CASE WHEN leaf = leaf_id THEN candidate ELSE p END AS t FROM cand, scored),
acc AS (SELECT leaf_id, candidate, avg(CASE WHEN p = y THEN 1.0 ELSE 0 END) - avg(CASE WHEN t = y THEN 1.0 ELSE 0 END) AS acc_drop FROM trial GROUP BY 1, 2),
rates AS (SELECT leaf_id, candidate, r_name, avg(t) AS m, avg(p) AS m0 FROM trial GROUP BY 1, 2, 3),
gaps AS (SELECT leaf_id, candidate, max(m) - min(m) AS gap, max(m0) - min(m0) AS gap0 FROM rates GROUP BY 1, 2)
SELECT leaf_id, candidate, round(acc_drop, 8) AS acc_drop, round(gap, 8) AS gap, round(gap0 - gap, 8) AS gain FROM acc JOIN gaps USING (leaf_id, candidate)""")

# -- experiments -------------------------------------------------------------------------

RUN_METRICS = """keyed AS (SELECT ['cart', 'lookahead-greedy', 'lookahead-optimal', 'treeset'][user_id % 4 + 1] AS model, event_type AS dataset,
  ['nofair', 'fair', 'lpfr'][event_id % 3 + 1] AS mode, CAST(event_id % 5 AS INTEGER) AS seed, value FROM events),
wide AS (SELECT model, dataset, mode, seed, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0 END) AS a, max(value) AS b, avg(CASE WHEN value > 5 THEN 1.0 ELSE 0 END) AS c,
  avg(CASE WHEN value > 20 THEN 1.0 ELSE 0 END) AS d, min(value) AS e, avg(CASE WHEN value > 30 THEN 1.0 ELSE 0 END) AS f
  FROM keyed WHERE NOT (model = 'treeset' AND mode = 'fair') GROUP BY ALL),
rm AS (SELECT model, dataset, mode, seed, 'test_accuracy' AS metric, a AS value FROM wide UNION ALL SELECT model, dataset, mode, seed, 'training_time_s', b FROM wide
  UNION ALL SELECT model, dataset, mode, seed, 'majority_baseline', c FROM wide UNION ALL SELECT model, dataset, mode, seed, 'user.sp_diff', d FROM wide
  UNION ALL SELECT model, dataset, mode, seed, 'user.di_ratio', e FROM wide UNION ALL SELECT model, dataset, mode, seed, 'user.eo_diff', f FROM wide)"""

add("experiment_grid", """WITH d AS (SELECT DISTINCT source || '-' || lang AS dataset FROM documents)
SELECT dataset, mode, model, CAST(seed AS INTEGER) AS seed, CASE mode WHEN 'fair' THEN 'sample' WHEN 'lpfr' THEN 'leaf_pareto' END AS fair_post,
  CAST(CASE model WHEN 'cart' THEN 1 WHEN 'lookahead-greedy' THEN 4 WHEN 'lookahead-optimal' THEN 3 ELSE 5 END + CASE mode WHEN 'lpfr' THEN 3 ELSE 0 END AS INTEGER) AS n_params
FROM d, (VALUES ('nofair'), ('fair'), ('lpfr')) m(mode), (VALUES ('cart'), ('lookahead-greedy'), ('lookahead-optimal'), ('treeset')) k(model), (VALUES (1), (2), (3)) s(seed)""")

add("seed_summary", f"""WITH {RUN_METRICS} SELECT model, dataset, mode, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n
FROM rm GROUP BY ALL""")

add("metric_flatten", f"WITH {RUN_METRICS} SELECT model, dataset, mode, seed, metric, round(value, 8) AS value FROM rm")

add("fair_fallback_merge", f"""WITH {RUN_METRICS}, m AS (SELECT model, dataset, mode, avg(value) AS accuracy, count(*) AS n FROM rm WHERE metric = 'test_accuracy' GROUP BY ALL),
k AS (SELECT DISTINCT model, dataset FROM m WHERE mode IN ('fair', 'nofair'))
SELECT k.model, k.dataset, CASE WHEN f.model IS NOT NULL THEN 'fair' ELSE 'nofair' END AS source, round(CASE WHEN f.model IS NOT NULL THEN f.accuracy ELSE n.accuracy END, 8) AS accuracy,
  CASE WHEN f.model IS NOT NULL THEN f.n ELSE n.n END AS n
FROM k LEFT JOIN m f ON f.mode = 'fair' AND f.model = k.model AND f.dataset = k.dataset LEFT JOIN m n ON n.mode = 'nofair' AND n.model = k.model AND n.dataset = k.dataset""")

add("comparison_pivot", f"""WITH {RUN_METRICS}, m AS (SELECT model, dataset, mode, avg(value) FILTER (metric = 'test_accuracy') AS acc, avg(value) FILTER (metric = 'training_time_s') AS tt,
  avg(value) FILTER (metric = 'majority_baseline') AS bl, avg(value) FILTER (metric = 'user.sp_diff') AS sp, avg(value) FILTER (metric = 'user.di_ratio') AS di,
  avg(value) FILTER (metric = 'user.eo_diff') AS eo FROM rm GROUP BY 1, 2, 3),
pick AS (SELECT * FROM m WHERE mode = 'fair' UNION ALL SELECT * FROM m WHERE mode = 'nofair' AND NOT EXISTS (SELECT 1 FROM m f WHERE f.mode = 'fair' AND f.model = m.model AND f.dataset = m.dataset))
SELECT dataset, model, round(tt, 8) AS training_time_s, round(acc, 8) AS test_accuracy, round(bl, 8) AS majority_baseline, round(sp, 8) AS user_sp, round(di, 8) AS user_di, round(eo, 8) AS user_eo FROM pick
UNION ALL SELECT dataset, model || ' (calibrated)', round(tt, 8), round(acc / 4, 8), round(bl, 8), round(sp / 2, 8), round(di / 2, 8), round(eo / 2, 8) FROM m WHERE mode = 'fair'""")

add("run_identities", """SELECT CASE WHEN o_orderstatus = 'F' THEN 'lookahead-' || CASE WHEN o_orderkey % 3 = 0 THEN 'optimal' ELSE 'greedy' END ELSE 'cart' END AS model,
  CASE WHEN o_orderkey % 2 <> 0 THEN 'nofair' WHEN o_orderkey % 5 = 0 THEN 'lpfr' ELSE 'fair' END AS mode, count(*) AS n FROM orders GROUP BY ALL""")

add("run_outcomes", "SELECT o_orderstatus <> 'P' AS ok, count(*) AS n FROM orders GROUP BY ALL")

add("ordered_output", f"""WITH {RUN_METRICS} SELECT model, dataset, mode, round(round(avg(value), 6), 6) AS mean FROM rm
WHERE metric = 'test_accuracy' AND dataset IN ('click', 'view', 'purchase') GROUP BY ALL""")


def _num(shift: int) -> str:
    return f"((c_custkey * 7 + {shift}) % 10000) / 10000"


_FILE = """'lookahead-greedy-' || lower(c_mktsegment) || '-d5-bin-' || ['nofair', 'fair', 'lpfr'][c_custkey % 3 + 1] || '-c' || c_custkey || '.log'"""
_ALWAYS = {"training_time_s": 10, "test_accuracy": 11, "majority_baseline": 12,
           "sex.sp_diff": 20, "sex.di_ratio": 21, "sex.eo_diff": 22}
_AFTER = {"sp_diff": 30, "di_ratio": 31, "eo_diff": 32, "acc": 40}

add("log_metrics", " UNION ALL ".join(
    [f"SELECT {_FILE} AS file, '{m}' AS metric, CAST({_num(s)} AS DOUBLE) AS value FROM customer" for m, s in _ALWAYS.items()]
    + [f"SELECT {_FILE}, 'sex.' || CASE c_custkey % 3 WHEN 1 THEN 'calibrated_' ELSE 'lpfr_' END || '{m}', CAST({_num(s)} AS DOUBLE) FROM customer WHERE c_custkey % 3 <> 0"
       for m, s in _AFTER.items()]))

add("log_identity", """SELECT 'lookahead-greedy' AS model, lower(c_mktsegment) AS dataset, 5 AS depth, 'bin' AS features,
  ['nofair', 'fair', 'lpfr'][c_custkey % 3 + 1] AS mode, c_custkey % 3 <> 0 AS is_fair, ['nofair', 'fair', 'lpfr'][c_custkey % 3 + 1] AS output, count(*) AS n
FROM customer GROUP BY ALL""")

add("split_many_classes", """WITH c AS (SELECT CAST(o_custkey % 701 AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT sum(n) AS rows, ceil(0.2 * sum(n)) AS n_test FROM c),
s AS (SELECT y, n, floor(n_test * n / rows) AS least, round(n_test * n / rows - floor(n_test * n / rows), 12) AS rest, n_test FROM c, t),
r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, y) AS place, n_test - sum(least) OVER () AS spare FROM s)
SELECT y, n, CAST(least + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM r""")
add("text_target_codes", """WITH p AS (SELECT p_partkey, p_brand || '/' || p_size AS y FROM part)
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY y) - 1 AS INTEGER) AS code FROM p""")
MISSING_GROUP = f"""{SCORED}, grouped AS (SELECT p, y, r_name FROM scored WHERE c_custkey % 3 <> 0)"""
add("fairness_gap_missing_group", f"WITH {MISSING_GROUP}, g AS (SELECT avg(p) AS m FROM grouped GROUP BY r_name) SELECT round(max(m) - min(m), 8) AS gap FROM g")
add("group_fairness_missing_group", f"""WITH {MISSING_GROUP}
SELECT r_name AS "group", count(*) AS n, round(avg(CASE WHEN p = y THEN 1.0 ELSE 0 END), 8) AS accuracy, round(avg(p), 8) AS positive_rate,
  round(avg(p) FILTER (y = 1), 8) AS tpr, count(*) < 50 AS small_group FROM grouped GROUP BY r_name""")
INFINITE = """price AS (SELECT y, CASE l_linenumber WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN NULL ELSE l_extendedprice END AS v
  FROM (SELECT *, CAST(l_extendedprice * (1 - l_discount) >= 50000 AS INTEGER) AS y FROM lineitem)),
per AS (SELECT v, sum(1 - y) AS a, sum(y) AS b FROM price WHERE v IS NOT NULL GROUP BY v),
tot AS (SELECT sum(1 - y) AS ta, sum(y) AS tb, count(*) AS n FROM price),
cut AS (SELECT v, lead(v) OVER (ORDER BY v) AS w, sum(a) OVER (ORDER BY v) AS l0, sum(b) OVER (ORDER BY v) AS l1 FROM per),
gain AS (SELECT CASE WHEN w = 'inf'::DOUBLE OR v = '-inf'::DOUBLE THEN v ELSE (v + w) / 2 END AS threshold, l0, l1, n,
    (1 - (ta / n) ^ 2 - (tb / n) ^ 2)
    - (l0 + l1) / n * (1 - (l0 / (l0 + l1)) ^ 2 - (l1 / (l0 + l1)) ^ 2)
    - (n - l0 - l1) / n * (1 - ((ta - l0) / (n - l0 - l1)) ^ 2 - ((tb - l1) / (n - l0 - l1)) ^ 2) AS gain
  FROM cut, tot WHERE w IS NOT NULL AND l0 + l1 >= 10 AND n - l0 - l1 >= 10),
best AS (SELECT * FROM gain ORDER BY round(gain, 12) DESC, threshold LIMIT 1)"""
add("numeric_split_infinite", f"WITH {INFINITE} SELECT round(threshold, 8) AS threshold, round(gain, 8) AS gain, CAST(l0 AS BIGINT) AS left_0, CAST(l1 AS BIGINT) AS left_1 FROM best")
add("cart_infinite_values", f"WITH {INFINITE} SELECT round(threshold, 8) AS threshold, CAST(n AS BIGINT) AS n FROM best")
add("missing_target_dropped", "SELECT o_orderkey, o_orderstatus AS y FROM orders WHERE o_orderstatus <> 'P'")
add("numeric_columns_kept", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
add("trees_side_by_side", f"""WITH {SCORED} SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'F' WHEN c_acctbal <= 2000 THEN 'TT' ELSE 'TF' END AS leaf,
  p AS prediction_1, CASE WHEN c_acctbal <= 5000 THEN 0 ELSE 1 END AS prediction_2,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 2000 THEN 1 ELSE 0 END AS prediction_3 FROM scored""")
add("positional_recipe", """WITH r AS (SELECT TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE substr(o_orderpriority, 1, 1) END AS DOUBLE) AS priority,
  CASE WHEN o_custkey % 5 = 0 THEN 7 END AS rare, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS y FROM orders)
SELECT y, coalesce(priority, (SELECT median(priority) FROM r)) AS priority, count(*) AS n,
  (SELECT 'priority' || CASE WHEN count(rare) * 2 < count(*) THEN '' ELSE ',rare' END FROM r) AS features FROM r GROUP BY 1, 2""")
add("projected_recipe", f"WITH {CUSTOMERS} SELECT c_custkey, c_acctbal, c_mktsegment, y FROM customers")
add("prepared_fair_split", f"""WITH {CUSTOMERS},
n AS (SELECT y, count(*) AS n FROM customers GROUP BY 1), t AS (SELECT CAST(ceil(0.25 * sum(n)) AS BIGINT) AS t, sum(n) AS total FROM n),
f AS (SELECT y, CAST(floor(t * n / total) AS BIGINT) AS base, t, row_number() OVER (ORDER BY round(t * n / total - floor(t * n / total), 12) DESC, y) AS r FROM n, t),
q AS (SELECT y, base + CASE WHEN r <= t - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS quota FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(c_custkey || ':3'), c_custkey) AS r FROM customers)
SELECT c_custkey, o.r <= q.quota AS is_test, r_name AS group_r_name, 'c_acctbal,nation,c_mktsegment' AS features FROM o JOIN q ON o.y = q.y""")
add("csv_round_trip", f"WITH {CUSTOMERS} SELECT r_name, c_custkey, c_acctbal, nation, c_mktsegment, y FROM customers")
add("json_round_trip", "SELECT event_id, event_type, value, ['nofair', 'fair', 'lpfr'][event_id % 3 + 1] AS mode FROM events")
