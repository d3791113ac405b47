"""M: transportation problems built from the test tables (one problem per part type)."""

from __future__ import annotations

from quarry.operators import transport as M
from quarry.plans.catalog import query
from quarry.plans.views import transport_cost, transport_demand, transport_supply

TV = ["transport_supply", "transport_demand", "transport_cost"]
SCENARIOS = [(10.0, 0.0, 0.0), (0.0, 15.0, 0.0), (0.0, 0.0, 25.0), (20.0, 10.0, 10.0)]
COST_GRID = [(-10.0, 0.0, 0.0), (0.0, 20.0, 0.0), (0.0, 0.0, 10.0), (15.0, -5.0, 5.0)]

BAL = """
, tot AS (SELECT coalesce(s.problem, d.problem) AS problem, coalesce(s_, 0) AS s_, coalesce(d_, 0) AS d_
          FROM (SELECT problem, CAST(sum(qty) AS BIGINT) AS s_ FROM transport_supply GROUP BY problem) s
          FULL JOIN (SELECT problem, CAST(sum(qty) AS BIGINT) AS d_ FROM transport_demand GROUP BY problem) d ON s.problem = d.problem),
sb AS (SELECT problem, src, qty FROM transport_supply UNION ALL SELECT problem, '~dummy', d_ - s_ FROM tot WHERE d_ > s_),
db AS (SELECT problem, dst, qty FROM transport_demand UNION ALL SELECT problem, '~dummy', s_ - d_ FROM tot WHERE s_ > d_),
cb AS (SELECT problem, src, dst, unit_cost FROM transport_cost
       UNION ALL SELECT t.problem, '~dummy', d.dst, CAST(0 AS BIGINT) FROM tot t JOIN transport_demand d ON t.problem = d.problem WHERE d_ > s_
       UNION ALL SELECT t.problem, s.src, '~dummy', CAST(0 AS BIGINT) FROM tot t JOIN transport_supply s ON t.problem = s.problem WHERE s_ > d_),
si AS (SELECT problem, src, sum(qty) OVER (PARTITION BY problem ORDER BY src = '~dummy', src ROWS UNBOUNDED PRECEDING) AS s_hi, qty FROM sb),
di AS (SELECT problem, dst, sum(qty) OVER (PARTITION BY problem ORDER BY dst = '~dummy', dst ROWS UNBOUNDED PRECEDING) AS d_hi, qty FROM db),
nw AS (SELECT si.problem, src, dst, CAST(least(s_hi, d_hi) - greatest(s_hi - si.qty, d_hi - di.qty) AS BIGINT) AS qty
       FROM si JOIN di ON si.problem = di.problem AND s_hi - si.qty < d_hi AND d_hi - di.qty < s_hi
       WHERE least(s_hi, d_hi) - greatest(s_hi - si.qty, d_hi - di.qty) > 0),
nwc AS (SELECT nw.problem, CAST(sum(qty * unit_cost) AS BIGINT) AS total_cost FROM nw JOIN cb USING (problem, src, dst) GROUP BY nw.problem)
"""


# The least-cost method as a recursive query: priced cells in order, remaining quantities carried along as lists.
LEAST = BAL + """,
rows_ AS (SELECT problem, src, row_number() OVER (PARTITION BY problem ORDER BY src = '~dummy', src) AS i, CAST(qty AS DOUBLE) AS qty FROM sb),
cols_ AS (SELECT problem, dst, row_number() OVER (PARTITION BY problem ORDER BY dst = '~dummy', dst) AS j, CAST(qty AS DOUBLE) AS qty FROM db),
cells AS (SELECT r.problem, i, j, r.src, c.dst, row_number() OVER (PARTITION BY r.problem ORDER BY unit_cost, i, j) AS k
          FROM rows_ r JOIN cols_ c ON r.problem = c.problem JOIN cb ON cb.problem = r.problem AND cb.src = r.src AND cb.dst = c.dst),
walk(problem, k, s, d, i, j, q) AS (
  SELECT problem, CAST(0 AS BIGINT), (SELECT list(qty ORDER BY i) FROM rows_ r WHERE r.problem = p.problem),
         (SELECT list(qty ORDER BY j) FROM cols_ c WHERE c.problem = p.problem), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE)
  FROM (SELECT DISTINCT problem FROM cells) p
  UNION ALL
  SELECT w.problem, c.k, list_transform(w.s, lambda x, n: CASE WHEN n = c.i THEN x - least(w.s[c.i], w.d[c.j]) ELSE x END),
         list_transform(w.d, lambda x, n: CASE WHEN n = c.j THEN x - least(w.s[c.i], w.d[c.j]) ELSE x END),
         c.i, c.j, least(w.s[c.i], w.d[c.j])
  FROM walk w JOIN cells c ON c.problem = w.problem AND c.k = w.k + 1)
"""

# Vogel's method as a recursive query: each problem is one row with its cost matrix, open lines and remaining quantities
# as lists.  A step computes the loss of every open line from its two cheapest open cells and serves the line that loses most.
VOGEL = LEAST + """,
grid AS (SELECT r.problem, r.i, list(cb.unit_cost::DOUBLE ORDER BY c.j) AS line
         FROM rows_ r JOIN cols_ c ON r.problem = c.problem
         LEFT JOIN cb ON cb.problem = r.problem AND cb.src = r.src AND cb.dst = c.dst GROUP BY r.problem, r.i),
matrix AS (SELECT problem, list(line ORDER BY i) AS m, count(*) AS n_rows, max(len(line)) AS n_cols FROM grid GROUP BY problem),
vogel(problem, k, s, d, ro, co, i, j, q) AS (
  SELECT problem, 0::BIGINT, (SELECT list(qty ORDER BY i) FROM rows_ r WHERE r.problem = matrix.problem),
         (SELECT list(qty ORDER BY j) FROM cols_ c WHERE c.problem = matrix.problem),
         list_transform(range(n_rows), lambda x: true), list_transform(range(n_cols), lambda x: true),
         0::BIGINT, 0::BIGINT, 0::DOUBLE
  FROM matrix
  UNION ALL
  SELECT problem, k + 1, list_transform(s, lambda x, n: CASE WHEN n = i_ THEN x - q_ ELSE x END),
         list_transform(d, lambda x, n: CASE WHEN n = j_ THEN x - q_ ELSE x END),
         list_transform(ro, lambda x, n: x AND NOT (n = i_ AND s[i_] - q_ <= 0)),
         list_transform(co, lambda x, n: x AND NOT (n = j_ AND d[j_] - q_ <= 0)), i_, j_, q_
  FROM (SELECT *, least(s[i_], d[j_]) AS q_ FROM (
    SELECT *, CASE WHEN by_row THEN row_at ELSE list_position(list_transform(open_cols[col_at], lambda x: coalesce(x, 'inf'::DOUBLE)), list_min(open_cols[col_at])) END AS i_,
           CASE WHEN by_row THEN list_position(list_transform(open_rows[row_at], lambda x: coalesce(x, 'inf'::DOUBLE)), list_min(open_rows[row_at])) ELSE col_at END AS j_
    FROM (
      SELECT *, list_max(row_gap) >= list_max(col_gap) AS by_row,
             list_position(row_gap, list_max(row_gap)) AS row_at, list_position(col_gap, list_max(col_gap)) AS col_at
      FROM (
        SELECT *, list_transform(list_transform(open_rows, lambda l: list_sort(list_filter(l, lambda x: x IS NOT NULL))),
                    lambda l: CASE len(l) WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE l[2] - l[1] END) AS row_gap,
               list_transform(list_transform(open_cols, lambda l: list_sort(list_filter(l, lambda x: x IS NOT NULL))),
                    lambda l: CASE len(l) WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE l[2] - l[1] END) AS col_gap
        FROM (
          SELECT v.problem, k, s, d, ro, co,
                 list_transform(m, lambda l, a: list_transform(l, lambda x, b: CASE WHEN ro[a] AND co[b] THEN x END)) AS open_rows,
                 list_transform(range(1, n_cols + 1), lambda b: list_transform(m, lambda l, a: CASE WHEN ro[a] AND co[b] THEN l[b] END)) AS open_cols
          FROM vogel v JOIN matrix ON matrix.problem = v.problem)) WHERE list_max(row_gap) >= 0))))
"""

COMPARE = VOGEL + """,
plans AS (
  SELECT 'least_cost' AS method, 0 AS rank_, w.problem, i, j, q FROM walk w WHERE q > 0
  UNION ALL SELECT 'vogel', 1, problem, i, j, q FROM vogel WHERE q > 0),
costs AS (
  SELECT p.problem, sum(q * unit_cost)::DOUBLE AS total_cost, method, rank_
  FROM plans p JOIN rows_ r ON r.problem = p.problem AND r.i = p.i JOIN cols_ c ON c.problem = p.problem AND c.j = p.j
  JOIN cb ON cb.problem = p.problem AND cb.src = r.src AND cb.dst = c.dst GROUP BY p.problem, method, rank_
  UNION ALL SELECT problem, total_cost::DOUBLE, 'northwest', 2 FROM nwc),
best AS (SELECT problem, arg_min(method, struct_pack(c := total_cost, r := rank_)) AS best_method, min(total_cost) AS best_cost FROM costs GROUP BY problem)
"""

# Scenarios are problems of their own, named by (problem, scenario): the same balancing and walk, over quantities that are no whole numbers.
SCENARIO = COMPARE + """,
scenario_costs AS (
  WITH RECURSIVE g(scenario, cap, dem, route) AS (VALUES """ + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in enumerate(SCENARIOS)) + """),
  src_at AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY src = '~dummy', src) AS place FROM transport_supply),
  dst_at AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY dst = '~dummy', dst) AS place FROM transport_demand),
  scenario_supply AS (SELECT struct_pack(p := problem, s := scenario) AS problem, src, qty * CASE WHEN place = 1 THEN 1 - cap / 100.0 ELSE 1.0 END AS qty FROM src_at, g),
  scenario_demand AS (SELECT struct_pack(p := problem, s := scenario) AS problem, dst, qty * (1 + dem / 100.0) AS qty FROM dst_at, g),
  scenario_cost AS (
    SELECT struct_pack(p := c.problem, s := scenario) AS problem, c.src, c.dst,
           unit_cost * CASE WHEN s.place IS NOT NULL AND d.place IS NOT NULL THEN 1 + route / 100.0 ELSE 1.0 END AS unit_cost
    FROM transport_cost c LEFT JOIN src_at s ON s.problem = c.problem AND s.src = c.src AND s.place = 1
    LEFT JOIN dst_at d ON d.problem = c.problem AND d.dst = c.dst AND d.place = 2, g)
""" + LEAST.replace("transport_", "scenario_").replace("BIGINT", "DOUBLE") + """
  SELECT w.problem.p AS problem, w.problem.s AS scenario, sum(w.q * cb.unit_cost) AS scenario_cost
  FROM walk w JOIN cells c ON c.problem = w.problem AND c.k = w.k JOIN cb ON cb.problem = w.problem AND cb.src = c.src AND cb.dst = c.dst
  GROUP BY 1, 2)
"""


def _tables(spark, sf):
    """The three aggregated tables, materialised once: each is read by several steps."""
    return tuple(M.materialize(transport_supply(spark, sf), transport_demand(spark, sf), transport_cost(spark, sf)))


def _balanced(spark, sf):
    return M.balance(*_tables(spark, sf))


@query("transport_balance", BAL + """
SELECT problem, 'supply' AS side, src AS node, qty FROM sb UNION ALL SELECT problem, 'demand', dst, qty FROM db""", TV)
def q_transport_balance(spark, sf):
    from pyspark.sql import functions as F
    s, d, _ = _balanced(spark, sf)
    return s.select("problem", F.lit("supply").alias("side"), F.col("src").alias("node"), "qty").unionByName(
        d.select("problem", F.lit("demand").alias("side"), F.col("dst").alias("node"), "qty"))


@query("transport_northwest", BAL + "SELECT * FROM nw", TV)
def q_transport_northwest(spark, sf):
    s, d, _ = _balanced(spark, sf)
    return M.northwest_corner(s, d)


@query("transport_cost", BAL + "SELECT * FROM nwc", TV)
def q_transport_cost(spark, sf):
    s, d, c = _balanced(spark, sf)
    return M.allocation_cost(M.northwest_corner(s, d), c)


@query("route_costs", BAL + """,
rc AS (SELECT nw.problem, src, dst, qty, qty * unit_cost AS route_cost FROM nw JOIN cb USING (problem, src, dst) WHERE qty > 0),
top AS (SELECT problem, src AS busiest_src, dst AS busiest_dst, qty AS busiest_qty,
               row_number() OVER (PARTITION BY problem ORDER BY qty DESC, src, dst) AS r FROM rc)
SELECT a.problem, active_routes, total_cost, busiest_src, busiest_dst, busiest_qty
FROM (SELECT problem, count(*) AS active_routes, CAST(sum(route_cost) AS BIGINT) AS total_cost FROM rc GROUP BY problem) a
JOIN top ON top.problem = a.problem AND r = 1""", TV)
def q_route_costs(spark, sf):
    s, d, c = _balanced(spark, sf)
    return M.route_costs(M.northwest_corner(s, d), c)


@query("cost_scenarios", BAL + """
SELECT problem, total_cost, demand_change, fuel_change, capacity_change,
       total_cost * (1 + demand_change / 100.0) * (1 + fuel_change / 100.0) * (1 - capacity_change / 100.0) AS scenario_cost,
       total_cost * (1 + demand_change / 100.0) * (1 + fuel_change / 100.0) * (1 - capacity_change / 100.0) - total_cost AS delta,
       greatest(0.0, total_cost - total_cost * (1 + demand_change / 100.0) * (1 + fuel_change / 100.0) * (1 - capacity_change / 100.0)) AS savings
FROM nwc, (VALUES """ + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in COST_GRID) + """) g(demand_change, fuel_change, capacity_change)""", TV)
def q_cost_scenarios(spark, sf):
    s, d, c = _balanced(spark, sf)
    return M.cost_scenarios(M.allocation_cost(M.northwest_corner(s, d), c), COST_GRID)


@query("transport_least_cost", LEAST + """
SELECT w.problem, c.src, c.dst, w.q AS qty FROM walk w JOIN cells c ON c.problem = w.problem AND c.k = w.k WHERE w.q > 0""", TV)
def q_transport_least_cost(spark, sf):
    return M.greedy_allocation(*_balanced(spark, sf), "least_cost")


@query("transport_vogel", VOGEL + """
SELECT v.problem, r.src, c.dst, v.q AS qty FROM vogel v
JOIN rows_ r ON r.problem = v.problem AND r.i = v.i JOIN cols_ c ON c.problem = v.problem AND c.j = v.j WHERE v.q > 0""", TV)
def q_transport_vogel(spark, sf):
    return M.greedy_allocation(*_balanced(spark, sf), "vogel")


@query("transport_compare", COMPARE + """
SELECT problem, total_cost, method, best_method, best_cost FROM costs JOIN best USING (problem)""", TV)
def q_transport_compare(spark, sf):
    return M.compare_methods(transport_supply(spark, sf), transport_demand(spark, sf), transport_cost(spark, sf))


@query("transport_scenarios", SCENARIO + """
SELECT problem, scenario, scenario_cost, best_cost, scenario_cost - best_cost AS delta,
       CASE WHEN best_cost <> 0 THEN (scenario_cost - best_cost) / best_cost * 100.0 END AS change_pct
FROM scenario_costs JOIN best USING (problem)""", TV)
def q_transport_scenarios(spark, sf):
    return M.scenarios(transport_supply(spark, sf), transport_demand(spark, sf), transport_cost(spark, sf), SCENARIOS)
