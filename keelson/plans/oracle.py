"""The same queries in SQL, written on their own, over one chain of common table expressions."""

from __future__ import annotations

import re

from keelson.operators.robust import weight_vectors
from keelson.plans.queries import RAW_COLUMNS
from keelson.registry import CUSTOMERS, WEIGHT_PRESETS
from keelson.schema import AGGREGATIONS


def _values(rows) -> str:
    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        return f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_REG = _values(
    (n, i.variable_name, i.display_name, i.role, i.polarity, i.aggregation, AGGREGATIONS[i.aggregation], i.year_start, i.year_end, i.log_transform, i.denominator, i.source, i.database)
    for n, i in enumerate(CUSTOMERS.indicators)
)
_PIL = _values((i.variable_name, p, n) for i in CUSTOMERS.indicators for n, p in enumerate(i.pillars))

BASE = f"""
WITH RECURSIVE reg(ord, variable_name, display_name, role, polarity, aggregation, k, y0, y1, log_t, denominator, source, database) AS (VALUES {_REG}),
pil(variable_name, pillar, pos) AS (VALUES {_PIL}),
o AS (SELECT o_custkey AS e, year(o_orderdate)::INT AS y, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS order_value, count(*)::DOUBLE AS order_count,
        (sum(o_totalprice::DECIMAL(18, 2)) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE / nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) AS urgent_value,
        (sum(o_totalprice::DECIMAL(18, 2)) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'))::DOUBLE AS urgent_pending,
        (sum(o_totalprice::DECIMAL(18, 2)) FILTER (o_orderstatus = 'F'))::DOUBLE AS final_value,
        avg(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0 END) AS low_prio_share FROM orders GROUP BY 1, 2),
l AS (SELECT o_custkey AS e, year(o_orderdate)::INT AS y, sum(l_discount::DECIMAL(18, 2))::DOUBLE / count(l_discount) AS discount_rate, (sum(l_quantity::DECIMAL(18, 2)) FILTER (l_returnflag = 'R'))::DOUBLE AS returned_qty,
        sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS item_volume, sum(l_tax::DECIMAL(18, 2))::DOUBLE / count(l_tax) AS tax_rate, sum(l_quantity::DECIMAL(18, 2))::DOUBLE / count(l_quantity) AS mean_qty,
        avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS open_share, count(DISTINCT l_suppkey)::DOUBLE AS supplier_span
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
m AS ({" UNION ALL ".join(f"SELECT e, y, '{s}' AS variable_name, {s} AS value FROM {t} WHERE {s} IS NOT NULL" for t, ss in (("o", ("order_value", "order_count", "urgent_value", "urgent_pending", "final_value", "low_prio_share")), ("l", ("discount_rate", "returned_qty", "item_volume", "tax_rate", "mean_qty", "open_share", "supplier_span"))) for s in ss)}),
obs AS (SELECT c_custkey AS entity, c_nationkey AS grp, variable_name, y AS year, value FROM m JOIN customer ON c_custkey = e),
ent AS (SELECT c_custkey AS entity, c_nationkey AS grp FROM customer),
w AS (SELECT entity, variable_name, year, value, k, CASE WHEN year >= y0 THEN 'w' ELSE 'l' END AS tag
      FROM obs JOIN reg USING (variable_name) WHERE year BETWEEN y0 - 5 AND y1),
rn AS (SELECT *, row_number() OVER (PARTITION BY entity, variable_name, tag ORDER BY year DESC) AS n FROM w),
tag AS (SELECT entity, variable_name, tag, avg(value) AS v, max(year) AS y FROM rn WHERE n <= k GROUP BY ALL),
agg AS (SELECT entity, variable_name, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NULL THEN b.y END AS fill_year
        FROM (SELECT * FROM tag WHERE tag = 'w') a FULL JOIN (SELECT * FROM tag WHERE tag = 'l') b USING (entity, variable_name)),
der AS (SELECT a.entity, a.variable_name, CASE WHEN denominator IS NULL THEN a.value WHEN d.value > 0 THEN a.value / d.value * 1000 END AS value,
               a.fill_year, a.value AS fill_value
        FROM agg a JOIN reg USING (variable_name) LEFT JOIN agg d ON d.entity = a.entity AND d.variable_name = denominator),
grid AS (SELECT entity, grp, variable_name, role, value, fill_year, fill_value FROM ent CROSS JOIN reg LEFT JOIN der USING (entity, variable_name)),
fil AS (SELECT *, value IS NULL AND m IS NOT NULL AS regional, coalesce(value, m) AS filled
        FROM (SELECT *, CASE WHEN count(value) OVER g < 3 THEN NULL WHEN max(abs(value)) OVER g >= 1000 THEN (sum(value::DECIMAL(28, 6)) OVER g)::DOUBLE / count(value) OVER g
                     WHEN max(abs(value)) OVER g >= 1 THEN (sum(value::DECIMAL(28, 9)) OVER g)::DOUBLE / count(value) OVER g ELSE avg(value) OVER g END AS m FROM grid WINDOW g AS (PARTITION BY variable_name, grp))),
log AS (SELECT variable_name, entity, 'stage1_extended' AS fill_stage, fill_year, fill_value FROM fil WHERE fill_year IS NOT NULL
        UNION ALL SELECT variable_name, entity, 'stage2_regional', NULL, filled FROM fil WHERE regional),
q AS (SELECT variable_name, quantile_cont(filled, 0.25) AS q1, quantile_cont(filled, 0.75) AS q3 FROM fil WHERE role = 'scoring' GROUP BY 1),
fen AS (SELECT *, q3 - q1 AS iqr, q1 - 2.0::DOUBLE * (q3 - q1) AS lower_bound, q3 + 2.0::DOUBLE * (q3 - q1) AS upper_bound FROM q),
cel AS (SELECT entity, grp, variable_name, role, fill_year, regional, filled AS raw,
               CASE WHEN filled < lower_bound THEN -1 WHEN filled > upper_bound THEN 1 ELSE 0 END AS capped,
               CASE WHEN filled IS NULL OR lower_bound IS NULL THEN filled ELSE least(greatest(filled, lower_bound), upper_bound) END AS value
        FROM fil LEFT JOIN fen USING (variable_name)),
tr AS (SELECT entity, grp, variable_name, polarity, log_t, CASE WHEN NOT log_t THEN value WHEN value IS NOT NULL THEN ln(1 + greatest(value, 0)) END AS x
       FROM cel JOIN reg USING (variable_name) WHERE reg.role = 'scoring'),
bnd AS (SELECT variable_name, polarity, log_t, min(x) AS lo, max(x) AS hi, count(x) AS n_valid, count(*) AS n_total FROM tr GROUP BY ALL),
norm AS (SELECT entity, grp, variable_name, CASE WHEN x IS NULL THEN NULL WHEN hi = lo THEN 50 WHEN tr.polarity = 'negative' THEN round(100 - (x - lo) / (hi - lo) * 100, 4)
                ELSE round((x - lo) / (hi - lo) * 100, 4) END::DOUBLE AS s FROM tr JOIN bnd USING (variable_name)),
spil AS (SELECT variable_name, pillar FROM pil JOIN reg USING (variable_name) WHERE role = 'scoring'),
ps AS (SELECT entity, grp, pillar, avg(s) AS score FROM norm JOIN spil USING (variable_name) GROUP BY ALL),
eq AS (SELECT entity, avg(score) AS score FROM ps GROUP BY 1),
geo AS (SELECT entity, exp(avg(ln(greatest(score, 1e-8)))) AS score FROM ps WHERE score IS NOT NULL GROUP BY 1),
ent0 AS (SELECT pillar, entity, score, coalesce(score, avg(score) OVER p) AS x0, min(score) OVER p AS lo, count(*) OVER p AS n FROM ps WINDOW p AS (PARTITION BY pillar)),
ent1 AS (SELECT *, CASE WHEN lo <= 0 THEN x0 - lo + 1e-8 ELSE x0 END AS x FROM ent0),
ent2 AS (SELECT pillar, n, greatest(x / sum(x) OVER (PARTITION BY pillar), 1e-8) AS p FROM ent1),
ent3 AS (SELECT pillar, 1 + sum(p * ln(p)) / ln(max(n)) AS d FROM ent2 GROUP BY 1),
ew AS (SELECT pillar, CASE WHEN sum(d) OVER () < 1e-8 THEN 1 / count(*) OVER () ELSE d / sum(d) OVER () END AS w FROM ent3),
enp AS (SELECT entity, sum(w * score) / sum(w) AS score FROM ps JOIN ew USING (pillar) WHERE score IS NOT NULL GROUP BY 1),
b0 AS (SELECT entity, score, row_number() OVER (PARTITION BY entity ORDER BY score DESC) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM ps WHERE score IS NOT NULL),
bod AS (SELECT entity, CASE WHEN max(n) * 0.25 < 1 - 1e-9 THEN avg(score) ELSE sum(score * (0.05 + greatest(0, least(0.20::DOUBLE, 1 - n * 0.05::DOUBLE - i * 0.20::DOUBLE)))) END AS score
        FROM b0 GROUP BY 1),
t0 AS (SELECT entity, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY entity ORDER BY coalesce(score, 0) DESC) - 1 AS i FROM ps),
tight AS (SELECT entity, sum(score * (0.07 + greatest(0, least(0.13::DOUBLE, 1 - 7 * 0.07::DOUBLE - i * 0.13::DOUBLE)))) AS score FROM t0 GROUP BY 1),
pfull AS (SELECT entity, {", ".join(f"max(score) FILTER (pillar = '{p}') AS {p}" for p in "ABCDEFG")} FROM ps GROUP BY 1 HAVING count(score) = 7),
pm AS (SELECT [{", ".join("[" + ", ".join("1.0::DOUBLE" if a == b else f"corr({a}, {b})" for b in "ABCDEFG") + "]" for a in "ABCDEFG")}] AS m FROM pfull),
psq AS (SELECT 0 AS k, m FROM pm UNION ALL
        SELECT k + 1, list_transform(sq, lambda r: list_transform(r, lambda x: x / list_max(list_transform(sq, lambda q: list_max(list_transform(q, lambda z: abs(z)))))))
        FROM (SELECT k, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS sq FROM psq WHERE k < 24)),
pv AS (SELECT list_transform(m, lambda r: r[j]) AS v FROM (SELECT m, list_position(d, list_max(d)) AS j FROM (SELECT m, list_transform(range(1, 8), lambda i: m[i][i]) AS d FROM psq WHERE k = 24))),
pl AS (SELECT list_transform(v, lambda x: greatest(CASE WHEN neg > 3 THEN -x ELSE x END, 0)) AS l FROM (SELECT v, len(list_filter(v, lambda x: x < 0)) AS neg FROM pv)),
pw AS (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G']) AS pillar, unnest(list_transform(l, lambda x: x / list_sum(l))) AS w FROM pl),
praw AS (SELECT entity, sum(w * score) / sum(w) AS score FROM ps JOIN pw USING (pillar) WHERE score IS NOT NULL GROUP BY 1),
pca AS (SELECT entity, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-8 THEN 50 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) * 100 END AS score FROM praw),
sc AS (SELECT eq.entity, round(eq.score, 8) AS equal, round(pca.score, 6) AS pca, round(bod.score, 8) AS bod, round(enp.score, 6)::DOUBLE AS entropy, round(geo.score, 8) AS geometric
       FROM eq LEFT JOIN pca USING (entity) LEFT JOIN bod USING (entity) LEFT JOIN enp USING (entity) LEFT JOIN geo USING (entity)),
rk AS (SELECT *, {", ".join(f"rank() OVER (ORDER BY {m} DESC NULLS LAST)::INT AS {m}_rank" for m in ("equal", "pca", "bod", "entropy", "geometric"))} FROM sc),
qual AS (SELECT entity, coalesce(list_sort(list(DISTINCT variable_name) FILTER (variable_name IS NOT NULL)), []) AS filled, count(DISTINCT variable_name)::INT AS n_filled
         FROM ent LEFT JOIN log USING (entity) GROUP BY 1),
qf AS (SELECT *, n_filled / 13.0::DOUBLE AS pct_filled FROM qual),
qd AS (SELECT *, CASE WHEN n_filled = 0 THEN 'Excellent' WHEN pct_filled < 0.15 THEN 'Good' WHEN pct_filled < 0.30 THEN 'Moderate' ELSE 'Caution' END AS flag FROM qf),
later AS (SELECT entity, grp, variable_name, year, CASE WHEN entity % 7 = 0 THEN value + 1 ELSE value END AS value FROM obs WHERE year <> 1995
          UNION ALL SELECT entity, grp, variable_name, 2002, value FROM obs WHERE year = 2001 AND entity % 11 = 0),
cmp AS (SELECT entity, variable_name, year, a.value AS left_value, b.value AS right_value, abs(a.value - b.value) AS diff,
               CASE WHEN b.value IS NULL THEN 'left_only' WHEN a.value IS NULL THEN 'right_only' WHEN abs(a.value - b.value) > 1e-9 THEN 'changed' ELSE 'both' END AS status
        FROM obs a FULL JOIN later b USING (entity, variable_name, year)),
good AS (SELECT entity, variable_name, value, rank() OVER (PARTITION BY variable_name ORDER BY CASE WHEN polarity = 'negative' THEN -round(value, 9) ELSE round(value, 9) END DESC)::INT AS goodness_rank,
                count(*) OVER (PARTITION BY variable_name) AS n_ranked FROM cel JOIN reg USING (variable_name) WHERE value IS NOT NULL),
pp AS (SELECT p.pillar, a.variable_name AS a, b.variable_name AS b, a.s AS x, b.s AS y FROM norm a JOIN spil p ON p.variable_name = a.variable_name
       JOIN norm b ON a.entity = b.entity AND a.variable_name < b.variable_name JOIN spil r ON r.variable_name = b.variable_name AND r.pillar = p.pillar
       WHERE a.s IS NOT NULL AND b.s IS NOT NULL),
pr AS (SELECT pillar, a, b, rank() OVER (PARTITION BY pillar, a, b ORDER BY x DESC) + (count(*) OVER (PARTITION BY pillar, a, b, x) - 1) / 2.0::DOUBLE AS rx,
              rank() OVER (PARTITION BY pillar, a, b ORDER BY y DESC) + (count(*) OVER (PARTITION BY pillar, a, b, y) - 1) / 2.0::DOUBLE AS ry FROM pp),
sp AS (SELECT pillar, a, b, count(*) AS n, corr(rx, ry) AS rho FROM pr GROUP BY ALL)
"""


def _spearman(source: str, name: str, value: str) -> str:
    """SQL for (a, b, n, rho) of a long table with average ties."""
    return f"""zz AS (SELECT a.{name} AS a, b.{name} AS b, a.{value}::DOUBLE AS x, b.{value}::DOUBLE AS y FROM {source} a JOIN {source} b ON a.entity = b.entity AND a.{name} < b.{name}
       WHERE a.{value} IS NOT NULL AND b.{value} IS NOT NULL),
zr AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x DESC) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx,
              rank() OVER (PARTITION BY a, b ORDER BY y DESC) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM zz),
zs AS (SELECT a, b, count(*) AS n, corr(rx, ry) AS rho FROM zr GROUP BY ALL)"""


_VECTORS = _values((i, *v) for i, v in enumerate(weight_vectors()))
_MAX_TABLES = f"""vec(weight_id, A, B, C, D, E, F, G) AS (VALUES {_VECTORS}),
vl AS (UNPIVOT vec ON A, B, C, D, E, F, G INTO NAME pillar VALUE w),
gb AS (SELECT entity, round(avg(score), 9) AS e FROM ps GROUP BY 1),
gs AS (SELECT weight_id, entity, round(sum(w * score) / sum(w), 9) AS s FROM ps JOIN vl USING (pillar) WHERE score IS NOT NULL GROUP BY ALL),
gr AS (SELECT weight_id, rank() OVER (PARTITION BY weight_id ORDER BY s DESC) + (count(*) OVER (PARTITION BY weight_id, s) - 1) / 2.0::DOUBLE AS r,
              rank() OVER (PARTITION BY weight_id ORDER BY e DESC) + (count(*) OVER (PARTITION BY weight_id, e) - 1) / 2.0::DOUBLE AS br FROM gs JOIN gb USING (entity)),
mx AS (SELECT weight_id, corr(r, br) AS rho, avg(abs(r - br)) AS mean_shift, max(abs(r - br))::DOUBLE AS max_shift FROM gr GROUP BY 1)
"""
_MAXS = f"{BASE}, {_MAX_TABLES}"
_LIGHT = "CASE WHEN {0} >= 65 THEN 'Stable' WHEN {0} >= 35 THEN 'Moderate' WHEN {0} IS NOT NULL THEN 'Fragile' END"
_PRESET = ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in WEIGHT_PRESETS["security_focus"].items())
_CUSTOM = ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in {"A": 0.4, "B": 0.1, "C": 0.0, "D": 0.2, "E": 1 / 7, "F": 1 / 7, "G": 1 / 7}.items())


def _weighted(weights: str, value: str = "score") -> str:
    w = f"map_extract_value(MAP {{{weights}}}, pillar)"
    return f"SELECT entity, round(sum({w} * {value}) / sum({w}), 6) AS score FROM ps WHERE score IS NOT NULL GROUP BY 1"


def _of(kind: str) -> str:
    return f"SELECT entity, variable_name, round(agg.value, 6) AS value, coalesce(fill_year, 0) AS fill_year FROM agg JOIN reg USING (variable_name) WHERE aggregation = '{kind}'"


def r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


_METHODS = ("equal", "pca", "bod", "entropy", "geometric")
_ONE = "round(round({}, 9)::DECIMAL(18, 9), 1)::DOUBLE"
_LOW = "CASE WHEN equal IS NOT NULL THEN round(round(least(greatest(equal - (2 + 26.7::DOUBLE * pct_filled), 0), 100), 9)::DECIMAL(18, 9), 1)::DOUBLE END"
_HIGH = "CASE WHEN equal IS NOT NULL THEN round(round(least(greatest(equal + (2 + 26.7::DOUBLE * pct_filled), 0), 100), 9)::DECIMAL(18, 9), 1)::DOUBLE END"


def _shown(x: str) -> str:
    return f"round(round({x}, 9)::DECIMAL(18, 9), 2)::DOUBLE"


def _tiered(x: str) -> str:
    """printf writes the exact binary value, halves to the even digit; thousands get commas."""
    grouped = lambda f: f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || format('{{:,}}', split_part(printf('{f}', abs({x})), '.', 1)::BIGINT)"
    return f"""CASE WHEN {x} IS NULL THEN NULL WHEN abs({x}) >= 10000 THEN {grouped('%.0f')} WHEN abs({x}) >= 100 THEN {grouped('%.1f')} || '.' || split_part(printf('%.1f', abs({x})), '.', 2)
        WHEN abs({x}) >= 1 THEN printf('%.2f', {x}) WHEN abs({x}) >= 0.001 THEN printf('%.4f', {x}) WHEN abs({x}) > 0 THEN printf('%.4g', {x}) ELSE '0' END"""


def _audit_sql(parts: list[tuple]) -> str:
    """(section, n, n_missing, n_off, max_diff, status) of queries of (a, b) and, if a line is cut, gone."""
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS section, count(*) AS n, count(*) FILTER ({'gone OR ' if 'AS gone' in sql else ''}(a IS NULL) <> (b IS NULL)) AS n_missing,
        count(*) FILTER (abs(a - b) > {tol!r}::DOUBLE {'AND NOT gone' if 'AS gone' in sql else ''}) AS n_off, coalesce(max(abs(a - b)) {'FILTER (NOT gone)' if 'AS gone' in sql else ''}, 0)::DOUBLE AS d, {tol!r}::DOUBLE AS tol FROM ({sql})"""
        for name, sql, tol in parts
    )
    return f"SELECT section, n, n_missing, n_off, round(d, 6)::DOUBLE AS max_diff, CASE WHEN n_missing > 0 THEN 'FAIL' WHEN round(d, 6) <= tol THEN 'PASS' WHEN round(d, 6) <= 10 * tol THEN 'WARN' ELSE 'FAIL' END AS status FROM ({rows})"


def _documents_sql(damaged: bool) -> list[tuple]:
    gone = f"{'entity % 83 = 0' if damaged else 'FALSE'} AS gone"
    off = lambda n, d: f"CASE WHEN entity % {n} = 0 THEN {d} ELSE 0 END" if damaged else "0"
    other = {"equal": "eq.score", "geometric": "geo.score", "bod": "bod.score", "pca": "sc.pca", "entropy": "sc.entropy"}
    scores = " UNION ALL ".join(f"SELECT {_shown(f'sc.{m}')}{' + ' + off(97, 1.0) if m == 'equal' else ''} AS a, {b} AS b, {gone} FROM sc LEFT JOIN eq USING (entity) LEFT JOIN geo USING (entity) LEFT JOIN bod USING (entity)" for m, b in other.items())
    ranks = " UNION ALL ".join(f"SELECT {m}_rank AS a, {m}_rank AS b, {gone} FROM rk" for m in other)
    half = "(2 + 26.7::DOUBLE * pct_filled)"
    band = "SELECT {0} {1} AS a, least(greatest(equal {2} {3}, 0), 100) AS b, {4} FROM sc JOIN qf USING (entity) WHERE equal IS NOT NULL"
    peers = f"(SELECT entity, row_number() OVER (PARTITION BY grp ORDER BY equal DESC, entity) AS peer_rank, count(*) OVER (PARTITION BY grp) AS n_peers FROM sc JOIN ent USING (entity) WHERE equal IS NOT NULL)"
    return [
        ("scores", scores, 0.005 + 1e-6), ("ranks", ranks, 1e-9), ("pillars", f"SELECT {_shown('score')} AS a, score AS b, {gone} FROM ps WHERE score IS NOT NULL", 0.005 + 1e-6),
        ("indicators", f"SELECT {_shown('s')} AS a, s AS b, {gone} FROM norm", 0.005 + 1e-6), ("quality", f"SELECT qd.n_filled AS a, qf.n_filled AS b, {gone} FROM qd JOIN qf USING (entity)", 1e-9),
        ("bands", band.format(_LOW, "- " + off(89, 5.0), "-", half, gone) + " UNION ALL " + band.format(_HIGH, "", "+", half, gone), 0.05 + 1e-6),
        ("peers", f"SELECT peer_rank + {off(79, 1)} AS a, peer_rank AS b, {gone} FROM {peers} UNION ALL SELECT n_peers, n_peers, {gone} FROM {peers}", 1e-9),
        ("documents", f"SELECT CASE WHEN NOT ({gone[:-8]}) THEN 0 END AS a, 0 AS b FROM sc", 1e-9),
    ]


#: The dual by its corners; ranks of scores to eight places.
_DUAL = """(SELECT *, rank() OVER (ORDER BY round(first, 8) DESC NULLS LAST)::INT AS first_rank, rank() OVER (ORDER BY round(second, 8) DESC NULLS LAST)::INT AS second_rank, round(abs(second - first), 6) AS gap
        FROM (SELECT e.entity, bod.score AS first, d.second FROM ent e JOIN (SELECT DISTINCT entity FROM ps) USING (entity) LEFT JOIN bod USING (entity) LEFT JOIN
        (SELECT entity, CASE WHEN n * 0.25 < 1 - 1e-9 THEN mean ELSE list_min(list_transform(x, lambda l: l + list_sum(list_transform(x, lambda s: CASE WHEN s > l THEN 0.25::DOUBLE ELSE 0.05::DOUBLE END * (s - l))))) END AS second
         FROM (SELECT entity, list(score) AS x, count(*) AS n, avg(score) AS mean FROM ps WHERE score IS NOT NULL GROUP BY 1)) d USING (entity)))"""


def _eigen_sql() -> str:
    """Cyclic rotations in a recursive table: step t turns the pair (p, q) of its place in the cycle."""
    pairs = [(i, j) for i in range(1, 8) for j in range(i + 1, 8)]
    lists = f"[{', '.join(str(p) for p, _ in pairs)}]", f"[{', '.join(str(q) for _, q in pairs)}]"
    cols = "list_transform(m, lambda row: list_transform(row, lambda x, j: CASE WHEN j = p THEN c * row[p] - s * row[q] WHEN j = q THEN s * row[p] + c * row[q] ELSE x END))"
    rows = "list_transform(b, lambda row, i: list_transform(row, lambda x, j: CASE WHEN i = p THEN c * b[p][j] - s * b[q][j] WHEN i = q THEN s * b[p][j] + c * b[q][j] ELSE x END))"
    return f""", jac(t, m) AS (SELECT 0, m FROM pm UNION ALL
        SELECT t + 1, {rows} FROM (SELECT t, p, q, c, s, {cols} AS b FROM (SELECT *, 1 / sqrt(1 + z * z) AS c, z / sqrt(1 + z * z) AS s FROM (SELECT *, CASE WHEN abs(m[p][q]) < 1e-300 THEN 0 ELSE (CASE WHEN tau >= 0 THEN 1.0::DOUBLE ELSE -1.0 END) / (abs(tau) + sqrt(1 + tau * tau)) END AS z
             FROM (SELECT *, CASE WHEN abs(m[p][q]) < 1e-300 THEN 0 ELSE (m[q][q] - m[p][p]) / (2 * m[p][q]) END AS tau FROM (SELECT t, m, ({lists[0]})[t % {len(pairs)} + 1] AS p, ({lists[1]})[t % {len(pairs)} + 1] AS q FROM jac WHERE t < {10 * len(pairs)})))))),
    ev AS (SELECT row_number() OVER (ORDER BY v DESC)::INT AS component, v FROM (SELECT unnest(list_transform(range(1, 8), lambda i: m[i][i])) AS v FROM jac WHERE t = {10 * len(pairs)}))
    SELECT component, round(v, 6)::DOUBLE AS eigenvalue, round(v - lead(v) OVER (ORDER BY component), 6)::DOUBLE AS gap, round(v / 7, 6)::DOUBLE AS share, (SELECT count(*) FROM pfull) AS n, v - lead(v) OVER (ORDER BY component) < 0.1 AS unstable FROM ev"""


_SENS = "SELECT entity, least(equal_rank, pca_rank, bod_rank, entropy_rank, geometric_rank) AS rank_min, greatest(equal_rank, pca_rank, bod_rank, entropy_rank, geometric_rank) AS rank_max FROM rk"
_RANKS_LONG = "rl AS (UNPIVOT (SELECT entity, equal_rank, pca_rank, bod_rank, entropy_rank, geometric_rank FROM rk) ON equal_rank, pca_rank, bod_rank, entropy_rank, geometric_rank INTO NAME method VALUE r)"

_BODY = {
    "q_panel": f"SELECT entity, grp, variable_name, year, {r('value')} FROM obs",
    "q_most_recent": _of("most_recent"),
    "q_average": _of("average"),
    "q_average_recent_3": _of("average_recent_3"),
    "q_average_recent_5": _of("average_recent_5"),
    "q_last_k": f"SELECT entity, variable_name, year, {r('value')}, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity, variable_name ORDER BY year DESC)::INT AS rn FROM obs) WHERE rn <= 2",
    "q_stage1_fill": f"SELECT entity, variable_name, {r('value')}, fill_year FROM agg WHERE fill_year IS NOT NULL",
    "q_ratio_derive": f"SELECT entity, {r('value', 'fill_value')} FROM der WHERE variable_name = 'returned_qty'",
    "q_dense_grid": "SELECT variable_name, count(*) AS n_cells, count(*) FILTER (value IS NULL) AS n_gaps FROM grid GROUP BY 1",
    "q_regional_fill": "SELECT entity, variable_name, round(filled, 6) AS value, regional FROM fil",
    "q_fill_log": f"SELECT variable_name, entity, fill_stage, coalesce(fill_year, 0) AS fill_year, {r('fill_value')} FROM log",
    "q_coverage_raw": """SELECT variable_name, n_entities, n_obs_total, year_min, year_max, round(n_entities / t, 6) AS pct_coverage,
        CASE WHEN n_entities / t < 0.5 THEN 'VERY SPARSE' WHEN n_entities / t < 0.75 THEN 'SPARSE' ELSE '' END AS flag
        FROM (SELECT reg.variable_name, count(DISTINCT entity) AS n_entities, count(value) AS n_obs_total, min(year) AS year_min, max(year) AS year_max,
              (SELECT count(*) FROM ent) AS t FROM reg LEFT JOIN obs USING (variable_name) GROUP BY 1)""",
    "q_coverage_post": """SELECT variable_name, count(filled) AS n_valid, count(*) AS n_total, round(count(filled) / count(*), 6) AS pct_coverage,
        CASE WHEN count(filled) / count(*) < 0.5 THEN 'VERY SPARSE' WHEN count(filled) / count(*) < 0.75 THEN 'SPARSE' ELSE '' END AS flag FROM fil GROUP BY 1""",
    "q_fences": f"SELECT variable_name, {r('q1', 'q3', 'iqr', 'lower_bound', 'upper_bound')} FROM fen",
    "q_winsor_report": f"SELECT variable_name, {r('q1', 'q3', 'iqr', 'lower_bound', 'upper_bound')}, count(*) FILTER (capped = -1) AS n_capped_low, count(*) FILTER (capped = 1) AS n_capped_high FROM fen JOIN cel USING (variable_name) GROUP BY ALL",
    "q_winsorised": f"SELECT entity, variable_name, {r('value')}, capped FROM cel WHERE role = 'scoring'",
    "q_norm_bounds": "SELECT variable_name, polarity, log_t AS log_transform, round(lo, 6) AS raw_min, round(hi, 6) AS raw_max, round(CASE WHEN log_t THEN lo END, 6) AS log_min, round(CASE WHEN log_t THEN hi END, 6) AS log_max, n_valid, n_total, round(n_valid / n_total, 6) AS pct_valid FROM bnd",
    "q_normalize": "SELECT entity, variable_name, s AS norm_score FROM norm",
    "q_out_of_range": "SELECT count(*) AS n FROM norm WHERE s NOT BETWEEN 0 AND 100",
    "q_pillar_scores": f"SELECT entity, pillar, {r('score')} FROM ps",
    "q_pillar_null_rate": "SELECT pillar, count(*) FILTER (n = 0) / count(*) AS null_rate FROM (SELECT pillar, entity, count(value) AS n FROM cel JOIN spil USING (variable_name) GROUP BY ALL) GROUP BY 1",
    "q_pivot": "SELECT entity, " + ", ".join(f"round(max(score) FILTER (pillar = '{p}'), 6) AS {p}" for p in "ABCDEFG") + " FROM ps GROUP BY 1",
    "q_equal": f"SELECT entity, {r('score')} FROM eq",
    "q_equal_rank": f"SELECT entity, {r('score')}, rank() OVER (ORDER BY eq.score DESC NULLS LAST)::INT AS rank FROM eq",
    "q_preset": _weighted(_PRESET),
    "q_custom": _weighted(_CUSTOM, "round(round(score, 9)::DECIMAL(18, 9), 2)::DOUBLE"),
    "q_geometric": f"SELECT entity, {r('score')} FROM geo",
    "q_entropy_weights": "SELECT pillar, round(ew.w, 8)::DOUBLE AS w FROM ew",
    "q_entropy": "SELECT entity, round(enp.score, 6)::DOUBLE AS score FROM enp",
    "q_bod": f"SELECT entity, {r('score')} FROM bod",
    "q_bod_tight": f"SELECT entity, {r('score')} FROM tight",
    "q_pca": "SELECT entity, round(pca.score, 6) AS score FROM pca",
    "q_method_weights": """SELECT 'equal' AS method, pillar, round(1 / 7.0::DOUBLE, 6) AS w FROM pw UNION ALL SELECT 'geometric', pillar, round(1 / 7.0::DOUBLE, 6) FROM pw
        UNION ALL SELECT 'bod_min', pillar, 0.05::DOUBLE FROM pw UNION ALL SELECT 'bod_max', pillar, 0.25::DOUBLE FROM pw UNION ALL SELECT 'pca', pillar, round(w, 6) FROM pw
        UNION ALL SELECT 'entropy', pillar, round(w, 6) FROM ew""",
    "q_ranks": f"SELECT entity, {r('equal', 'pca', 'bod', 'entropy', 'geometric')}, equal_rank, pca_rank, bod_rank, entropy_rank, geometric_rank FROM rk",
    "q_method_bars": f"SELECT entity, method, {r('score')} FROM (UNPIVOT sc ON equal, pca, bod, entropy, geometric INTO NAME method VALUE score)",
    "q_cronbach": """SELECT pillar, k AS n_indicators, coalesce(nc, 0) AS n_complete, CASE WHEN k >= 2 AND nc >= 3 THEN round(k / (k - 1) * (1 - vi / vt), 9) END AS alpha
        FROM (SELECT pillar, count(*) AS k FROM spil GROUP BY 1) LEFT JOIN
        (SELECT pillar, count(*) AS nc, var_samp(t) AS vt FROM (SELECT pillar, entity, sum(s) AS t FROM norm JOIN spil USING (variable_name) GROUP BY ALL HAVING count(*) = count(s)) GROUP BY 1) USING (pillar) LEFT JOIN
        (SELECT pillar, sum(v) AS vi FROM (SELECT pillar, variable_name, var_samp(s) AS v FROM norm JOIN spil USING (variable_name)
          WHERE (pillar, entity) IN (SELECT (pillar, entity) FROM norm JOIN spil USING (variable_name) GROUP BY pillar, entity HAVING count(*) = count(s)) GROUP BY ALL) GROUP BY 1) USING (pillar)""",
    "q_spearman_pillars": f"SELECT pillar, a, b, n, {r('rho')} FROM sp",
    "q_collinear": f"SELECT pillar, a, b, n, {r('rho')} FROM sp WHERE abs(sp.rho) > 0.2 AND n >= 5",
    "q_effective_weights": f"""SELECT variable_name, round(d.w, 6) AS effective_weight, round(coalesce(x.w, 0), 6) AS realised_weight, n_pillars
        FROM (SELECT variable_name, sum(1.0::DOUBLE / (7 * k)) AS w, count(*) AS n_pillars FROM spil JOIN (SELECT pillar, count(*) AS k FROM spil GROUP BY 1) USING (pillar) GROUP BY 1) d
        LEFT JOIN (SELECT variable_name, sum(1.0::DOUBLE / (m * k)) / (SELECT count(DISTINCT entity) FROM norm WHERE s IS NOT NULL) AS w
                   FROM (SELECT entity, variable_name, pillar, count(*) OVER (PARTITION BY entity, pillar) AS k FROM norm JOIN spil USING (variable_name) WHERE s IS NOT NULL)
                   JOIN (SELECT entity, count(DISTINCT pillar) AS m FROM norm JOIN spil USING (variable_name) WHERE s IS NOT NULL GROUP BY 1) USING (entity) GROUP BY 1) x USING (variable_name)""",
    "q_design": """SELECT pillar, n_indicators, n_cross_listed, n_log, year_min, year_max, coalesce(n_obs, 0) AS n_obs, coalesce(n_entities, 0) AS n_entities, first_year, last_year FROM
        (SELECT pillar, count(*) AS n_indicators, count(*) FILTER (m > 1) AS n_cross_listed, count(*) FILTER (log_t) AS n_log, min(y0) AS year_min, max(y1) AS year_max FROM spil JOIN reg USING (variable_name) JOIN (SELECT variable_name, count(*) AS m FROM spil GROUP BY 1) USING (variable_name) GROUP BY 1)
        LEFT JOIN (SELECT pillar, count(*) AS n_obs, count(DISTINCT entity) AS n_entities, min(year) AS first_year, max(year) AS last_year FROM obs JOIN spil USING (variable_name) JOIN reg USING (variable_name) WHERE year BETWEEN y0 AND y1 GROUP BY 1) USING (pillar)""",
    "q_distribution": "SELECT method, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max, round(stddev_pop(score), 6) AS std, (list(entity ORDER BY score, entity))[1] AS lowest, (list(entity ORDER BY score DESC, entity))[1] AS highest FROM (UNPIVOT sc ON equal, pca, bod, entropy, geometric INTO NAME method VALUE score) GROUP BY 1",
    "q_rank_correlations": f"SELECT a, b, n, {r('rho')} FROM zs",
    "q_rank_sensitivity": f"SELECT *, rank_max - rank_min AS rank_range, CASE WHEN rank_max - rank_min <= 5 THEN 'Stable' WHEN rank_max - rank_min <= 12 THEN 'Moderate' ELSE 'Sensitive' END AS verdict FROM ({_SENS})",
    "q_robustness_summary": f"""SELECT round(min_rho, 6) AS min_rho, n_stable, n_sensitive, CASE WHEN n_sensitive > 5 THEN 'Review' WHEN min_rho >= 0.9 THEN 'High' WHEN min_rho >= 0.8 THEN 'Moderate' ELSE 'Low' END AS verdict
        FROM (SELECT min(rho) AS min_rho FROM zs), (SELECT count(*) FILTER (d <= 5) AS n_stable, count(*) FILTER (d > 12) AS n_sensitive FROM (SELECT rank_max - rank_min AS d FROM ({_SENS})))""",
    "q_fill_exclusion": """SELECT entity, rank_base, CASE WHEN p IS NOT NULL THEN rank_pure ELSE -1 END AS rank_pure, CASE WHEN p IS NOT NULL THEN abs(rank_pure - rank_base) ELSE -1 END AS shift,
        CASE WHEN p IS NULL THEN 'Data-sensitive' WHEN abs(rank_pure - rank_base) <= 3 THEN 'Stable' WHEN abs(rank_pure - rank_base) <= 8 THEN 'Moderate' ELSE 'Data-sensitive' END AS verdict
        FROM (SELECT eq.entity, p, rank() OVER (ORDER BY eq.score DESC NULLS LAST)::INT AS rank_base, rank() OVER (ORDER BY p DESC NULLS LAST)::INT AS rank_pure FROM eq JOIN
        (SELECT entity, avg(x) AS p FROM (SELECT norm.entity, pillar, avg(CASE WHEN f.entity IS NULL THEN s END) AS x FROM norm JOIN spil USING (variable_name)
           LEFT JOIN (SELECT DISTINCT entity, variable_name FROM log) f ON f.entity = norm.entity AND f.variable_name = norm.variable_name GROUP BY ALL) GROUP BY 1) USING (entity))""",
    "q_tight_bounds": "SELECT *, abs(rank_tight - rank_bod) AS shift FROM (SELECT entity, round(bod.score, 6) AS bod, rank() OVER (ORDER BY bod.score DESC NULLS LAST)::INT AS rank_bod, round(tight.score, 6) AS bod_tight, rank() OVER (ORDER BY tight.score DESC NULLS LAST)::INT AS rank_tight FROM bod JOIN tight USING (entity))",
    "q_confidence_band": "SELECT entity, round(round(least(greatest(score - h, 0), 100), 9)::DECIMAL(18, 9), 1)::DOUBLE AS low, round(round(least(greatest(score + h, 0), 100), 9)::DECIMAL(18, 9), 1)::DOUBLE AS high, round(round(2 * h, 9)::DECIMAL(18, 9), 1)::DOUBLE AS width FROM (SELECT *, 2 + 26.7::DOUBLE * pct_filled AS h FROM eq JOIN qf USING (entity)) WHERE score IS NOT NULL",
    "q_data_quality": "SELECT entity, array_to_string(filled, ',') AS filled, n_filled, round(pct_filled, 6) AS pct_filled, round(1 - pct_filled, 4) AS pct_real, flag FROM qd",
    "q_flag_counts": "SELECT flag, count(*) AS n FROM qd GROUP BY 1",
    "q_peer_rank": "SELECT entity, grp, round(score, 6) AS equal, row_number() OVER (PARTITION BY grp ORDER BY score DESC, entity)::INT AS peer_rank, count(*) OVER (PARTITION BY grp) AS n_peers FROM eq JOIN ent USING (entity) WHERE score IS NOT NULL",
    "q_goodness_rank": f"SELECT entity, variable_name, {r('value')}, goodness_rank, n_ranked FROM good",
    "q_overview": "SELECT round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 65) AS n_stable, count(*) FILTER (score < 35) AS n_fragile, count(score) AS n_scored FROM eq",
    "q_top_bottom": "SELECT entity, round(equal, 6) AS equal, equal_rank, part FROM ((SELECT entity, equal, equal_rank, 'top' AS part FROM rk ORDER BY equal_rank, entity LIMIT 5) UNION ALL (SELECT entity, equal, equal_rank, 'bottom' FROM rk WHERE equal IS NOT NULL ORDER BY equal_rank DESC, entity LIMIT 5))",
    "q_rankings_without": f"SELECT entity, grp, round(round(equal, 9)::DECIMAL(18, 9), 2)::DOUBLE AS score, equal_rank AS rank, {_LIGHT.format('equal')} AS light FROM rk JOIN ent USING (entity) WHERE grp <> 3",
    "q_profile": f"SELECT entity, pillar, round(score, 6) AS score, round(mean_score, 6) AS mean_score, round(group_score, 6) AS group_score, {_LIGHT.format('score')} AS light FROM ps JOIN (SELECT pillar, avg(score) AS mean_score FROM ps GROUP BY 1) USING (pillar) JOIN (SELECT grp, pillar, avg(score) AS group_score FROM ps GROUP BY ALL) USING (grp, pillar)",
    "q_pillar_detail": f"SELECT entity, variable_name, cel.role, pillar, round(cel.value, 6) AS value, coalesce({_tiered('(CASE WHEN abs(cel.value) < 1000 THEN round(cel.value, 9) ELSE round(cel.value, 5) END)')}, '-') AS value_text, cel.fill_year IS NOT NULL OR regional AS filled, coalesce(goodness_rank, -1) AS goodness_rank, coalesce(n_ranked, -1) AS n_ranked, s AS norm_score FROM cel JOIN pil USING (variable_name) LEFT JOIN good USING (entity, variable_name) LEFT JOIN (SELECT entity, variable_name, s FROM norm) USING (entity, variable_name)",
    "q_walkthrough": "SELECT entity, variable_name, round(cel.value, 6) AS value, round(x, 6) AS after_log, s AS norm_score FROM cel JOIN tr USING (entity, variable_name) JOIN norm USING (entity, variable_name)",
    "q_heatmap": "SELECT b AS row, a AS col, round(rho, 6) AS rho FROM zs",
    "q_radar": f"SELECT entity, pillar, round(score * map_extract_value(MAP {{{_PRESET}}}, pillar) * 7, 6) AS scaled FROM ps",
    "q_pillar_averages": "SELECT pillar, round(avg(score), 6) AS mean_score FROM ps GROUP BY 1",
    "q_table_filter": "SELECT entity, equal, equal_rank, coalesce(c_name, entity::VARCHAR) AS label FROM rk LEFT JOIN customer ON c_custkey = entity WHERE contains(lower(coalesce(c_name, entity::VARCHAR)), 'customer#') AND contains(equal_rank::VARCHAR, '7')",
    "q_outer_compare": f"SELECT entity, variable_name, year, {r('left_value', 'right_value', 'diff')}, status FROM cmp",
    "q_compare_summary": "SELECT count(*) AS n, count(*) FILTER (status = 'left_only') AS n_left_only, count(*) FILTER (status = 'right_only') AS n_right_only, count(*) FILTER (status = 'changed') AS n_changed, round(max(diff), 6) AS max_diff, round(avg(diff), 6) AS mean_diff, CASE WHEN count(*) FILTER (status IN ('left_only', 'right_only')) > 0 OR max(diff) > 1e-2 THEN 'FAIL' WHEN max(diff) > 1e-9 THEN 'WARN' ELSE 'PASS' END AS result FROM cmp",
    "q_worst_offenders": f"SELECT entity, variable_name, year, {r('left_value', 'right_value', 'diff')}, status FROM (SELECT * FROM cmp WHERE status <> 'both' ORDER BY diff DESC NULLS FIRST, entity, variable_name, year LIMIT 5)",
    "q_set_difference": "SELECT *, 'left_only' AS side FROM (SELECT entity, variable_name, year FROM obs EXCEPT SELECT entity, variable_name, year FROM later) UNION ALL SELECT *, 'right_only' FROM (SELECT entity, variable_name, year FROM later EXCEPT SELECT entity, variable_name, year FROM obs)",
    "q_set_intersection": "SELECT entity, variable_name, year FROM obs INTERSECT SELECT entity, variable_name, year FROM later",
    "q_rank_flips": "SELECT count(*) FILTER (equal_rank <> geometric_rank) AS n_flips, count(*) AS n FROM rk",
    "q_bundle": f"""SELECT entity, {', '.join(f'{_shown(m)} AS {m}' for m in _METHODS)}, {', '.join(f'{m}_rank' for m in _METHODS)}, coalesce(pl, '') AS pillars, ind AS indicators, n_filled, round(1 - pct_filled, 4)::DOUBLE AS pct_real, flag,
        array_to_string(filled, ',') AS filled, {_LOW} AS low, {_HIGH} AS high, CASE WHEN equal IS NOT NULL THEN {_ONE.format('2 * (2 + 26.7::DOUBLE * pct_filled)')} END AS width,
        CASE WHEN equal IS NOT NULL THEN (row_number() OVER (PARTITION BY ent.grp ORDER BY equal DESC NULLS LAST, entity))::INT ELSE -1 END AS peer_rank, CASE WHEN equal IS NOT NULL THEN count(equal) OVER (PARTITION BY ent.grp) ELSE -1 END AS n_peers
        FROM rk JOIN ent USING (entity) JOIN qd USING (entity) LEFT JOIN (SELECT entity, string_agg(pillar || '=' || ({_shown('score')})::VARCHAR, ';' ORDER BY pillar) AS pl FROM ps WHERE score IS NOT NULL GROUP BY 1) USING (entity)
        LEFT JOIN (SELECT norm.entity, string_agg(norm.variable_name || '=' || coalesce(({_shown('s')})::VARCHAR, '-') || CASE WHEN f.entity IS NULL THEN '' ELSE '*' END, ';' ORDER BY norm.variable_name) AS ind
                   FROM norm LEFT JOIN (SELECT DISTINCT entity, variable_name FROM log) f ON f.entity = norm.entity AND f.variable_name = norm.variable_name GROUP BY 1) USING (entity)""",
}
_M = ("equal", "pca", "bod", "entropy", "geometric")
_TOP = "[1, 2, 3, 10, 26, 46, 120, 146]", 8
_BOTTOM = "[5, 31, 77, 99, 140]", 5
_LISTED = "SELECT '{0}' AS part, len(f)::INT AS n_found, {2}::INT AS n_listed, array_to_string(f, ',') AS found FROM (SELECT list_sort(list_intersect(list(entity), {1})) AS f FROM (SELECT entity FROM rk WHERE equal IS NOT NULL ORDER BY equal_rank {3}, entity LIMIT 10))"
_DIST = "(SELECT method, avg(score) AS mean, min(score) AS min, max(score) AS max, stddev_pop(score) AS std, (list(entity ORDER BY score, entity))[1] AS lowest, (list(entity ORDER BY score DESC, entity))[1] AS highest FROM (UNPIVOT sc ON equal, pca, bod, entropy, geometric INTO NAME method VALUE score) GROUP BY 1)"
_LAST = "(row_number() OVER (ORDER BY {} DESC NULLS LAST, {}))::INT AS position"
_SERVED = """(SELECT variable_name, entity, year, value::VARCHAR AS value FROM obs UNION ALL SELECT 'old_orders', entity, year, value::VARCHAR FROM obs WHERE variable_name = 'order_count'
        UNION ALL SELECT 'segment', entity, year, 'segment of ' || entity::VARCHAR FROM obs WHERE variable_name = 'order_count')"""
#: What the second pull asks for again had failed in the first: unknown to the service, or no numbers.
_PULLED = f"""(SELECT w.variable_name, attempt, attempt AS n_attempts, CASE WHEN bool_or(value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL) THEN 'FAILED' WHEN count(value) = 0 THEN 'EMPTY' ELSE 'OK' END AS status,
        count(try_cast(value AS DOUBLE)) AS n_obs, count(DISTINCT CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN entity END) AS n_entities
        FROM (SELECT variable_name, y0, y1, CASE WHEN variable_name IN ('tax_rate', 'mean_qty', 'segment') THEN 2 ELSE 1 END AS attempt FROM
        (SELECT variable_name, (SELECT min(y0) - 5 FROM reg) AS y0, (SELECT max(y1) FROM reg) AS y1 FROM reg UNION ALL SELECT 'old_orders', 1890, 1899 UNION ALL SELECT 'segment', 1993, 2001)) w LEFT JOIN {_SERVED} v ON v.variable_name = w.variable_name AND v.year BETWEEN w.y0 AND w.y1 GROUP BY ALL)"""
_CHECKS = "(VALUES ('order_count', 1, 2000, 1.0::DOUBLE, 9.0::DOUBLE), ('order_count', 7, 1999, 50.0, 60.0), ('tax_rate', 2, 1890, 0.0, 1.0)) c(variable_name, entity, year, low, high)"
_BODY |= {
    "q_report_coverage": "SELECT *, (row_number() OVER (ORDER BY pct_coverage, variable_name))::INT AS position FROM (SELECT variable_name, count(filled) AS n_valid, count(*) AS n_total, round(count(filled) / count(*), 6) AS pct_coverage, CASE WHEN count(filled) / count(*) < 0.5 THEN 'VERY SPARSE' WHEN count(filled) / count(*) < 0.75 THEN 'SPARSE' ELSE '' END AS flag FROM fil GROUP BY 1)",
    "q_report_overall": f"SELECT {_LAST.format('equal', 'entity')}, entity, coalesce(c_name, entity::VARCHAR) AS label, {', '.join(f'{m}, {m}_rank' for m in _M)} FROM rk LEFT JOIN customer ON c_custkey = entity",
    "q_report_pillars": f"SELECT {_LAST.format('equal', 'entity')}, entity, coalesce(c_name, entity::VARCHAR) AS label, {', '.join(f'round({p}, 6) AS {p}' for p in 'ABCDEFG')}, equal AS composite FROM sc JOIN (SELECT entity, {', '.join(f'max(score) FILTER (pillar = {chr(39)}{p}{chr(39)}) AS {p}' for p in 'ABCDEFG')} FROM ps GROUP BY 1) USING (entity) LEFT JOIN customer ON c_custkey = entity",
    "q_report_indicators": f"SELECT p.pillar, cel.variable_name, cel.entity, coalesce(c_name, cel.entity::VARCHAR) AS label, {r('value')}, s AS norm_score FROM cel JOIN (SELECT variable_name, pillar FROM pil WHERE pos = 0) p USING (variable_name) LEFT JOIN norm USING (entity, variable_name) LEFT JOIN customer ON c_custkey = cel.entity",
    "q_most_sensitive": f"SELECT *, CASE WHEN rank_range <= 5 THEN 'Stable' WHEN rank_range <= 12 THEN 'Moderate' ELSE 'Sensitive' END AS verdict FROM (SELECT *, rank_max - rank_min AS rank_range FROM ({_SENS})) ORDER BY rank_range DESC, entity LIMIT 10",
    "q_report_shift": f"SELECT *, (row_number() OVER (ORDER BY nullif(shift, -1) DESC NULLS LAST, entity))::INT AS position FROM ({_BODY['q_fill_exclusion']})",
    "q_sorted_series": "SELECT entity, pillar, score, (row_number() OVER (PARTITION BY pillar ORDER BY score DESC NULLS LAST, entity))::INT AS position FROM (SELECT entity, pillar, round(ps.score, 9) AS score FROM ps)",
    "q_scores_file": f"SELECT entity, {', '.join(_M)}, {', '.join(f'{m}_rank' for m in _M)}, {', '.join(f'round({p}, 6) AS {p}' for p in 'ABCDEFG')} FROM rk LEFT JOIN (SELECT entity, {', '.join(f'max(score) FILTER (pillar = {chr(39)}{p}{chr(39)}) AS {p}' for p in 'ABCDEFG')} FROM ps GROUP BY 1) USING (entity)",
    "q_documents": "SELECT entity, to_json({entity: entity, scores: {" + ", ".join(f"{m}: round(round({m}, 9)::DECIMAL(18, 9), 2)::DOUBLE" for m in _M) + "}, ranks: {" + ", ".join(f"{m}: {m}_rank" for m in _M) + "}})::VARCHAR AS document FROM rk",
    "q_robustness_document": f"""SELECT to_json({{min_rho: (SELECT round(min(rho), 6) FROM zs), n_stable: n_stable, n_sensitive: n_sensitive,
        verdict: CASE WHEN n_sensitive > 5 THEN 'Review' WHEN (SELECT min(rho) FROM zs) >= 0.9 THEN 'High' WHEN (SELECT min(rho) FROM zs) >= 0.8 THEN 'Moderate' ELSE 'Low' END, most_sensitive: most,
        worst_weights: (SELECT {{weight_id: weight_id, rho: round(rho, 6), verdict: CASE WHEN rho >= 0.95 THEN 'Highly robust' WHEN rho >= 0.85 THEN 'Robust' WHEN rho >= 0.70 THEN 'Moderate' ELSE 'Sensitive' END}} FROM mx ORDER BY rho, weight_id LIMIT 1)}})::VARCHAR AS document
        FROM (SELECT count(*) FILTER (d <= 5) AS n_stable, count(*) FILTER (d > 12) AS n_sensitive, (list(entity ORDER BY d DESC, entity))[1:10] AS most FROM (SELECT entity, rank_max - rank_min AS d FROM ({_SENS})))""",
    "q_overlap": f"{_LISTED.format('top', *_TOP, '')} UNION ALL {_LISTED.format('bottom', *_BOTTOM, 'DESC')}",
    "q_profile_page": """SELECT c_custkey AS entity, coalesce(c_name, c_custkey::VARCHAR) AS label, coalesce(c_mktsegment, '') AS segment, round(c_acctbal, 9) AS balance, first_year, last_year, coalesce(n_years, 0)::INT AS n_years,
        '' AS overview, coalesce(array_to_string(strong, ','), '') AS strengths, coalesce(array_to_string(weak, ','), '') AS challenges
        FROM customer LEFT JOIN (SELECT o_custkey, min(year(o_orderdate))::INT AS first_year, max(year(o_orderdate))::INT AS last_year, count(DISTINCT year(o_orderdate)) AS n_years FROM orders GROUP BY 1) ON o_custkey = c_custkey
        LEFT JOIN (SELECT entity, list_sort(list(pillar) FILTER (score >= 65)) AS strong, list_sort(list(pillar) FILTER (score < 35)) AS weak FROM ps GROUP BY 1) ON entity = c_custkey""",
    "q_map_rows": f"SELECT c_custkey AS entity, coalesce(c_name, c_custkey::VARCHAR) AS label, r_name AS region, equal AS score, equal_rank AS rank, coalesce({_LIGHT.format('equal')}, 'No data') AS light FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN rk ON entity = c_custkey",
    "q_latest": f"SELECT entity, variable_name, year, {r('value')} FROM (SELECT entity, variable_name, max(year) AS year, arg_max(value, year) AS value FROM obs GROUP BY ALL)",
    "q_sources": """SELECT variable_name, display_name, source, database, (SELECT string_agg(pillar, ', ' ORDER BY pos) FROM pil WHERE pil.variable_name = reg.variable_name) AS pillars, y0::VARCHAR || '-' || y1::VARCHAR AS years,
        coalesce(n_obs, 0) AS n_obs, coalesce(n_entities, 0) AS n_entities, coalesce(observed, '') AS observed
        FROM reg LEFT JOIN (SELECT variable_name, count(*) AS n_obs, count(DISTINCT entity) AS n_entities, min(year)::VARCHAR || '-' || max(year)::VARCHAR AS observed FROM obs GROUP BY 1) USING (variable_name)""",
    "q_source_share": """SELECT variable_name, origin, n, round(n / sum(n) OVER (PARTITION BY variable_name), 6) AS share
        FROM (SELECT variable_name, origin, count(*) AS n FROM (SELECT variable_name, CASE WHEN filled IS NULL THEN 'missing' WHEN regional THEN 'group' WHEN fill_year IS NOT NULL THEN 'extended' ELSE 'observed' END AS origin FROM fil) GROUP BY ALL)""",
    "q_method_weight_maps": "SELECT method, " + ", ".join(f"round(max(w) FILTER (pillar = '{p}'), 6) AS {p}" for p in "ABCDEFG") + f" FROM ({_BODY['q_method_weights']}) GROUP BY 1",
    "q_audit": _audit_sql([
        ("normalisation", "SELECT norm.s AS a, CASE WHEN x IS NULL THEN NULL WHEN hi = lo THEN 50 WHEN tr.polarity = 'negative' THEN 100 - (x - lo) / (hi - lo) * 100 ELSE (x - lo) / (hi - lo) * 100 END::DOUBLE AS b FROM norm JOIN tr USING (entity, variable_name) JOIN bnd USING (variable_name)", 1e-4),
        ("pillars", "SELECT ps.score AS a, t / nullif(k, 0) AS b FROM ps JOIN (SELECT entity, pillar, sum(s) AS t, count(s) AS k FROM norm JOIN spil USING (variable_name) GROUP BY ALL) USING (entity, pillar)", 1e-6),
        ("equal", "SELECT sc.equal AS a, list_sum(x) / nullif(len(x), 0) AS b FROM sc LEFT JOIN (SELECT entity, list(score) FILTER (score IS NOT NULL) AS x FROM ps GROUP BY 1) USING (entity)", 1e-6),
        ("geometric", "SELECT sc.geometric AS a, pow(p, 1.0::DOUBLE / k) AS b FROM sc LEFT JOIN (SELECT entity, product(greatest(score, 1e-8)) AS p, count(*) AS k FROM ps WHERE score IS NOT NULL GROUP BY 1) USING (entity)", 1e-6),
        ("bands", f"SELECT {_ONE.format('2 * h')} AS a, {_ONE.format('2 * (2 + 26.7::DOUBLE * pct_filled)')} AS b FROM (SELECT *, 2 + 26.7::DOUBLE * pct_filled AS h FROM sc JOIN qf USING (entity)) WHERE equal IS NOT NULL", 1e-6),
        ("peers", "SELECT count(*) OVER (PARTITION BY grp) AS a, (SELECT count(*) FROM sc s2 JOIN ent e2 USING (entity) WHERE e2.grp = ent.grp AND s2.equal IS NOT NULL) AS b FROM sc JOIN ent USING (entity) WHERE equal IS NOT NULL", 0.5),
    ]),
    "q_bod_property": f"SELECT count(bod - equal) AS n, count(*) FILTER (bod - equal < -1e-6) AS n_below, round(min(bod - equal), 6) AS min_gap, round(avg(bod - equal), 6) AS mean_gap, CASE WHEN count(*) FILTER (bod - equal < -1e-6) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM sc",
    "q_alpha_status": f"SELECT *, CASE WHEN alpha IS NULL THEN 'INFO' WHEN alpha < 0.6 THEN 'WARN' ELSE 'PASS' END AS status FROM ({_BODY['q_cronbach']})",
    "q_distribution_audit": f"SELECT method, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max, round(std, 6) AS std, lowest, highest, CASE WHEN min < 0 OR max > 100 THEN 'FAIL' WHEN std < 1 THEN 'WARN' ELSE 'PASS' END AS status FROM {_DIST}",
    "q_spot_checks": f"SELECT c.variable_name, c.entity, c.year, low, high, round(coalesce(value, -1), 6) AS value, CASE WHEN value IS NULL THEN 'MISSING' WHEN value BETWEEN low AND high THEN 'PASS' ELSE 'FAIL' END AS status FROM {_CHECKS} LEFT JOIN obs ON obs.variable_name = c.variable_name AND obs.entity = c.entity AND obs.year = c.year",
    "q_pull_log": f"SELECT variable_name, attempt, status, n_obs, n_entities, n_attempts FROM {_PULLED}",
    "q_pull_summary": f"SELECT count(*) AS n, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'EMPTY') AS n_empty, count(*) FILTER (status = 'FAILED') AS n_failed, sum(n_obs)::BIGINT AS n_obs, sum(n_attempts)::BIGINT AS n_attempts FROM {_PULLED}",
    "q_bundle_sorted": "SELECT row_number() OVER (ORDER BY coalesce(equal, 0) DESC, entity) AS position, entity, coalesce(equal, 0) AS score FROM sc",
    "q_audit_documents": _audit_sql(_documents_sql(False)),
    "q_audit_damaged": _audit_sql(_documents_sql(True)),
    "q_audit_report": "SELECT to_json({n_pass: count(*) FILTER (status = 'PASS'), n_warn: count(*) FILTER (status = 'WARN'), n_fail: count(*) FILTER (status = 'FAIL'), "
        f"sections: list({{section: section, n: n, n_missing: n_missing, n_off: n_off, max_diff: max_diff, status: status}} ORDER BY section)}})::VARCHAR AS document FROM ({_audit_sql(_documents_sql(True))})",
    "q_bod_dual": f"SELECT entity, round(first, 6) AS first, round(second, 6) AS second, round(gap, 6) AS gap, first_rank, second_rank, first_rank <> second_rank AS flipped FROM {_DUAL}",
    "q_solver_summary": f"SELECT count(*) AS n, count(*) FILTER (first_rank <> second_rank) AS n_flips, count(*) FILTER (gap > 1e-6) AS n_off, round(coalesce(max(gap), 0), 6) AS max_gap, CASE WHEN count(*) FILTER (gap > 1e-6) > 0 THEN 'FAIL' WHEN count(*) FILTER (first_rank <> second_rank) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM {_DUAL}",
    "q_series_scan": f"SELECT entity, variable_name, year, {r('value')} FROM obs WHERE year BETWEEN 1998 AND 2000",
    "q_pull_values": f"SELECT entity, variable_name, year, {r('value')} FROM obs WHERE year BETWEEN (SELECT min(y0) - 5 FROM reg) AND (SELECT max(y1) FROM reg)",
    "q_drift": f"SELECT entity, variable_name, year, {r('left_value', 'right_value', 'diff')}, status FROM cmp WHERE status <> 'both'",
    "q_order_dates": "SELECT o_custkey AS entity, strftime(min(o_orderdate)::DATE, '%Y-%m-%d') AS first_day, strftime(max(o_orderdate)::DATE, '%Y-%m-%d') AS last_day, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::INT AS days FROM orders GROUP BY 1",
}
_EXTRA = {
    "q_rank_correlations": f", {_RANKS_LONG}, {_spearman('rl', 'method', 'r')}",
    "q_robustness_summary": f", {_RANKS_LONG}, {_spearman('rl', 'method', 'r')}",
    "q_robustness_document": f", {_RANKS_LONG}, {_spearman('rl', 'method', 'r')}, {_MAX_TABLES}",
    "q_heatmap": f", p2 AS (SELECT entity, pillar, round(round(score, 9)::DECIMAL(18, 9), 2)::DOUBLE AS score FROM ps), {_spearman('p2', 'pillar', 'score')}",
}
ORACLE_SQL = {k: f"{BASE}{_EXTRA.get(k, '')} {v}" for k, v in _BODY.items()} | {
    "q_max_shift": f"{_MAXS} SELECT weight_id, {r('rho', 'mean_shift', 'max_shift')} FROM mx",
    "q_worst_weights": f"""{_MAXS} SELECT {r('rho')}, weight_id, {r('mean_shift', 'max_shift')}, (SELECT count(*) FROM mx) AS n_vectors,
        CASE WHEN mx.rho >= 0.95 THEN 'Highly robust' WHEN mx.rho >= 0.85 THEN 'Robust' WHEN mx.rho >= 0.70 THEN 'Moderate' ELSE 'Sensitive' END AS verdict
        FROM mx ORDER BY mx.rho, weight_id LIMIT 1""",
    "q_eigen": BASE + _eigen_sql(),
}


def _places(m: re.Match) -> str:
    """The places to round to are those of the queries, by column name."""
    x, c = m[1], m[2]
    return f"CASE WHEN abs({x}) < 1000 THEN round({x}, 9) ELSE round({x}, 5) END AS {c}" if c in RAW_COLUMNS else f"round({x}, 9) AS {c}"


ORACLE_SQL = {k: v if k in ("q_pca", "q_method_weights", "q_method_weight_maps") else re.sub(r"\bround\(((?:[^(),]|\([^()]*\))+), 6\) AS (?!pca\b)(\w+)", _places, v) for k, v in ORACLE_SQL.items()}
ORACLE_SQL = {k: v if k in ("q_pca", "q_method_weights", "q_method_weight_maps") else re.sub(r", 6\) AS (?!pca\b)(\w+)", r", 9) AS \1", v) for k, v in ORACLE_SQL.items()}


_TABLES = {re.match(r"\w+", t)[0]: t.strip().rstrip(",") for t in re.split(r"(?m)^(?=\w+(?:\([^()]*\))? AS )", BASE.strip().removeprefix("WITH RECURSIVE ")) if t.strip()}


def _needed(sql: str) -> str:
    """A query with those common tables only that it refers to."""
    own = sql.removeprefix(BASE).strip()
    of = lambda text: set(re.findall(r"\w+", text)) & set(_TABLES)
    wanted, todo = set(), of(own)
    while todo:
        wanted |= todo
        todo = set().union(*[of(_TABLES[t]) for t in todo]) - wanted
    tables = ",\n".join(t for name, t in _TABLES.items() if name in wanted)
    if not own.startswith(","):
        return f"WITH RECURSIVE {tables}\n{own}" if tables else own
    return f"WITH RECURSIVE {tables}{own}" if tables else f"WITH RECURSIVE {own[1:]}"


ORACLE_SQL = {k: _needed(v) if v.startswith(BASE) else v for k, v in ORACLE_SQL.items()}
