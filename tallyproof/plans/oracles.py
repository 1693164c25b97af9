"""The same results in plain SQL over the given tables, written in the textbook form.

Variances join the ratio back to the rows, quantiles order single rows; nothing here shares code with the
operators.
"""

from __future__ import annotations

from dataclasses import astuple

from ..operators.rows import WARNING
from . import claims as C
from . import queries as Q
from .bundle import QUESTIONS, SOURCE
from .micro import CATALOG, EARLY, LATE, MAY_CLAIM, MIDDLE, PAID_BACK, SENT_BACK, WAVES

MICRO = """micro AS (
SELECT k AS resp_id, yr, supplier, outcome, paid,
  CASE WHEN outcome IN (2, 3) AND paid = 1 THEN CASE WHEN k % 43 = 0 THEN 7 WHEN tax <= 2 THEN 0 WHEN tax <= 5 THEN 1 ELSE 2 END END AS refund,
  CASE WHEN outcome = 3 THEN CASE WHEN k % 53 = 0 THEN 88 ELSE weeks END END AS wait,
  CASE WHEN k % 61 = 0 THEN 999 ELSE CAST(floor(price / 1000) AS INT) END AS spend,
  cut, CASE WHEN k % 101 = 0 THEN 9 ELSE q END AS quarter, qty,
  CASE WHEN k % 113 <> 0 THEN price / 100 END AS wt, CASE WHEN k % 109 <> 0 THEN CAST(qty AS DOUBLE) END AS wt_units,
  stratum, CASE WHEN k % 127 <> 0 THEN place END AS cluster FROM (
 SELECT *, CASE WHEN k % 37 = 0 THEN 9 WHEN flag = 'N' THEN 1 WHEN flag = 'A' THEN 2 ELSE 3 END AS outcome FROM (
  SELECT l_orderkey * 10 + l_linenumber AS k, CAST(extract(year FROM l_shipdate) AS INT) AS yr,
     CAST(extract(quarter FROM l_shipdate) AS INT) AS q, l_suppkey AS supplier, CAST(round(l_discount * 100) AS INT) AS cut,
     CAST(round(l_tax * 100) AS INT) AS tax, CAST(l_quantity AS INT) AS qty, l_returnflag AS flag,
     CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS paid, l_extendedprice AS price,
     CAST((l_partkey * 7 + l_orderkey) % 50 + 1 AS INT) AS weeks, CAST(l_partkey % 15 AS INT) AS stratum,
     CAST(l_orderkey % 4 AS INT) AS place FROM lineitem) a ) b)"""


def _values(rows) -> str:
    """Rows as the body of VALUES."""
    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return text(v) if isinstance(v, str) else repr(v)
    return "(VALUES " + ",\n".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


WAVE_COLUMNS = {
    EARLY: "result paid cut_pm w_line w_units stratum cluster", MIDDLE: "result paid w_line stratum cluster",
    LATE: "outcome paid cut wt wt_units stratum cluster",
}
WAVE_TABLES = f"""sheets AS (
SELECT *, CASE WHEN yr <= {EARLY} THEN {EARLY} WHEN yr <= {MIDDLE} THEN {MIDDLE} ELSE {LATE} END AS wave,
  CASE WHEN outcome = 9 THEN 9 ELSE 4 - outcome END AS result FROM micro),
answers AS (
SELECT 'sent_back' AS canonical, wave, result AS v, CASE WHEN result = 1 THEN 1.0 ELSE 0.0 END AS yes, wt AS w FROM sheets
  WHERE wave < {LATE} AND result IN (1, 2, 3)
UNION ALL SELECT 'sent_back', wave, outcome, CASE WHEN outcome = 3 THEN 1.0 ELSE 0.0 END, wt FROM sheets
  WHERE wave = {LATE} AND outcome IN (1, 2, 3)
UNION ALL SELECT 'paid_up', wave, paid, CASE WHEN paid = 1 THEN 1.0 ELSE 0.0 END, wt FROM sheets
UNION ALL SELECT 'discount', wave, cut * 10, 0.0, wt_units FROM sheets WHERE wave = {EARLY}
UNION ALL SELECT 'discount', wave, cut, 0.0, wt_units FROM sheets WHERE wave = {LATE}),
domains AS (
SELECT canonical, wave, CASE WHEN count(DISTINCT v) <= 12 AND max(v) <= 20 THEN 'categorical' ELSE 'continuous' END
       AS encoding, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi, count(DISTINCT v) AS cardinality
FROM answers GROUP BY canonical, wave),
wave_names(canonical, wave, variable) AS {_values([(e.canonical, e.wave, e.variable) for e in WAVES])},
wave_columns(wave, used) AS {_values([(w, c) for w, names in WAVE_COLUMNS.items() for c in names.split()])}"""

VALID = {
    "outcome": "outcome IN (1, 2, 3)", "paid": "paid IN (0, 1)", "refund": "refund IN (0, 1, 2)",
    "wait": "wait BETWEEN 1 AND 50", "spend": "spend BETWEEN 0 AND 105", "cut": "cut BETWEEN 0 AND 10",
}
YES = {"outcome": "outcome = 3", "paid": "paid = 1", "refund": "refund IN (1, 2)", "cut": "cut IN (8, 9, 10)"}
WEIGHT = {"cut": "wt_units"}
BACK, BACK_PAID = "outcome = 3", "outcome = 3 AND paid = 1"
CLAIMABLE = "outcome >= 2 AND outcome <= 3 AND paid = 1"


def with_(parts: list[str], final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


def yes(variable: str) -> str:
    return f"CASE WHEN {YES[variable]} THEN 1.0 ELSE 0.0 END"


def rows(where: str, y: str, g: str = "0", w: str = "wt") -> str:
    return (f"SELECT {g} AS g, CAST({y} AS DOUBLE) AS y, CAST({w} AS DOUBLE) AS w, stratum AS h, cluster AS a "
            f"FROM micro WHERE {where}")


def taylor(source: str, p: str = "t") -> str:
    """Ratio, residual totals per PSU, squared deviations within strata; result table named ``p``."""
    return f"""{p}_r AS (SELECT g, sum(w * y) / sum(w) AS r, sum(w) AS tw, count(w) AS n, avg(y) AS plain,
  count(*) - count(w) AS no_weight, count(w) FILTER (h IS NULL OR a IS NULL) AS no_design,
  count(DISTINCT h * 1000 + a) FILTER (w IS NOT NULL) AS n_psu, count(DISTINCT h) FILTER (w IS NOT NULL AND a IS NOT NULL) AS n_strata
  FROM {source} GROUP BY g),
{p}_p AS (SELECT d.g, d.h, d.a, sum(d.w * (d.y - q.r)) AS z FROM {source} d JOIN {p}_r q ON d.g = q.g
  WHERE d.w IS NOT NULL AND d.h IS NOT NULL AND d.a IS NOT NULL GROUP BY d.g, d.h, d.a),
{p}_s AS (SELECT g, h, count(*) AS nh, avg(z) AS zbar FROM {p}_p GROUP BY g, h),
{p}_v AS (SELECT x.g, sum(CASE WHEN nh > 1 THEN nh / (nh - 1.0) * (z - zbar) * (z - zbar) ELSE 0 END) AS ss
  FROM {p}_p x JOIN {p}_s s ON x.g = s.g AND x.h = s.h GROUP BY x.g),
{p} AS (SELECT q.g, r, plain, tw, n, n_psu, n_strata, no_weight, no_design, ss / (tw * tw) AS var, sqrt(ss) / tw AS se,
  r - 1.96 * sqrt(ss) / tw AS lci, r + 1.96 * sqrt(ss) / tw AS uci
  FROM {p}_r q JOIN {p}_v v ON q.g = v.g)"""


def midpoints(source: str, name: str, w: str = "w") -> str:
    return (f"{name} AS (SELECT g, y, (sum({w}) OVER (PARTITION BY g ORDER BY y, w ROWS UNBOUNDED PRECEDING) "
            f"- 0.5 * {w}) / sum({w}) OVER (PARTITION BY g) AS k FROM {source} WHERE {w} IS NOT NULL)")


def lookup(q: str, alias: str) -> str:
    """Piecewise linear lookup as an aggregate over knots."""
    x0, y0 = f"max(k) FILTER (k <= {q})", f"max(y) FILTER (k <= {q})"
    x1, y1 = f"min(k) FILTER (k > {q})", f"min(y) FILTER (k > {q})"
    return (f"CASE WHEN {x0} IS NULL THEN {y1} WHEN {x1} IS NULL THEN {y0} "
            f"ELSE {y0} + (max({q}) - {x0}) * ({y1} - {y0}) / ({x1} - {x0}) END AS {alias}")


def woodruff(source: str, q: str, p: str = "wq") -> list[str]:
    """``q`` is an expression over g; result table named ``p``."""
    return [
        midpoints(source, f"{p}_m"),
        f"{p}_e AS (SELECT g, {lookup(q, 'point')} FROM {p}_m GROUP BY g)",
        f"{p}_d AS (SELECT d.g, CASE WHEN y <= point THEN 1.0 ELSE 0.0 END AS y, w, h, a FROM {source} d "
        f"JOIN {p}_e e ON d.g = e.g)",
        taylor(f"{p}_d", f"{p}_t"),
        f"{p}_b AS (SELECT g, y, k, greatest(0.0, {q} - 1.96 * se) AS q0, least(1.0, {q} + 1.96 * se) AS q1 "
        f"FROM {p}_m m JOIN (SELECT g, se FROM {p}_t) t USING (g))",
        f"{p}_c AS (SELECT g, {lookup('q0', 'lci')}, {lookup('q1', 'uci')} FROM {p}_b GROUP BY g)",
        f"{p} AS (SELECT e.g, point, se, c.lci, c.uci, tw, n, n_psu, n_strata, no_weight, no_design FROM {p}_e e JOIN {p}_t t ON e.g = t.g "
        f"JOIN {p}_c c ON e.g = c.g)",
    ]


ORACLES: dict[str, str] = {}


def _sources() -> None:
    ORACLES["scan_csv"] = with_([MICRO], "SELECT outcome, count(*) AS n, round(sum(wt), 4) AS sum_wt FROM micro GROUP BY outcome")
    ORACLES["scan_parquet"] = (
        "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 4) AS sum_price FROM lineitem GROUP BY 1")
    ORACLES["materialize_parquet"] = with_([MICRO], """SELECT quarter, count(*) AS n, count(refund) AS n_refund,
        round(sum(wt), 4) AS sum_wt, CAST(sum(wait) AS BIGINT) AS wait_total FROM micro GROUP BY quarter""")
    ORACLES["load_microdata"] = with_([MICRO], """SELECT yr, count(*) AS n, count(wait) AS n_wait,
        CAST(sum(cut) AS BIGINT) AS cut_total FROM micro GROUP BY yr""")
    asked = {c: " OR ".join(f"wave = {w}" for w, names in WAVE_COLUMNS.items() if c in names.split()) for c in ("result", "outcome", "cut", "cut_pm", "paid")}
    source = {"cut_pm": "cut"}
    ORACLES["scan_waves"] = with_([MICRO, WAVE_TABLES], "SELECT CAST(wave AS INT) AS wave, count(*) AS n, " + ", ".join(
        f"count({source.get(c, c)}) FILTER ({holds}) AS n_{c}" for c, holds in asked.items()) + " FROM sheets GROUP BY wave")
    parts = []
    for name in [*VALID, "quarter"]:
        known = name in VALID
        valid = VALID.get(name, "NULL")
        codes = len(CATALOG[name].valid) if known else "NULL"
        parts.append(
            f"SELECT '{name}' AS variable, {str(not known).lower()} AS is_unknown, CAST({codes} AS INT) AS codes, "
            + (f"CAST(nullif(count(*) FILTER ({valid}), 0) AS BIGINT) AS substantive, "
               f"CAST(nullif(count(*) FILTER (NOT ({valid})), 0) AS BIGINT) AS reserved, " if known else
               "CAST(NULL AS BIGINT) AS substantive, CAST(NULL AS BIGINT) AS reserved, ")
            + f"CAST(nullif(count(*) FILTER ({name} IS NULL), 0) AS BIGINT) AS missing FROM micro")
    ORACLES["load_variables"] = with_([MICRO], " UNION ALL ".join(parts))
    entries = ", ".join(f"('{e.canonical}', {e.wave}, '{e.weight}', '{e.encoding}', {len(e.valid)})" for e in WAVES)
    ORACLES["load_wave_variables"] = with_(
        [MICRO, WAVE_TABLES, f"meta(canonical, wave, weight, encoding, codes) AS (VALUES {entries})"],
        """SELECT m.canonical, m.wave, n.variable, m.weight, m.encoding, m.codes, count(*) AS answers
        FROM meta m JOIN wave_names n ON m.canonical = n.canonical AND m.wave = n.wave
        JOIN answers a ON m.canonical = a.canonical AND m.wave = a.wave GROUP BY ALL""")


def _filters() -> None:
    mixed = "(((refund IS NULL OR refund <> 2) AND outcome = 3) OR (paid = 1 AND wait >= 30))"
    ORACLES["filter_universe"] = with_([MICRO], f"""SELECT yr, count(*) AS n, round(sum(wt), 4) AS sum_wt FROM micro
        WHERE {mixed} GROUP BY yr""")
    counted = ["spend <= 40", "cut > 6", "(cut > 2 AND cut <= 7) OR quarter <> 4", "spend <> 12.5",
               "wt >= 300 OR (qty < 3 AND refund = 2)"]
    parts = [f"SELECT CAST({i} AS INT) AS probe, true AS accepted, count(*) FILTER ({c}) AS n FROM micro"
             for i, c in enumerate(counted)]
    parts += [f"SELECT {i}, false, NULL" for i in range(len(counted), len(Q.PROBES))]
    ORACLES["validate_universe"] = with_([MICRO], " UNION ALL ".join(parts))
    ORACLES["filter_valid_codes"] = with_([MICRO], f"""SELECT yr, count(*) AS n, CAST(sum(wait) AS BIGINT) AS wait_total
        FROM micro WHERE {VALID['wait']} GROUP BY yr""")
    ORACLES["substantive_rows"] = with_([MICRO], f"""SELECT refund, count(*) AS n, round(sum(wt), 4) AS sum_wt FROM micro
        WHERE {CLAIMABLE} AND {VALID['refund']} GROUP BY refund""")
    ORACLES["affirmative_flag"] = with_([MICRO], f"""SELECT yr, round(sum(f), 4) AS sum_flag, round(avg(f), 6) AS share
        FROM (SELECT yr, CAST({yes('refund')} AS DOUBLE) AS f FROM micro) GROUP BY yr""")
    ORACLES["threshold_flag"] = with_([MICRO], f"""SELECT quarter, round(sum(f), 4) AS sum_flag,
        round(sum(wt * f) / sum(wt), 6) AS share FROM (SELECT quarter, wt,
        CAST(CASE WHEN wait <= 20 THEN 1 ELSE 0 END AS DOUBLE) AS f FROM micro
        WHERE {BACK} AND wt IS NOT NULL AND {VALID['wait']}) GROUP BY quarter""")
    ORACLES["drop_reserved_codes"] = with_([MICRO], """SELECT wait, count(*) AS n FROM micro WHERE wait NOT IN
        (7, 8, 9, 77, 88, 96, 97, 98, 99, 996, 997, 998, 999) GROUP BY wait""")
    ORACLES["integer_like_only"] = with_([MICRO], """SELECT yr, count(*) AS n, round(sum(wt), 4) AS sum_wt FROM micro
        WHERE wt = floor(wt) GROUP BY yr""")
    ORACLES["rows_inspect"] = with_([MICRO], """SELECT resp_id, wait, wt, quarter FROM micro WHERE outcome = 3
        ORDER BY resp_id, wt NULLS FIRST, wait NULLS FIRST, quarter LIMIT 25""")


def _estimates() -> None:
    def share(where: str, w: str = "wt") -> str:
        return with_([MICRO, f"d AS ({rows(where, yes('refund'), w=w)})"], """SELECT
            round(100 * sum(w * y) / sum(w), 6) AS value_pct, count(w) FILTER (y = 1) AS n_numerator,
            count(w) AS n_denominator, round(sum(w), 4) AS denominator_weighted,
            count(*) - count(w) AS n_dropped_weight FROM d""")

    ORACLES["prevalence_weighted"] = share(f"{BACK_PAID} AND {VALID['refund']}")
    ORACLES["prevalence_unweighted"] = share(f"{BACK_PAID} AND {VALID['refund']}", "1")
    ORACLES["prevalence_all_in_universe"] = share("true", "1")
    ORACLES["prevalence_registry"] = share(f"{CLAIMABLE} AND {VALID['refund']}")

    def mean(where: str, y: str, w: str = "wt") -> str:
        return with_([MICRO, f"d AS ({rows(where, y, w=w)})"], """SELECT round(sum(w * y) / sum(w), 6) AS value,
            count(w) AS n, round(sum(w), 4) AS denominator_weighted, count(*) - count(w) AS n_dropped_weight FROM d""")

    ORACLES["mean_weighted"] = mean(f"quarter = 2 AND {VALID['spend']}", "spend")
    ORACLES["mean_unweighted"] = mean(f"quarter = 2 AND {VALID['spend']}", "spend", "1")
    ORACLES["mean_registry"] = mean(VALID["cut"], "cut", "wt_units")

    def quantile(where: str, y: str, q: float, w: str = "wt") -> str:
        return with_(
            [MICRO, f"d AS ({rows(where, y, w=w)})", midpoints("d", "m"),
             f"e AS (SELECT g, {lookup(str(q), 'value')} FROM m GROUP BY g)",
             "c AS (SELECT g, count(w) AS n, sum(w) AS tw, count(*) - count(w) AS no_weight FROM d GROUP BY g)"],
            """SELECT round(value, 6) AS value, n, round(tw, 4) AS denominator_weighted,
            no_weight AS n_dropped_weight FROM e JOIN c ON e.g = c.g""")

    ORACLES["quantile_weighted"] = quantile(f"quarter = 2 AND {VALID['spend']}", "spend", 0.37)
    ORACLES["quantile_unweighted"] = quantile(f"quarter = 2 AND {VALID['spend']}", "spend", 0.37, "1")
    ORACLES["quantile_registry"] = quantile(f"{BACK} AND {VALID['wait']}", "wait", 0.9)

    counts = """n, round(tw, 4) AS denominator_weighted, n_psu, n_strata, no_weight AS n_dropped_weight,
        no_design AS n_dropped_design"""

    def share_ci(where: str, y: str = "refund") -> str:
        return with_([MICRO, f"d AS ({rows(where, yes(y))})", taylor("d")], f"""SELECT round(100 * r, 6) AS estimate,
            round(100 * se, 6) AS se, round(100 * lci, 6) AS lci, round(100 * uci, 6) AS uci,
            round(var / (r * (1 - r) / n), 6) AS deff,
            round(196 * sqrt(r * (1 - r) / n), 6) AS srs_half_width, {counts} FROM t""")

    ORACLES["ci_prevalence"] = share_ci(f"{BACK_PAID} AND {VALID['refund']}")
    ORACLES["ci_prevalence_registry"] = share_ci(f"{CLAIMABLE} AND {VALID['refund']}")
    ORACLES["design_effect"] = with_(
        [MICRO, f"d AS ({rows(VALID['paid'], yes('paid'), 'yr')})", taylor("d")],
        "SELECT g AS yr, round(100 * r, 6) AS estimate, round(var / (r * (1 - r) / n), 6) AS deff FROM t")
    ORACLES["design_counts"] = with_(
        [MICRO, f"d AS ({rows('quarter = 1 AND ' + VALID['cut'], 'cut', 'yr')})", taylor("d")],
        "SELECT g AS yr, n, n_psu, n_strata, round(tw, 4) AS denominator_weighted FROM t")
    ORACLES["psu_variance"] = with_(
        [MICRO, f"d AS ({rows(VALID['spend'], 'spend')})", taylor("d")],
        "SELECT round(var, 6) AS variance, n_psu, n_strata FROM t")
    ORACLES["ci_mean"] = with_(
        [MICRO, f"d AS ({rows(BACK + ' AND ' + VALID['wait'], 'wait')})", taylor("d")],
        f"""SELECT round(r, 6) AS estimate, round(se, 6) AS se, round(lci, 6) AS lci, round(uci, 6) AS uci,
        {counts} FROM t""")
    ORACLES["ci_quantile"] = with_(
        [MICRO, f"d AS ({rows(VALID['spend'], 'spend')})", *woodruff("d", "0.37")],
        f"""SELECT round(point, 6) AS estimate, round(se, 6) AS se, round(lci, 6) AS lci, round(uci, 6) AS uci,
        {counts} FROM wq""")
    ORACLES["ci_srs"] = with_(
        [MICRO, f"d AS ({rows(BACK_PAID + ' AND ' + VALID['refund'], yes('refund'))})", taylor("d")],
        """SELECT round(196 * sqrt(r * (1 - r) / n), 6) AS srs_half_width,
        round(100 * (uci - lci) / 2, 6) AS design_half_width FROM t""")

    def fixed(variable: str, universe: str | None, stat: str, q: float | None, unit: str) -> str:
        return (f"{text(variable)} AS variable, CAST({text(universe)} AS VARCHAR) AS universe, {text(stat)} AS stat, "
                f"CAST({q if q is not None else 'NULL'} AS DOUBLE) AS q, {text(unit)} AS unit")

    pct = """round(100 * r, 6) AS estimate, round(100 * lci, 6) AS lci, round(100 * uci, 6) AS uci,
        round(100 * se, 6) AS se, n, round(tw, 4) AS denominator_weighted, 'wt' AS weight"""
    raw = pct.replace("100 * ", "")
    sent_back = "outcome == 3"
    ORACLES["subpopulation_stat"] = with_(
        [MICRO, f"d AS ({rows('outcome = 3 AND quarter = 2 AND ' + VALID['refund'], yes('refund'))})", taylor("d")],
        f"""SELECT {fixed('refund', 'outcome == 3 & quarter == 2', 'prevalence', None, '%')}, {pct},
        printf('refund prevalence: %.2f%% (95%% CI %.2f to %.2f; se %.2f; weight wt; universe: outcome == 3 & quarter == 2;'
        || ' n=%d, weighted %s)', 100 * r, 100 * lci, 100 * uci, 100 * se, n, format('{{:,.0f}}', round(tw, 4)))
        AS line FROM t""")
    by_quarter = "quarter IN (1, 2, 3, 4)"
    ORACLES["table_prevalence_by"] = with_(
        [MICRO, f"d AS ({rows(f'{BACK} AND {by_quarter} AND ' + VALID['refund'], yes('refund'), 'CAST(quarter AS BIGINT)')})",
         taylor("d")],
        f"SELECT g AS group_value, {fixed('refund', sent_back, 'prevalence', None, '%')}, {pct}, "
        "'quarter' AS groupby FROM t")
    ORACLES["table_mean_by"] = with_(
        [MICRO, f"d AS ({rows(VALID['cut'] + ' AND ' + VALID['spend'], 'spend', 'CAST(cut AS BIGINT)')})", taylor("d")],
        f"SELECT g AS group_value, {fixed('spend', None, 'mean', None, '')}, {raw}, 'cut' AS groupby FROM t")
    ORACLES["table_quantile_by"] = with_(
        [MICRO, f"d AS ({rows(VALID['outcome'] + ' AND ' + VALID['spend'], 'spend', 'CAST(outcome AS BIGINT)')})",
         *woodruff("d", "0.37")],
        f"""SELECT g AS group_value, {fixed('spend', None, 'quantile', 0.37, '')},
        {raw.replace('round(r, 6)', 'round(point, 6)')}, 'outcome' AS groupby FROM wq""")
    ORACLES["group_values"] = with_([MICRO], f"""
        SELECT CAST(cut AS BIGINT) AS group_value, CAST(cut AS BIGINT) AS place, 'cut' AS "column"
        FROM micro WHERE {VALID['cut']} GROUP BY cut
        UNION ALL SELECT yr, yr, 'yr' FROM micro GROUP BY yr""")
    ORACLES["group_cap"] = with_([MICRO], """
        SELECT count(DISTINCT quarter) AS groups, count(DISTINCT quarter) <= 20 AS within_cap,
        'quarter' AS "column" FROM micro WHERE quarter NOT IN (7, 8, 9)
        UNION ALL SELECT count(DISTINCT qty), count(DISTINCT qty) <= 20, 'qty' FROM micro
        WHERE qty NOT IN (7, 8, 9)""")
    ORACLES["table_text"] = with_(
        [MICRO, f"d AS ({rows(f'{BACK} AND {by_quarter} AND ' + VALID['wait'], 'wait', 'CAST(quarter AS BIGINT)')})",
         taylor("d")],
        """SELECT CAST(NULL AS BIGINT) AS place, 'wait mean by quarter, weight wt, universe: outcome == 3' AS line
        UNION ALL SELECT g, printf('quarter=%d: %.2f (95%% CI %.2f to %.2f; n=%d)', g, r, lci, uci, n) FROM t""")


def _trend_claims() -> list[str]:
    """Tables of the trend claims and their verdicts."""
    parts = [(i, *t[:4], place, *part) for i, t in enumerate(C.TRENDS) for place, part in enumerate(t[4])]
    used_by_year = ", ".join(f"max(used) FILTER (single_variable IS NULL AND year = {w}) AS variable_{w}" for w in (EARLY, MIDDLE, LATE))
    value_by_year = ", ".join(f"max(value) FILTER (year = {w}) AS value_{w}" for w in (EARLY, MIDDLE, LATE))
    right_by_year = ", ".join(f"max(round(pct, 2)) FILTER (NOT refused AND year = {w}) AS right_{w}" for w in (EARLY, MIDDLE, LATE))
    return [
        MICRO, WAVE_TABLES,
        """shares AS (SELECT canonical, wave, 100 * sum(w * yes) / sum(w) AS pct, count(w) FILTER (yes = 1) AS n1,
        count(w) AS n, sum(w) AS tw FROM answers GROUP BY canonical, wave)""",
        f"""treports(report, canonical, single_variable, seeded_defect, title, place, year, used, stated, shift) AS {_values(parts)}""",
        f"""tyears AS (SELECT 'trend_s' || s_suppkey AS id, s_suppkey AS s, t.canonical, single_variable, seeded_defect, title || ', supplier ' || s_suppkey AS title,
        CAST(place AS INT) AS place, CAST(year AS INT) AS year, used, round(coalesce(pct, 0) + CAST(shift AS DOUBLE), 2) AS value
        FROM supplier JOIN treports t ON s_suppkey % {len(C.TRENDS)} = report
        LEFT JOIN shares h ON h.canonical = t.canonical AND h.wave = t.stated)""",
        f"""tclaims AS (SELECT id, s, canonical, single_variable, seeded_defect, title, string_agg(CAST(year AS VARCHAR), ',' ORDER BY place) AS years,
        {used_by_year}, {value_by_year} FROM tyears GROUP BY ALL)""",
        """tgaps AS (SELECT y.id, y.year, y.place, y.used, n.variable AS right_variable FROM tyears y
        LEFT JOIN wave_names n ON y.canonical = n.canonical AND y.year = n.wave
        WHERE NOT EXISTS (SELECT 1 FROM wave_columns c WHERE c.wave = y.year AND c.used = y.used))""",
        """tguard AS (SELECT id, count(DISTINCT encoding) AS encodings, max(lo) AS max_lo, min(hi) AS min_hi,
        string_agg(printf('%d %s is %s (%.0f to %.0f, %d values)', y.year, n.variable, encoding, lo, hi, cardinality),
          ', ' ORDER BY place) AS shown
        FROM tyears y JOIN domains d ON y.canonical = d.canonical AND y.year = d.wave
        JOIN wave_names n ON y.canonical = n.canonical AND y.year = n.wave GROUP BY id)""",
        """tguarded AS (SELECT id, encodings, max_lo, min_hi, encodings > 1 OR max_lo > min_hi AS refused,
        CASE WHEN encodings > 1 OR max_lo > min_hi THEN 'the waves use different scales: ' || shown
          || '; no trend can be computed' END AS guard FROM tguard)""",
        """tmessages AS (
        SELECT g.id, 1 AS step, place, printf('%d: column %s is not in this wave, it was renamed; the right column is %s',
          year, used, coalesce(right_variable, 'unknown')) AS msg FROM tgaps g
        UNION ALL SELECT id, 2, 0, guard FROM tguarded WHERE refused
        UNION ALL SELECT y.id, 3, place, printf('%d: claimed %.2f%%, right is %.2f%%, tolerance 0.30', year, value,
          round(pct, 2)) FROM tyears y JOIN shares s ON y.canonical = s.canonical AND y.year = s.wave
          JOIN tguarded g ON y.id = g.id WHERE NOT refused AND abs(value - round(pct, 2)) > 0.3)""",
        """tfound AS (SELECT id, string_agg(msg, '; ' ORDER BY step, place) AS diagnosis FROM tmessages GROUP BY id)""",
        f"""tright AS (SELECT y.id, {right_by_year},
          '{{' || string_agg(printf('%d: %.2f', year, round(pct, 2)), ', ' ORDER BY place) || '}}' AS shown,
          string_agg(printf('| %d | %.2f%% |', year, round(pct, 2)), chr(10) ORDER BY place) AS lines
          FROM tyears y JOIN tguarded g ON y.id = g.id LEFT JOIN shares s ON y.canonical = s.canonical AND y.year = s.wave GROUP BY y.id)""",
        """tverdicts AS (SELECT c.*, CASE WHEN f.id IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict, coalesce(diagnosis, '') AS diagnosis,
          r.* EXCLUDE (id) FROM tclaims c LEFT JOIN tfound f ON c.id = f.id JOIN tright r ON c.id = r.id)""",
    ]


def _trends() -> None:
    base = _trend_claims()
    ORACLES["trend_prevalence"] = with_(base, """SELECT wave, round(pct, 6) AS value_pct, n1 AS n_numerator,
        n AS n_denominator, round(tw, 4) AS denominator_weighted FROM shares WHERE canonical = 'sent_back'""")
    ORACLES["partition_waves"] = ORACLES["trend_prevalence"]
    columns = ", ".join(f"{kind}_{w}" for kind in ("variable", "value") for w in (EARLY, MIDDLE, LATE))
    ORACLES["load_trend_claims"] = with_(base, f"""SELECT id, canonical, years, single_variable, CAST(0.3 AS DOUBLE) AS tolerance,
        seeded_defect, {columns} FROM tclaims""")
    ORACLES["rename_gap"] = with_(base, "SELECT id, year, place, used, right_variable FROM tgaps")
    ORACLES["empirical_domain"] = with_(base, """SELECT d.canonical, d.wave, n.variable, encoding, lo, hi, cardinality
        FROM domains d JOIN wave_names n ON d.canonical = n.canonical AND d.wave = n.wave""")
    ORACLES["encoding_guard"] = with_(base, """SELECT id, CAST(encodings AS INT) AS encodings, max_lo, min_hi, refused,
        guard FROM tguarded""")
    ORACLES["verify_trend"] = with_(base, f"""SELECT id, verdict, true AS lint_ok, verdict = 'FAIL' AS caught, diagnosis,
        {", ".join(f"right_{w}" for w in (EARLY, MIDDLE, LATE))} FROM tverdicts""")
    ORACLES["trend_years_available"] = with_(base, f"""
        SELECT CAST(0 AS BIGINT) AS missing, true AS available, CAST(0 AS BIGINT) AS waiting, 'all' AS waves
        UNION ALL SELECT count(DISTINCT year), count(*) = 0, count(DISTINCT id), 'last only' FROM tyears WHERE year <> {LATE}""")


_SQL_UNIVERSE = {None: "true", SENT_BACK: BACK, PAID_BACK: BACK_PAID, MAY_CLAIM: CLAIMABLE}


def _estimate_tables() -> list[str]:
    """``est``: one row per domain with interval and flawed variants, in percent or the variable's unit."""
    ratio, kept, quant, quant_kept = [], [], [], []
    for yearly, domains in ((False, C.BASE_DOMAINS), (True, C.YEAR_DOMAINS)):
        for d in domains:
            inside, key = _SQL_UNIVERSE[d.universe], text(d.key)
            if yearly:
                front = f"{d.kind}|{d.variable}|" + (f"{d.universe} & " if d.universe else "")
                key = f"{text(front)} || 'yr == ' || yr || {text('|' + d.key.rsplit('|', 1)[1])}"
            w, sound = WEIGHT.get(d.variable, "wt"), f"{inside} AND {VALID[d.variable]}"
            whole = f"{inside} AND {d.variable} IS NOT NULL"
            if d.kind == "prevalence":
                ratio.append(rows(sound, yes(d.variable), key, w))
                kept.append(rows(sound, yes(d.variable), key, w))
            elif d.kind == "mean":
                ratio.append(rows(sound, d.variable, key, w))
                kept.append(rows(whole, d.variable, key, w))
            else:
                quant.append(rows(sound, d.variable, key, w))
                quant_kept.append(rows(whole, d.variable, key, w))
    q = "CAST(split_part(g, '|', 4) AS DOUBLE)"
    union = " UNION ALL ".join
    return [
        f"dr AS ({union(ratio)})", f"dk AS ({union(kept)})", f"dq AS ({union(quant)})", f"dqk AS ({union(quant_kept)})",
        taylor("dr"), "rk AS (SELECT g, sum(w * y) / sum(w) AS kept FROM dk GROUP BY g)",
        *woodruff("dq", q, "wq"),
        "dq1 AS (SELECT g, y, 1.0 AS w FROM dq)", midpoints("dq1", "mu"), midpoints("dqk", "mk"),
        f"qu AS (SELECT g, {lookup(q, 'plain')} FROM mu GROUP BY g)",
        f"qk AS (SELECT g, {lookup(q, 'kept')} FROM mk GROUP BY g)",
        """est AS MATERIALIZED (
        SELECT t.g AS domain_key, f * r AS estimate, f * se AS se, f * lci AS lci, f * uci AS uci,
          f * plain AS unweighted, f * kept AS reserved_kept,
          CASE WHEN f = 100 THEN var / (r * (1 - r) / n) END AS deff, n, tw, n_psu, n_strata
        FROM (SELECT *, CASE WHEN g LIKE 'prevalence%' THEN 100 ELSE 1 END AS f FROM t) t JOIN rk ON t.g = rk.g
        UNION ALL SELECT wq.g, point, se, lci, uci, plain, kept, NULL, n, tw, n_psu, n_strata
        FROM wq JOIN qu ON wq.g = qu.g JOIN qk ON wq.g = qk.g)""",
    ]


def _claim_tables() -> list[str]:
    """``claims`` and ``verdicts``."""
    names = "id, variable, label, universe, seeded, link, prose, statistic, kind, q, unit, method, weighted, tolerance, source, figure, shift, width"
    choices = [(i, j, len(flaws), *astuple(s)) for i, flaws in enumerate(C.REPORTS) for j, s in enumerate(flaws)]
    n, years = len(C.REPORTS), len(C.YEARS)
    retained = " UNION ALL ".join(
        f"SELECT '{v}' AS variable, coalesce(string_agg(CAST(c AS VARCHAR), ', ' ORDER BY c), '') AS codes FROM "
        f"(SELECT DISTINCT {v} AS c FROM micro WHERE NOT ({VALID[v]}))" for v in ("wait", "spend", "cut"))
    meta = _values([(v.name, v.universe, v.universe_text, v.weight) for v in CATALOG])
    known = ", ".join(text(x) for x in sorted({v.name for v in CATALOG} | {s.id for s in C.SPECS}))
    with_year = "coalesce({0} || ' & yr == ' || yr, 'yr == ' || yr)"
    return [
        MICRO, *_estimate_tables(),
        f"meta(variable, question_universe, universe_text, weight) AS {meta}",
        f"whole({names}) AS {_values([astuple(s) for s in C.SPECS])}",
        f"choices(report, flaw, flaws, {names}) AS {_values(choices)}",
        f"""reports AS (SELECT *, {C.YEARS[0]} + s_suppkey % {years} AS yr FROM supplier
        JOIN choices ON s_suppkey % {n} = report AND (s_suppkey // {n}) % flaws = flaw)""",
        f"""specs AS (SELECT {names} FROM whole
        UNION ALL SELECT id || '_s' || s_suppkey, variable, label || ', ' || yr || ', supplier ' || s_suppkey, {with_year.format('universe')}, seeded, link,
          'Reported by supplier ' || s_suppkey || ' for ' || yr || '. Compare [[' || link || ']].', statistic, kind, q, unit,
          CASE WHEN source = '{C.NAIVE}' THEN 'yr == ' || yr ELSE {with_year.format('method')} END, weighted, tolerance,
          CASE WHEN source = '{C.NAIVE}' THEN '{C.NAIVE}|' || yr ELSE kind || '|' || variable || '|' || {with_year.format('universe')} || '|'
            || CASE WHEN q IS NULL THEN '' ELSE printf('%.6f', CAST(q AS DOUBLE)) END END, figure, shift, width FROM reports)""",
        f"""figures AS (
        SELECT domain_key AS source, 'estimate' AS figure, estimate AS value, (uci - lci) / 2 AS half FROM est
        UNION ALL SELECT domain_key, 'unweighted', unweighted, (uci - lci) / 2 FROM est
        UNION ALL SELECT domain_key, 'reserved_kept', reserved_kept, (uci - lci) / 2 FROM est
        UNION ALL SELECT '{C.NAIVE}', 'estimate', 100.0 * count(*) FILTER (refund IN (1, 2)) / count(*), NULL FROM micro
        UNION ALL SELECT '{C.NAIVE}|' || yr, 'estimate', 100.0 * count(*) FILTER (refund IN (1, 2)) / count(*), NULL FROM micro GROUP BY yr)""",
        """claims0 AS (SELECT id, s.variable, label, universe AS analytical_universe, coalesce(link, '') AS links, trim(prose) AS prose,
        coalesce(statistic, '') AS statistic, coalesce(kind, 'prevalence') AS kind, CAST(q AS DOUBLE) AS q, coalesce(unit, '%') AS unit,
        method AS method_universe, CASE WHEN s.source IS NOT NULL THEN weighted END AS mw, coalesce(tolerance, 0.5) AS tolerance,
        seeded AND (width IS NULL OR (1 - width) * half > 0.1) AS seeded_defect,
        round(value + shift, 2) AS claimed, round(value + shift - width * half, 2) AS claimed_low, round(value + shift + width * half, 2) AS claimed_high,
        coalesce(universe, question_universe) AS right_universe, universe_text, weight
        FROM specs s JOIN meta m ON s.variable = m.variable LEFT JOIN figures f ON s.source = f.source AND s.figure = f.figure)""",
        """claims AS (SELECT *, kind || '|' || variable || '|' || coalesce(right_universe, '') || '|'
          || CASE WHEN q IS NULL THEN '' ELSE printf('%.6f', q) END AS right_key FROM claims0)""",
        f"retained AS ({retained})",
        f"""lint AS (SELECT id, concat_ws('; ', CASE WHEN prose = '' THEN 'there is no text' END,
        CASE WHEN links <> '' AND links NOT IN ({known}) THEN 'link to nothing: ' || links END) AS lint_messages FROM claims c)""",
        """judged AS (SELECT c.*, e.estimate, e.se, e.lci, e.uci, e.deff, e.unweighted, e.reserved_kept, lint_messages,
        r.codes, abs(claimed - estimate) > tolerance AS off,
        concat_ws('; ', CASE WHEN NOT mw THEN 'rows were counted without the weight ' || weight END,
          CASE WHEN mw IS NOT NULL AND method_universe IS DISTINCT FROM right_universe THEN printf('figures are about %s, but should be about %s',
            coalesce(method_universe, 'all rows'), coalesce(right_universe, 'everybody')) END) AS method_text,
        CASE WHEN (claimed_high - claimed_low) / 2 < (uci - lci) / 2 - 0.1 THEN printf('the interval claims %.2f to'
          || ' either side where strata and clusters give %.2f (design effect %.2f)',
          (claimed_high - claimed_low) / 2, (uci - lci) / 2, deff) ELSE '' END AS ci_text,
        CASE WHEN abs(claimed - reserved_kept) <= tolerance AND abs(reserved_kept - estimate) > tolerance
          THEN abs(claimed - reserved_kept) END AS gap_kept,
        CASE WHEN abs(claimed - unweighted) <= tolerance AND abs(unweighted - estimate) > tolerance
          THEN abs(claimed - unweighted) END AS gap_plain
        FROM claims c LEFT JOIN est e ON c.right_key = e.domain_key LEFT JOIN lint l ON c.id = l.id
        LEFT JOIN retained r ON c.variable = r.variable)""",
        """variants AS (SELECT *, CASE WHEN gap_kept IS NULL AND gap_plain IS NULL THEN NULL
          WHEN gap_plain IS NULL OR gap_kept <= gap_plain THEN 'reserved_kept' ELSE 'unweighted' END AS variant
        FROM judged)""",
        """messages AS (SELECT *,
        coalesce(nullif(concat_ws('; ', nullif(method_text, ''), CASE variant
          WHEN 'unweighted' THEN printf('the claimed %.2f equals the unweighted estimate %.2f, not the weighted %.2f',
            claimed, unweighted, estimate)
          WHEN 'reserved_kept' THEN printf('the claimed %.2f keeps reserved codes (%s); without them the value is %.2f',
            claimed, coalesce(nullif(codes, ''), 'outside the valid codes'), estimate) END), ''),
          printf('the claimed %.2f differs from the right value %.2f', claimed, estimate)) AS continuous_text,
        coalesce(nullif(method_text, ''), printf('the claimed %.2f differs from the right value %.2f', claimed, estimate))
          AS share_text FROM variants)""",
        """diagnosed AS (SELECT *, CASE WHEN claimed IS NULL THEN ''
          WHEN kind = 'prevalence' THEN concat_ws('; ', CASE WHEN off THEN share_text END, nullif(ci_text, ''))
          WHEN off THEN continuous_text ELSE '' END AS diagnosis FROM messages)""",
        """verdicts AS MATERIALIZED (SELECT *, lint_messages = '' AS lint_ok,
        CASE WHEN claimed IS NULL THEN CASE WHEN lint_messages = '' THEN 'DESCRIPTIVE' ELSE 'FAIL' END
          WHEN diagnosis = '' THEN 'PASS' ELSE 'FAIL' END AS verdict,
        CASE WHEN claimed IS NOT NULL THEN round(estimate, 2) END AS right_value,
        round(abs(claimed - estimate), 2) AS delta,
        CASE WHEN claimed IS NULL THEN NULL
          WHEN kind = 'prevalence' THEN printf('%.2f%% (95%% CI %.2f to %.2f; design-based SE %.2f, DEFF %.2f)',
            estimate, lci, uci, se, deff)
          ELSE printf('%.2f (95%% CI %.2f to %.2f; design-based SE %.2f)', estimate, lci, uci, se) END AS detail
        FROM diagnosed)""",
    ]


def _claims() -> None:
    base = _claim_tables()
    caught = "verdict = 'FAIL' AND lint_ok"
    ORACLES["malformed_claims"] = """SELECT 'P' || p_partkey AS id, CASE WHEN p_partkey % 7 IN (1, 2, 3) THEN 'malformed' ELSE 'read' END AS status,
        CASE WHEN p_partkey % 7 NOT IN (1, 2, 3) THEN CAST(p_size AS DOUBLE) END AS claimed FROM part"""
    ORACLES["load_claims"] = with_(base, """SELECT id, variable, kind, unit, method_universe, mw AS method_weighted,
        claimed, CAST(tolerance AS DOUBLE) AS tolerance, claimed_low, claimed_high, links, seeded_defect FROM claims""")
    ORACLES["batch_estimate"] = with_(base, """SELECT domain_key, split_part(domain_key, '|', 2) AS variable,
        split_part(domain_key, '|', 1) AS kind, round(estimate, 6) AS estimate, round(se, 6) AS se, round(lci, 6) AS lci,
        round(uci, 6) AS uci, round(unweighted, 6) AS unweighted, round(reserved_kept, 6) AS reserved_kept,
        round(deff, 6) AS deff, n, round(tw, 4) AS denominator_weighted, n_psu, n_strata,
        nullif(regexp_extract(domain_key, '^[^|]*[|][^|]*[|](.*)[|]([^|]*)$', 1), '') AS universe,
        CAST(nullif(regexp_extract(domain_key, '^[^|]*[|][^|]*[|](.*)[|]([^|]*)$', 2), '') AS DOUBLE) AS q,
        coalesce(CASE WHEN domain_key NOT LIKE 'prevalence%' THEN codes END, '') AS retained_codes
        FROM est LEFT JOIN retained r ON split_part(domain_key, '|', 2) = r.variable""")
    ORACLES["lint_claims"] = with_(base, "SELECT id, lint_ok, lint_messages FROM verdicts")
    columns = "id, verdict, claimed, right_value, delta, diagnosis, detail"
    ORACLES["verify_prevalence_claims"] = with_(base, f"""SELECT {columns}, round(lci, 6) AS lci, round(uci, 6) AS uci,
        round(se, 6) AS se, round(deff, 6) AS deff FROM verdicts WHERE kind = 'prevalence' AND claimed IS NOT NULL""")
    ORACLES["verify_continuous_claims"] = with_(base, f"SELECT {columns} FROM verdicts WHERE kind <> 'prevalence'")
    ORACLES["verify_all_claims"] = with_(base, f"""SELECT id, verdict, lint_ok, {caught} AS caught, claimed, right_value,
        delta, diagnosis FROM verdicts""")
    ORACLES["diagnose_method"] = with_(base, "SELECT id, method_text AS diagnosis FROM judged WHERE claimed IS NOT NULL")
    ORACLES["ci_precision_check"] = with_(base, """SELECT id, round((claimed_high - claimed_low) / 2, 6) AS claimed_half,
        round((uci - lci) / 2, 6) AS design_half, ci_text AS diagnosis FROM judged WHERE claimed_low IS NOT NULL""")
    ORACLES["diagnose_continuous"] = with_(base, """SELECT id, CASE WHEN off THEN variant END AS variant,
        CASE WHEN off THEN continuous_text ELSE '' END AS diagnosis FROM messages
        WHERE kind <> 'prevalence' AND claimed IS NOT NULL""")
    ORACLES["closest_variant"] = with_(base, """SELECT id, claimed, round(estimate, 6) AS estimate,
        round(unweighted, 6) AS unweighted, round(reserved_kept, 6) AS reserved_kept, variant FROM variants
        WHERE kind <> 'prevalence' AND claimed IS NOT NULL""")
    observed = " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS observed,
        coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (NOT ({VALID[v].replace(v, 'c')})), '') AS retained
        FROM (SELECT DISTINCT {v} AS c FROM micro WHERE {v} IS NOT NULL)""" for v in ("wait", "cut", "spend"))
    ORACLES["observed_codes"] = with_([MICRO], observed)
    ORACLES["code_counts"] = with_([MICRO], " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, CAST({v} AS BIGINT) AS code, {VALID[v]} AS valid, count(*) AS rows FROM micro
        WHERE {v} IS NOT NULL GROUP BY {v}""" for v in ("outcome", "refund", "wait", "cut", "spend")))
    ORACLES["caught_count"] = with_(base, f"""SELECT count(*) AS claims, count(*) FILTER (verdict = 'PASS') AS passed,
        count(*) FILTER (verdict = 'FAIL') AS failed, count(*) FILTER (verdict = 'DESCRIPTIVE') AS descriptive,
        count(*) FILTER ({caught}) AS caught, count(*) FILTER (verdict = 'FAIL' AND NOT seeded_defect) AS real_failures
        FROM verdicts""")
    both = base + _trend_claims()[1:]
    ORACLES["compile_invariant"] = with_(both, """SELECT bool_and(seeded_defect = (verdict = 'FAIL')) AS ok FROM
        (SELECT seeded_defect, verdict FROM verdicts UNION ALL SELECT seeded_defect, verdict FROM tverdicts)""")
    ORACLES["seeded_defect_catch"] = with_(both, f"""
        SELECT id, verdict, lint_ok, {caught} AS caught, diagnosis FROM verdicts WHERE seeded_defect
        UNION ALL SELECT id, verdict, true, verdict = 'FAIL', diagnosis FROM tverdicts WHERE seeded_defect""")
    ORACLES["publish_bundle"] = with_(both, """
        SELECT id, CASE WHEN verdict = 'FAIL' THEN 'quarantine' ELSE 'published' END AS zone, verdict FROM verdicts
        UNION ALL SELECT id, 'published', verdict FROM tverdicts WHERE verdict <> 'FAIL'""")
    note = """CASE verdict WHEN 'FAIL' THEN CASE WHEN lint_ok THEN 'quarantined, the lint had passed: ' ELSE '' END
        || coalesce(nullif(diagnosis, ''), 'the claim does not match the recomputed result')
        WHEN 'DESCRIPTIVE' THEN 'documented, nothing to recompute' ELSE '' END"""
    ORACLES["audit_log"] = with_(both, f"""
        SELECT 'claims' AS section, id, verdict, coalesce(printf('%.2f', claimed), '-') AS claimed,
        coalesce(printf('%.2f', right_value), '-') AS right_value, coalesce(printf('%.2f', delta), '-') AS delta,
        {note} AS note, true AS timed FROM verdicts
        UNION ALL SELECT 'trends', id, verdict, '-', '-', '-', {note.replace('lint_ok', 'true')}, true
        FROM tverdicts
        UNION ALL SELECT 'malformed', 'all files', 'UNREAD', '-', '-', '-', printf('%d lines are no claims', count(*)),
          CASE WHEN count(*) > 0 THEN true END FROM supplier WHERE s_suppkey % 10 = 7""")


def _doc_tables() -> list[str]:
    """``docs``: rendered documents, and ``specs_out``: how to reproduce them."""
    def link(x: str) -> str:
        return f"regexp_replace({x}, '\\[\\[([A-Za-z0-9_]+)\\]\\]', '[\\1](./\\1.md)', 'g')"

    lines = "chr(10)"
    related = f"CASE WHEN links <> '' THEN concat_ws({lines}, '', 'See [' || links || '](./' || links || '.md)') END"
    return _claim_tables() + _trend_claims()[1:] + [
        """repro AS (SELECT *, array_to_string(CASE WHEN list_contains(names, variable) THEN names ELSE list_append(names, variable) END, ',') AS columns
          FROM (SELECT *, list_sort(list_distinct(regexp_extract_all(coalesce(right_universe, ''), '[A-Za-z_][A-Za-z0-9_]*'))) AS names
          FROM claims WHERE claimed IS NOT NULL))""",
        f"""stamped AS (SELECT strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM lineitem)""",
        """specs_out AS (SELECT id, variable, right_universe AS universe, kind AS stat, CAST(q AS DOUBLE) AS q, columns,
          concat('estimate variable=', variable,
            CASE WHEN right_universe IS NOT NULL THEN ' universe="' || right_universe || '"' END,
            CASE WHEN kind <> 'prevalence' THEN ' stat=' || kind END,
            CASE WHEN q IS NOT NULL THEN printf(' q=%.2f', q) END) AS estimate_call,
          concat('rows columns=', columns,
            CASE WHEN right_universe IS NOT NULL THEN ' universe="' || right_universe || '"' END, ' limit=10') AS rows_call
          FROM repro)""",
        f"""docs0 AS (SELECT v.*, s.estimate_call, s.rows_call, (SELECT stamp FROM stamped) AS stamp,
          replace({link("CASE WHEN claimed IS NOT NULL THEN v.statistic ELSE regexp_replace(split_part(trim(v.prose), '. ', 1), '\\.+$', '') || '.' END")}, '"', '''')
            AS description,
          CASE WHEN claimed IS NOT NULL THEN printf('%.2f', right_value) END AS shown,
          CASE unit WHEN '%' THEN '%' WHEN '' THEN '' ELSE ' ' || unit END AS unit_text
          FROM verdicts v LEFT JOIN specs_out s ON v.id = s.id
          WHERE verdict <> 'FAIL')""",
        f"""cdocs AS (SELECT id, 'variable_definition' AS type, label AS title, description,
          concat_ws(',', variable, CASE WHEN claimed IS NOT NULL THEN kind END) AS tags, variable, statistic, kind,
          right_value AS value, unit, detail, verdict,
          concat_ws({lines}, '---', 'id: ' || id, 'type: variable_definition', 'variable: ' || variable,
            'title: "' || replace(label, '"', '''') || '"',
            CASE WHEN claimed IS NOT NULL THEN concat_ws({lines}, 'value: ' || shown, 'unit: "' || unit || '"',
              'statistic: "' || statistic || '"', 'detail: "' || detail || '"') END,
            CASE WHEN claimed IS NOT NULL AND kind = 'prevalence' THEN
              printf('spread: {{low: %.2f, high: %.2f, se: %.2f, deff: %.2f}}', lci, uci, se, deff) END,
            'asked_of: "' || universe_text || '"', 'figures_about: "' || analytical_universe || '"',
            'source: "{SOURCE}, weight ' || weight || '"',
            'checked: "' || stamp || ' ' || verdict || coalesce(printf(', off by %.2f', CASE WHEN claimed IS NOT NULL THEN delta END), '') || '"',
            '---') AS front_matter,
          concat_ws({lines}, '# ' || label,
            CASE WHEN claimed IS NOT NULL THEN concat_ws({lines}, '', shown || unit_text || ' is the answer to: ' || statistic,
              'In full: ' || detail) END,
            '', {link('prose')},
            CASE WHEN claimed IS NOT NULL THEN concat_ws({lines}, '', '| To get | Run |', '| --- | --- |',
              '| the figure | `' || estimate_call || '` |', '| some rows | `' || rows_call || '` |') END,
            {related}) AS body FROM docs0)""",
        f"""tdocs AS (SELECT id, 'metric' AS type, title, '{C.TREND_STATISTIC}' AS description, 'trend,' || years AS tags,
          CAST(NULL AS VARCHAR) AS variable, '{C.TREND_STATISTIC}' AS statistic, 'trend' AS kind,
          CAST(NULL AS DOUBLE) AS value, '%' AS unit, shown AS detail, verdict,
          concat_ws({lines}, '---', 'id: ' || id, 'type: metric', 'measure: ' || canonical, 'title: "' || title || '"',
            'statistic: "{C.TREND_STATISTIC}"', 'values: ' || shown, 'source: "{SOURCE}"',
            'checked: "' || (SELECT stamp FROM stamped) || ' ' || verdict || '"', '---') AS front_matter,
          concat_ws({lines}, '# ' || title, '', '| Wave | Share |', '| --- | --- |', lines, '',
            'Share in several waves by supplier ' || s || ', see [sent_back](./sent_back.md).',
            'Columns and weights are those of each wave.', '', 'See [sent_back](./sent_back.md)') AS body
          FROM tverdicts WHERE verdict <> 'FAIL')""",
        "docs AS (SELECT * FROM cdocs UNION ALL SELECT * FROM tdocs)",
    ]


def _documents() -> None:
    base = _doc_tables()
    ORACLES["render_concept_docs"] = with_(base, """SELECT id, title, description, tags, value, unit, front_matter, body
        FROM cdocs""")
    ORACLES["render_trend_docs"] = with_(base, "SELECT id, title, description, tags, front_matter, body FROM tdocs")
    ORACLES["reproduce_spec"] = with_(base, "SELECT * FROM specs_out")
    ORACLES["scan_bundle"] = with_(base, """SELECT id, replace(title, '"', '''') AS title, type, variable, value,
        length(trim(body, ' ' || chr(10))) AS body_length FROM docs""")
    ORACLES["bundle_index"] = with_(base, """SELECT CAST(CASE WHEN type = 'metric' THEN 2 ELSE 1 END AS INT) AS section,
        id, CASE WHEN type = 'metric' THEN printf('- [%s](./%s.md)', id, id)
        ELSE printf('- [%s](./%s.md): %s', id, id, description) END AS line FROM docs""")
    ORACLES["conformance_check"] = with_(base, """
        SELECT id || '_bare' AS id, 'missing or unreadable front matter' AS issue FROM docs
        UNION ALL SELECT id || '_untyped', 'missing required field: type' FROM docs""")
    ORACLES["dangling_links"] = with_(base, """SELECT DISTINCT id, target FROM (SELECT id,
        unnest(regexp_extract_all(body, '\\]\\(\\./([A-Za-z0-9_]+)\\.md\\)', 1)) AS target FROM docs)
        WHERE target NOT IN (SELECT id FROM docs)""")
    ORACLES["quarantine_leak_check"] = with_(base, """
        SELECT v.id || '_leak' AS id, b.id AS quarantined_id, printf('%.2f', b.claimed) AS figure
        FROM verdicts v JOIN verdicts b ON printf('%.2f', v.claimed) = printf('%.2f', b.claimed)
        WHERE v.verdict = 'FAIL' AND b.verdict = 'FAIL' AND b.claimed IS NOT NULL
        AND printf('%.2f', b.claimed) NOT IN (SELECT printf('%.2f', right_value) FROM verdicts WHERE right_value IS NOT NULL)
        AND printf('%.2f', b.claimed) NOT IN (SELECT printf('%.2f', claimed) FROM verdicts WHERE verdict = 'PASS')
        UNION ALL SELECT d.id, b.id, printf('%.2f', b.claimed) FROM verdicts b JOIN docs d
          ON list_contains(regexp_extract_all(d.front_matter || chr(10) || d.body, '[0-9]+\\.[0-9]+'),
             printf('%.2f', b.claimed))
        WHERE b.verdict = 'FAIL' AND b.claimed IS NOT NULL
        AND printf('%.2f', b.claimed) NOT IN (SELECT printf('%.2f', right_value) FROM verdicts WHERE right_value IS NOT NULL)
        AND printf('%.2f', b.claimed) NOT IN (SELECT printf('%.2f', claimed) FROM verdicts WHERE verdict = 'PASS')""")
    ORACLES["verified_variables"] = with_(base, "SELECT DISTINCT variable FROM docs WHERE variable IS NOT NULL")

    def codes(values) -> str:
        found, run = [], []
        for c in sorted(values):
            if run and c == run[-1] + 1:
                run.append(c)
            else:
                found, run = found + [run] if run else found, [c]
        return ", ".join(f"{r[0]}..{r[-1]}" if len(r) > 2 else ", ".join(map(str, r)) for r in found + [run] if r)

    parts = [f"SELECT 'warning' AS part, CAST(0 AS INT) AS place, {text(WARNING)} AS text"]
    for place, name in enumerate(Q.INSPECTED):
        meaning = text(f"{name}: nothing published explains this column")
        if name in CATALOG:
            v = CATALOG[name]
            found = (f"{name} = {v.label}; codes {codes(v.valid)}" + (f" (yes: {codes(v.affirmative)})" if v.affirmative else "")
                     + f"; {v.universe_text}" + (f" {v.notes}" if v.notes else ""))
            meaning = f"CASE WHEN '{name}' IN (SELECT variable FROM docs) THEN {text(found)} ELSE {meaning} END"
        parts.append(f"SELECT 'column', {place}, {meaning}")
    order = "refund NULLS FIRST, quarter NULLS FIRST, wait NULLS FIRST, spend NULLS FIRST"
    shown = " || ', ' || ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), 'missing')" for c in Q.INSPECTED if c != "no_column")
    parts.append(f"SELECT 'row', CAST(row_number() OVER (ORDER BY {order}) AS INT), {shown} FROM (SELECT * FROM micro WHERE outcome = 3 ORDER BY {order} LIMIT 25)")
    ORACLES["rows_with_column_summary"] = with_(base, " UNION ALL ".join(parts))

    q9, q5 = woodruff("d9", "0.6", "w9"), woodruff("d5", "0.5", "w5")
    ORACLES["grounded_or_refuse"] = with_(
        [MICRO,
         f"d1 AS ({rows('outcome = 3 AND quarter = 2 AND ' + VALID['refund'], yes('refund'))})", taylor("d1", "t1"),
         f"d7 AS ({rows('quarter = 1 AND ' + VALID['cut'], 'cut', w='wt_units')})", taylor("d7", "t7"),
         f"d9 AS ({rows(VALID['spend'], 'spend')})", *q9,
         f"d5 AS ({rows(BACK + ' AND ' + VALID['wait'], 'wait')})", *q5,
         """found AS (SELECT 'r1' AS request_id, 100 * r AS estimate, 100 * lci AS lci, 100 * uci AS uci, 100 * se AS se,
           n, tw FROM t1 UNION ALL SELECT 'r7', r, lci, uci, se, n, tw FROM t7
           UNION ALL SELECT 'r5', point, lci, uci, se, n, tw FROM w9
           UNION ALL SELECT 'r8', point, lci, uci, se, n, tw FROM w5)""",
         "asked(request_id, variable, universe, stat, q) AS (VALUES " + ", ".join(
             f"({text(r[0])}, {text(r[1])}, {text(r[2])}, {text(r[3])}, "
             f"{'NULL' if r[3] != 'quantile' else (r[4] if r[4] is not None else 0.5)})" for r in Q.REQUESTS) + ")"],
        """SELECT a.request_id, variable, universe, stat, CAST(q AS DOUBLE) AS q,
        CASE a.request_id WHEN 'r2' THEN 'quarter is not backed by a published document' WHEN 'r3' THEN 'empty subpopulation'
          WHEN 'r4' THEN 'this universe cannot be read at place 0: ''outcome + 1 == 3'''
          WHEN 'r6' THEN 'unknown statistic: mode' END AS reason,
        CASE WHEN f.request_id IS NULL THEN 'refused' ELSE 'answered' END AS status, round(estimate, 6) AS estimate,
        round(lci, 6) AS lci, round(uci, 6) AS uci, round(se, 6) AS se, n, round(tw, 4) AS denominator_weighted
        FROM asked a LEFT JOIN found f ON a.request_id = f.request_id""")
    ORACLES["grounded_table"] = with_(
        [MICRO, f"d AS ({rows('outcome = 3 AND qty NOT IN (7, 8, 9) AND ' + VALID['wait'], 'wait', 'CAST(qty AS BIGINT)')})", taylor("d")],
        """SELECT g AS group_value, round(r, 6) AS estimate, round(se, 6) AS se, round(lci, 6) AS lci, round(uci, 6) AS uci, n FROM t""")
    reserved = "NOT IN (7, 8, 9, 77, 88, 96, 97, 98, 99, 996, 997, 998, 999)"

    def group(column: str) -> str:
        return f"CAST({column} AS BIGINT)"

    ORACLES["grounded_tables"] = with_(
        [MICRO,
         f"d1 AS ({rows(f'{BACK} AND quarter {reserved} AND ' + VALID['refund'], yes('refund'), group('quarter'))})", taylor("d1", "t1"),
         f"d2 AS ({rows(f'{BACK} AND qty {reserved} AND ' + VALID['wait'], 'wait', group('qty'))})", taylor("d2", "t2"),
         f"d3 AS ({rows(f'(quarter = 1 OR qty > 25) AND stratum {reserved} AND ' + VALID['spend'], 'spend', group('stratum'))})", taylor("d3", "t3"),
         f"d4 AS ({rows(VALID['outcome'] + ' AND ' + VALID['cut'], 'cut', group('outcome'), 'wt_units')})", taylor("d4", "t4"),
         f"d5 AS ({rows(f'qty <= 10 AND cluster {reserved} AND ' + VALID['spend'], 'spend', group('cluster'))})", *woodruff("d5", "0.5", "w5"),
         f"d6 AS ({rows(VALID['cut'], 'cut', w='wt_units')})", taylor("d6", "t6"),
         """found AS (SELECT 't1' AS request_id, g, 100 * r AS estimate, 100 * lci AS lci, 100 * uci AS uci, 100 * se AS se, n, tw FROM t1
           UNION ALL SELECT 't5', g, point, lci, uci, se, n, tw FROM w5
           UNION ALL SELECT 't6', NULL, r, lci, uci, se, n, tw FROM t6 """
         + " ".join(f"UNION ALL SELECT '{t}', g, r, lci, uci, se, n, tw FROM {t}" for t in ("t2", "t3", "t4")) + ")",
         "asked(request_id, variable, universe, stat, q, groupby) AS (VALUES " + ", ".join(
             f"({text(r[0])}, {text(r[1])}, {text(r[2])}, {text(r[3])}, {'0.5' if r[3] == 'quantile' else 'NULL'}, {text(r[5])})"
             for r in Q.TABLE_REQUESTS) + ")"],
        """SELECT a.request_id, variable, universe, stat, CAST(q AS DOUBLE) AS q, groupby, g AS group_value,
        CASE a.request_id WHEN 't7' THEN 'no column of numbers to group by: no_column'
          WHEN 't8' THEN 'nothing to tabulate: no row that counts has a group value of qty'
          WHEN 't9' THEN 'quarter is not backed by a published document' END AS reason,
        CASE WHEN f.request_id IS NULL THEN 'refused' ELSE 'answered' END AS status, round(estimate, 6) AS estimate,
        round(lci, 6) AS lci, round(uci, 6) AS uci, round(se, 6) AS se, n, round(tw, 4) AS denominator_weighted
        FROM asked a LEFT JOIN found f ON a.request_id = f.request_id""")


# The English stop words of Spark ML that consist of word characters only.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now cannot could ought would
""".split()


def _index_tables(docs: str, key: str, body: str, stop: list[str]) -> list[str]:
    words = ", ".join(f"'{w}'" for w in stop)
    return [
        f"tokens AS (SELECT {key} AS doc, unnest(regexp_extract_all(lower({body}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term "
        f"FROM {docs})",
        f"counts AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM tokens WHERE term NOT IN ({words}) GROUP BY doc, term)",
        f"idf AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM {docs})) / (1.0 + count(*))) + 1 AS idf FROM counts GROUP BY term)",
        "raws AS MATERIALIZED (SELECT doc, c.term, tf, tf * idf AS raw FROM counts c JOIN idf i ON c.term = i.term)",
        "norms AS MATERIALIZED (SELECT doc, sqrt(sum(raw * raw)) AS norm FROM raws GROUP BY doc)",
        "postings AS (SELECT r.doc, term, tf, raw / norm AS weight FROM raws r JOIN norms n ON r.doc = n.doc)",
    ]


def _query_tables(asked: str, key: str, body: str, stop: list[str], k: int) -> list[str]:
    words = ", ".join(f"'{w}'" for w in stop)
    return [
        f"qtokens AS (SELECT {key} AS qid, unnest(regexp_extract_all(lower({body}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term "
        f"FROM {asked})",
        f"qraw AS (SELECT qid, q.term, count(*) * any_value(idf) AS raw FROM qtokens q JOIN idf i ON q.term = i.term "
        f"WHERE q.term NOT IN ({words}) GROUP BY qid, q.term)",
        "qnorm AS (SELECT qid, sqrt(sum(raw * raw)) AS norm FROM qraw GROUP BY qid)",
        "scores AS (SELECT q.qid, p.doc, round(sum(raw / norm * weight), 12) AS score FROM qraw q "
        "JOIN qnorm n ON q.qid = n.qid JOIN postings p ON q.term = p.term GROUP BY q.qid, p.doc)",
        "ranked AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rnk "
        "FROM scores WHERE score > 0)",
        f"hits AS (SELECT * FROM ranked WHERE rnk <= {k})",
    ]


def _search() -> None:
    index = _index_tables("documents", "doc_id", "text", STOP_WORDS)
    ORACLES["tfidf_index"] = with_(index, """SELECT p.doc AS doc_id, p.term, tf, round(idf, 6) AS idf,
        round(weight, 6) AS weight FROM postings p JOIN idf i ON p.term = i.term""")
    ORACLES["tfidf_topk"] = with_(
        index + _query_tables("benchmark", "item_id", "text", STOP_WORDS, 3),
        """SELECT qid AS item_id, doc AS doc_id, round(score, 6) AS score, CAST(rnk AS INT) AS "rank" FROM hits""")
    asked = ", ".join(f"({i}, {text(q)})" for i, q in QUESTIONS)
    base = _doc_tables() + [
        f"questions(question_id, question) AS (VALUES {asked})",
        "dtext AS (SELECT id, title || chr(10) || body AS body FROM docs)",
        *_index_tables("dtext", "id", "body", STOP_WORDS),
        *_query_tables("questions", "question_id", "question", STOP_WORDS, 3),
        f"""shown AS (SELECT h.qid, h.rnk, d.id, d.title, split_part(d.body, chr(10), 1) AS first_line,
        CASE WHEN statistic <> '' AND value IS NOT NULL THEN statistic || ': ' || printf('%.2f', value)
          || CASE WHEN unit IN ('%', '') THEN unit ELSE ' ' || unit END END AS figure, detail,
        d.id || ' ({SOURCE})' AS citation FROM hits h JOIN docs d ON h.doc = d.id)""",
    ]
    ORACLES["search_published"] = with_(base, """SELECT qid AS question_id, doc AS id, CAST(rnk AS INT) AS "rank",
        round(score, 6) AS score FROM hits""")
    ORACLES["search_results_text"] = with_(base, """SELECT q.question_id, coalesce(string_agg('[' || s.id || '] ' || s.title
        || chr(10) || '  ' || CASE WHEN figure IS NOT NULL THEN figure || ' (' || detail || ')' ELSE first_line END,
        chr(10) || chr(10) ORDER BY rnk), '(nothing found)') AS results
        FROM questions q LEFT JOIN shown s ON q.question_id = s.qid GROUP BY q.question_id""")
    ORACLES["answer_extractive"] = with_(base, """SELECT q.question_id,
        CASE WHEN count(s.id) = 0 THEN 'refused' ELSE 'answered' END AS mode,
        coalesce(max(CASE WHEN figure IS NOT NULL THEN figure || '. (' || detail || ')' ELSE title || ': ' || first_line END)
          FILTER (rnk = 1), 'Nothing published answers this.') AS answer,
        max(citation) FILTER (rnk = 1) AS source,
        coalesce(string_agg(citation, '; ' ORDER BY rnk), '') AS citations
        FROM questions q LEFT JOIN shown s ON q.question_id = s.qid GROUP BY q.question_id""")


def _blocks() -> None:
    source = f"d AS ({rows(VALID['spend'], 'spend', 'yr')})"
    ORACLES["running_weight"] = with_([MICRO, source, "r AS (SELECT g, y, sum(w) AS s FROM d GROUP BY g, y HAVING sum(w) > 0)"],
        """SELECT g AS yr, y, round(s, 4) AS s, round(sum(s) OVER (PARTITION BY g ORDER BY y), 4) AS c_s,
        round(sum(s) OVER (PARTITION BY g), 4) AS total_s FROM r""")
    at = ", ".join(lookup(str(q), f"at_{int(q * 100)}") for q in Q.LOOKUPS)
    shown = ", ".join(f"round(at_{int(q * 100)}, 6) AS at_{int(q * 100)}" for q in Q.LOOKUPS)
    ORACLES["interp_lookup"] = with_([MICRO, source, midpoints("d", "m"), f"e AS (SELECT g, {at} FROM m GROUP BY g)"],
                                     f"SELECT g AS yr, {shown} FROM e")
    ORACLES["wikilink_to_markdown"] = """SELECT doc_id, md5(regexp_replace('See [[D' || doc_id || ']] and [[no link]]. '
        || text, '\\[\\[([A-Za-z0-9_]+)\\]\\]', '[\\1](./\\1.md)', 'g')) AS digest FROM documents"""
    ORACLES["frontmatter_split"] = """SELECT CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'D' || doc_id END
        AS id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'T' END AS title,
        CASE WHEN doc_id % 3 <> 0 THEN 'note' END AS type,
        md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS digest
        FROM documents"""
    ORACLES["first_sentence"] = """SELECT doc_id, md5(replace(regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g')),
        '\\[\\[([A-Za-z0-9_]+)\\]\\]', '[\\1](./\\1.md)', 'g'), '"', '''')) AS digest FROM (SELECT doc_id,
        CASE WHEN h <> '' THEN regexp_replace(h, '\\.+$', '') || '.' END AS s FROM (SELECT doc_id,
        trim(split_part(trim(text), '. ', 1)) AS h FROM documents))"""
    ORACLES["number_text"] = """SELECT o_orderkey, printf('%.2f', o_totalprice) AS fixed,
        format('{:,.0f}', o_totalprice) AS grouped FROM orders"""
    ORACLES["year_map_text"] = with_([MICRO], """SELECT quarter,
        '{' || string_agg(printf('%d: %.2f', yr, m), ', ' ORDER BY yr) || '}' AS years
        FROM (SELECT quarter, yr, avg(cut) AS m FROM micro GROUP BY quarter, yr) GROUP BY quarter""")
    runs = """(SELECT string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) WHEN lo + 1 = hi THEN lo || ', ' || hi
          ELSE lo || '..' || hi END, ', ' ORDER BY lo) FROM (SELECT min(c) AS lo, max(c) AS hi FROM (SELECT c,
          c - row_number() OVER (ORDER BY c) AS k FROM (SELECT DISTINCT {0} AS c FROM micro i WHERE i.quarter = m.quarter)) GROUP BY k))"""
    ORACLES["codes_text"] = with_([MICRO], f"""SELECT quarter, {runs.format('outcome')} AS short, {runs.format('qty')} AS long
        FROM (SELECT DISTINCT quarter FROM micro) m""")


for _part in (_sources, _filters, _estimates, _trends, _claims, _documents, _search, _blocks):
    _part()
