"""SQL twins of the queries, written independently in DuckDB's dialect."""

from __future__ import annotations

from ..functions import fixed
from .tables import dirty_sql

NUM, TXT, DAT = "numeric", "string", "datetime"
DIRTY_COLUMNS = [
    ("k", NUM, False), ("total_price", NUM, True), ("status", TXT, False), ("amount_txt", TXT, False),
    ("date_txt", TXT, False), ("leak_flag", NUM, False), ("target", NUM, False), ("const_col", TXT, False),
    ("quasi", TXT, False), ("sparse_col", NUM, False), ("base_price", NUM, True), ("principal", NUM, True),
    ("rare_target", NUM, False),
]
CLEAN_COLUMNS = [
    ("k", NUM, False), ("total_price", NUM, True), ("status", TXT, False), ("amount_txt", NUM, True),
    ("date_txt", DAT, False), ("target", NUM, False), ("base_price", NUM, True), ("rare_target", NUM, False),
]
LINEITEM_COLUMNS = [
    ("l_orderkey", NUM, False), ("l_partkey", NUM, False), ("l_suppkey", NUM, False), ("l_linenumber", NUM, False),
    ("l_quantity", NUM, True), ("l_extendedprice", NUM, True), ("l_discount", NUM, True), ("l_tax", NUM, True),
    ("l_returnflag", TXT, False), ("l_linestatus", TXT, False), ("l_shipdate", DAT, False),
]
WITH_DIRTY = f"WITH d AS ({dirty_sql('//', 'varchar')}) "
NUMBER = fixed.NUMBER_PATTERN


def pct(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) > 0 THEN ((({part})::BIGINT * 20000 + ({whole})) // (2 * ({whole})))::DOUBLE / 100 ELSE 0.0 END)"


def quoted_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def number_list(values) -> str:
    return ", ".join(str(v) for v in values)


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def names_with(columns, fragments) -> list[str]:
    return [c for c, _, _ in columns if any(f in c.lower() for f in fragments)]


# ---- per-column statistics ------------------------------------------------------
def nulls(columns, t="d") -> str:
    parts = []
    for i, (c, kind, _) in enumerate(columns):
        blanks = f"count(*) FILTER (trim({c}) = '')" if kind == TXT else "0"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS col, count(*) AS n, count(*) - count({c}) AS nulls, "
            f"({blanks})::BIGINT AS blanks FROM {t}"
        )
    return union(parts)


def distincts(columns, t="d") -> str:
    return union([
        f"SELECT {i} AS position, '{c}' AS col, '{kind}' AS kind, count(*) AS n, count({c}) AS non_null, "
        f"count(DISTINCT {c}) AS ndv FROM {t}" for i, (c, kind, _) in enumerate(columns)
    ])


def inferred() -> str:
    return f"""CASE WHEN kind = 'numeric' AND ndv <= 2 THEN 'boolean / binary'
      WHEN kind = 'numeric' AND ndv < 10 THEN 'discrete numeric' WHEN kind = 'numeric' THEN 'continuous numeric'
      WHEN kind = 'datetime' THEN 'datetime' WHEN ndv = n AND n > 10 THEN 'identifier / key'
      WHEN {pct('ndv', 'n')} < 5 OR ndv <= 20 THEN 'categorical' ELSE 'text / object' END"""


def two_digits(value: str) -> str:
    return f"round(({value})::DECIMAL(38, 6), 2)::DOUBLE"


def numeric_summary(columns, t="d") -> str:
    def row(c):
        figures = {
            '"min"': f"min({c})::DOUBLE", '"max"': f"max({c})::DOUBLE", '"mean"': f"avg({c})",
            "median": f"quantile_cont({c}::DOUBLE, 0.5)", "std": f"coalesce(stddev_samp({c}), 0)",
            "q25": f"quantile_cont({c}::DOUBLE, 0.25)", "q75": f"quantile_cont({c}::DOUBLE, 0.75)",
        }
        shown = ", ".join(f"{two_digits(e)} AS {k}" for k, e in figures.items())
        return f"SELECT '{c}' AS \"column\", {shown} FROM {t} HAVING count({c}) > 0"

    return union([row(c) for c, kind, _ in columns if kind == NUM])


def frequent(columns, k, t="d") -> str:
    ranked = union([
        f"SELECT '{c}' AS col, {c}::VARCHAR AS value, count(*) AS cnt FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c, kind, _ in columns if kind == TXT
    ])
    return (
        "SELECT col AS \"column\", place, value, cnt FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY col ORDER BY cnt DESC, value)::INTEGER AS place FROM ({ranked}) f) r WHERE place <= {k}"
    )


def fences(columns, target, t="d") -> str:
    parts = []
    for i, (c, kind, _) in enumerate(columns):
        if kind != NUM or c == target:
            continue
        parts.append(f"""
SELECT {i} AS position, '{c}' AS col, any_value(n) AS non_null, any_value(q1) AS q1, any_value(med) AS median,
  any_value(q3) AS q3, any_value(mad) AS mad,
  count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers,
  count(*) FILTER (x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1)) AS extremes,
  count(*) FILTER (mad > 0 AND 0.6745 * abs(x - med) / mad > 3.5) AS z_outliers
FROM (SELECT {c}::DOUBLE AS x FROM {t} WHERE {c} IS NOT NULL) v,
  (SELECT count({c}) AS n, count(DISTINCT {c}) AS ndv, quantile_cont({c}::DOUBLE, 0.25) AS q1,
     median({c}::DOUBLE) AS med, quantile_cont({c}::DOUBLE, 0.75) AS q3, mad({c}::DOUBLE) AS mad FROM {t}) s
WHERE ndv > 5 AND n >= 10 AND q3 > q1 HAVING count(*) > 0""")
    return union(parts)


def sentinel_words(columns, t="d") -> str:
    words = quoted_list(fixed.TEXT_SENTINELS)
    return union([
        f"SELECT {i} AS position, '{c}' AS col, count({c}) AS non_null, "
        f"count(*) FILTER (lower(trim({c})) IN ({words})) AS hits, "
        f"(SELECT string_agg(w, ', ' ORDER BY w) FROM (SELECT DISTINCT trim({c}) AS w FROM {t} "
        f"WHERE lower(trim({c})) IN ({words}) ORDER BY w LIMIT 5) e) AS examples FROM {t}"
        for i, (c, kind, _) in enumerate(columns) if kind == TXT
    ])


def sentinel_codes(columns, t="d") -> str:
    codes = [(j, s) for j, s in enumerate(fixed.NUMERIC_SENTINELS) if s < 0 or s >= 999]
    return union([
        f"SELECT {i} AS position, {j} AS code_no, '{c}' AS col, {s}::BIGINT AS sentinel, count({c}) AS non_null, "
        f"count(*) FILTER ({c} = {s}) AS hits FROM {t} "
        f"HAVING count(*) FILTER ({c} = {s}) > 0 AND abs({s} - median({c}::DOUBLE)) > 20"
        for i, (c, kind, _) in enumerate(columns) if kind == NUM for j, s in codes
    ])


def impossible(columns, t="d") -> str:
    rules = (
        ("age", 0, fixed.AGE_FRAGMENTS, "{c} < 0 OR {c} > 125"),
        ("money", 1, fixed.MONEY_FRAGMENTS, "{c} < 0"),
        ("biometric", 2, fixed.BIOMETRIC_FRAGMENTS, "{c} < 0"),
    )
    numeric = [(i, c) for i, (c, kind, _) in enumerate(columns) if kind == NUM]
    parts = [
        f"SELECT {i} AS position, {j} AS rule_no, '{c}' AS col, '{rule}' AS rule, count({c}) AS non_null, "
        f"count(*) FILTER ({test.format(c=c)}) AS bad FROM {t} HAVING count(*) FILTER ({test.format(c=c)}) > 0"
        for i, c in numeric for rule, j, fragments, test in rules if any(f in c.lower() for f in fragments)
    ]
    return union(parts) if parts else (
        "SELECT 0 AS position, 0 AS rule_no, '' AS col, '' AS rule, 0::BIGINT AS non_null, 0::BIGINT AS bad WHERE false"
    )


def pairs(columns, target, t="d") -> str:
    numeric = [(i, c) for i, (c, kind, _) in enumerate(columns) if kind == NUM and c != target]
    return union([
        f"SELECT {i} AS pos_a, {j} AS pos_b, '{a}' AS col_a, '{b}' AS col_b, coalesce(corr({a}, {b}), 0) AS r FROM {t}"
        for x, (i, a) in enumerate(numeric) for j, b in numeric[x + 1:]
    ])


def shapes(columns, t="d") -> str:
    def count(test):
        return f"count(*) FILTER ({test})"

    parts = []
    for i, (c, kind, _) in enumerate(columns):
        if kind != TXT:
            continue
        s = f"trim({c})"
        number, date = f"regexp_matches({s}, '{NUMBER}')", f"regexp_matches({s}, '{fixed.DATE_PATTERN}')"
        boolean = f"lower({s}) IN ('true', 'false')"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS col, count(*) AS n, count({c}) AS non_null, "
            f"{count(f'''regexp_matches({s}, '{fixed.CURRENCY_PATTERN}')''')} AS currency, {count(date)} AS dates, "
            f"{count(number)} AS numbers, {count(boolean)} AS booleans, "
            f"{count(f'NOT ({number} OR {date} OR {boolean}) AND {s} <> {chr(39)}{chr(39)}')} AS words FROM {t}"
        )
    return f"""SELECT *, CASE WHEN non_null = 0 THEN NULL WHEN currency > non_null * 0.75 THEN 'currency'
      WHEN dates > non_null * 0.8 THEN 'date'
      WHEN (numbers > 0)::INT + (dates > 0)::INT + (booleans > 0)::INT + (words > 0)::INT > 1 THEN 'mixed' END AS verdict
    FROM ({union(parts)}) s"""


def whole_floats(columns, t="d") -> str:
    return union([
        f"SELECT {i} AS position, '{c}' AS col, count(DISTINCT {c}) AS ndv, coalesce(bool_and({c} = floor({c})), false) "
        f"AND count({c}) > 0 AND count(DISTINCT {c}) <= 5 AND count(*) > 50 AS as_integer FROM {t}"
        for i, (c, _, floating) in enumerate(columns) if floating
    ])


def constants(columns, target, t="d") -> str:
    parts = [
        f"SELECT {i} AS position, '{c}' AS col, (SELECT count(*) FROM {t}) AS n, count(*) AS ndv, "
        f"coalesce(sum(cnt), 0)::BIGINT AS non_null, max(cnt) AS top_count, "
        f"arg_min(v, (-cnt, v)) AS top_value FROM (SELECT {c}::VARCHAR AS v, count(*) AS cnt FROM {t} "
        f"WHERE {c} IS NOT NULL GROUP BY 1) f"
        for i, (c, _, _) in enumerate(columns) if c != target
    ]
    return f"""SELECT *, {pct('top_count', 'non_null')} AS top_pct, CASE WHEN non_null = 0 THEN 'all_null'
      WHEN ndv = 1 THEN 'constant'
      WHEN n >= 50 AND {pct('top_count', 'non_null')} >= 99 AND ndv <= 5 THEN 'quasi_constant' END AS state
    FROM ({union(parts)}) s"""


def balance(column, t="d") -> str:
    """One row of class balance for a target column."""
    return f"""
SELECT *, (CASE WHEN severity = 'CRITICAL' THEN 45.0 WHEN severity = 'HIGH' THEN 60.0
    WHEN severity = 'MEDIUM' THEN 80.0 ELSE 100.0 END)::DOUBLE AS score
FROM (SELECT *, CASE WHEN (imbalance_ratio < 0.15 OR minority_pct < 10) AND (minority_pct < 5 OR imbalance_ratio < 0.08)
    THEN 'CRITICAL' WHEN imbalance_ratio < 0.15 OR minority_pct < 10 THEN 'HIGH'
    WHEN imbalance_ratio < 0.35 THEN 'MEDIUM' END AS severity
  FROM (SELECT total, classes, majority_class, minority_class, majority_count, minority_count,
      round(minority_count / majority_count, 3) AS imbalance_ratio,
      {pct('minority_count', 'total')} AS minority_pct, {pct('majority_count', 'total')} AS majority_pct,
      round(e, 3) AS entropy,
      round(e / CASE WHEN classes > 1 THEN log2(classes) ELSE 1 END, 3) AS normalized_entropy
    FROM (SELECT any_value(total)::BIGINT AS total, count(*) AS classes, arg_min(label, (-cnt, label)) AS majority_class,
        arg_max(label, (-cnt, label)) AS minority_class, max(cnt) AS majority_count, min(cnt) AS minority_count,
        -sum(round(cnt / total, 4) * log2(round(cnt / total, 4) + 1e-12)) AS e
      FROM (SELECT label, cnt, sum(cnt) OVER () AS total FROM (SELECT {column}::VARCHAR AS label, count(*) AS cnt
        FROM {t} WHERE {column} IS NOT NULL GROUP BY 1) a) b) c) f) g"""


def leak_numbers(columns, target, t="d") -> str:
    def number(c, kind):
        return f"epoch_us({c})::DOUBLE" if kind == DAT else c

    return union([
        f"SELECT {i} AS position, '{c}' AS col, abs(coalesce(corr({number(c, kind)}, {target}), 0)) AS abs_r, "
        f"count(*) FILTER ({c} IS NOT NULL AND {target} IS NOT NULL) AS pairs FROM {t}"
        for i, (c, kind, _) in enumerate(columns) if kind in (NUM, DAT) and c != target
    ])


def purity(columns, target, t="d") -> str:
    return union([
        f"SELECT {i} AS position, '{c}' AS col, min(share) AS purity FROM (SELECT v, max(cnt) / sum(cnt) AS share FROM "
        f"(SELECT {c} AS v, {target} AS y, count(*) AS cnt FROM {t} WHERE {c} IS NOT NULL AND {target} IS NOT NULL "
        f"GROUP BY 1, 2) a GROUP BY v) b HAVING (SELECT count(DISTINCT {c}) FROM {t}) BETWEEN 2 AND 10"
        for i, (c, kind, _) in enumerate(columns) if kind == TXT and c != target
    ])


# ---- issues per check: seq, issue_id, severity, rows, pct, fix, penalty, fails --------
ISSUE = "seq, issue_id, severity, affected_rows_count, affected_rows_percentage, fix_action, penalty, fails"


def missing_issues(columns, target, t="d") -> str:
    k = len(columns)
    is_target = f"col = '{target}'"
    half = " + ".join(f"({c} IS NULL)::INT" for c, _, _ in columns)
    stats = f"SELECT *, nulls + blanks AS missing, {pct('nulls + blanks', 'n')} AS p FROM ({nulls(columns, t)}) z"
    return f"""
SELECT 'missing_values' AS checker_id, i.*, o.p > 0 AS fails FROM (
  SELECT -1 AS seq, 'missing_values_target_missing_values' AS issue_id, 'CRITICAL' AS severity, missing AS affected_rows_count,
    p AS affected_rows_percentage, 'drop_target_na:' || col AS fix_action, 0.0 AS penalty
  FROM ({stats}) s WHERE {is_target} AND missing > 0
  UNION ALL SELECT position, 'missing_values_' || CASE WHEN p > 60 THEN 'excessive' WHEN p >= 20 THEN 'high' ELSE 'moderate' END
      || '_missing_' || col,
    CASE WHEN p > 60 THEN CASE WHEN {is_target} THEN 'CRITICAL' ELSE 'HIGH' END
      WHEN p >= 20 THEN CASE WHEN {is_target} THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'LOW' END, missing, p,
    CASE WHEN p > 60 THEN 'drop_column:' ELSE 'impute:' END || col, CASE WHEN p > 60 THEN 10.0 ELSE 0.0 END
  FROM ({stats}) s WHERE p > 0
  UNION ALL SELECT 1000000, 'missing_values_sparse_rows_detected', 'MEDIUM', c, {pct('c', 'n')}, 'drop_sparse_rows', 0.0
  FROM (SELECT count(*) AS n, count(*) FILTER ({half} > {k} * 0.5) AS c FROM {t}) s WHERE c > 0) i,
  (SELECT {pct('sum(nulls + blanks)::BIGINT', f'any_value(n) * {k}')} AS p FROM ({nulls(columns, t)}) s) o"""


def repeats(names, t="d") -> str:
    inside = ", ".join(names)
    return f"(SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM {t} GROUP BY {inside}) g)"


def key_names(columns) -> list[str]:
    return [
        c for c, _, _ in columns
        if c.lower() in fixed.KEY_NAMES or any(f in c.lower() for f in fixed.KEY_FRAGMENTS)
    ]


def duplicate_issues(columns, target, t="d") -> str:
    everything = [c for c, _, _ in columns]
    keys = key_names(columns)
    features = [c for c in everything if c not in keys]
    exact = f"SELECT count(*) AS n, {repeats(everything, t)} AS c FROM {t}"
    parts = [f"""SELECT -1 AS seq, 'duplicate_rows_exact_duplicates_found' AS issue_id,
      CASE WHEN {pct('c', 'n')} > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, c AS affected_rows_count,
      {pct('c', 'n')} AS affected_rows_percentage, 'drop_exact_duplicates' AS fix_action, {pct('c', 'n')} * 4 AS penalty,
      true AS fails FROM ({exact}) e WHERE c > 0"""]
    for i, c in enumerate(everything):
        if c in keys:
            parts.append(f"""SELECT {i}, 'duplicate_rows_duplicate_key_{c}', 'HIGH', r, {pct('r', 'm')},
              'drop_duplicates_by_key:{c}', 12.0, true
              FROM (SELECT count({c}) - count(DISTINCT {c}) AS r, count({c}) AS m FROM {t}) k WHERE r > 0""")
    if keys and len(features) >= 3:
        parts.append(f"""SELECT 1000000, 'duplicate_rows_feature_subset_duplicates', 'LOW', x, {pct('x', 'n')}, NULL, 0.0, false
          FROM (SELECT count(*) AS n, {repeats(features, t)} - {repeats(everything, t)} AS x FROM {t}) f
          WHERE x > 0 AND {pct('x', 'n')} > 2""")
    return f"SELECT 'duplicate_rows' AS checker_id, * FROM ({union(parts)}) i"


def outlier_issues(columns, target, t="d") -> str:
    p, e = pct("outliers", "non_null"), pct("extremes", "non_null")
    return f"""
SELECT 'outliers' AS checker_id, position AS seq, 'outliers_outliers_' || col AS issue_id,
  CASE WHEN {e} > 2 OR {p} > 15 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, outliers AS affected_rows_count,
  {p} AS affected_rows_percentage, 'clip_outliers:' || col AS fix_action,
  4.0 + CASE WHEN extremes > 0 THEN 8.0 ELSE 0.0 END AS penalty, true AS fails
FROM ({fences(columns, target, t)}) s WHERE extremes > 0 OR {p} > 8
UNION ALL SELECT 'outliers', 1000000, 'outliers_multivariate_anomalies', 'LOW', NULL::BIGINT, NULL::DOUBLE, NULL, 4.0, true
FROM {t} HAVING count(*) >= 50"""  # SQL grows no trees: the one issue of the forest is known but for its count


def imbalance_issues(columns, target, t="d") -> str:
    return f"""
SELECT 'class_imbalance' AS checker_id, 0 AS seq, 'class_imbalance_' || CASE WHEN severity = 'MEDIUM' THEN 'moderate' ELSE 'severe' END
    || '_class_imbalance' AS issue_id, severity, minority_count AS affected_rows_count,
  minority_pct AS affected_rows_percentage, NULL AS fix_action, 100.0 - score AS penalty, true AS fails
FROM ({balance(target, t)}) b WHERE severity IS NOT NULL"""


def leakage_issues(columns, target, t="d") -> str:
    texts = purity(columns, target, t)
    return f"""
SELECT 'data_leakage' AS checker_id, position * 10 AS seq, 'data_leakage_' || CASE WHEN abs_r >= 0.95 THEN 'direct_target_leakage_'
    ELSE 'suspicious_target_correlation_' END || col AS issue_id,
  CASE WHEN abs_r >= 0.95 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, NULL::BIGINT AS affected_rows_count,
  NULL::DOUBLE AS affected_rows_percentage, CASE WHEN abs_r >= 0.95 THEN 'drop_column:' || col END AS fix_action,
  CASE WHEN abs_r >= 0.95 THEN 45.0 ELSE 10.0 END AS penalty, abs_r >= 0.95 AS fails
FROM ({leak_numbers(columns, target, t)}) s WHERE pairs > 20 AND abs_r >= 0.88
UNION ALL SELECT 'data_leakage', position * 10 + 1, 'data_leakage_categorical_leakage_' || col, 'CRITICAL', NULL, NULL,
  'drop_column:' || col, 45.0, true FROM ({texts}) p WHERE purity > 0.99"""


def correlation_issues(columns, target, t="d") -> str:
    return f"""
SELECT 'high_correlation' AS checker_id, pos_a * 100000 + pos_b AS seq,
  'high_correlation_collinear_' || col_a || '_' || col_b AS issue_id,
  CASE WHEN abs(r) >= 0.95 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, NULL::BIGINT AS affected_rows_count,
  NULL::DOUBLE AS affected_rows_percentage, 'drop_column:' || col_b AS fix_action, 12.0 AS penalty, true AS fails
FROM ({pairs(columns, target, t)}) s WHERE abs(r) >= 0.85"""


def type_issues(columns, target, t="d") -> str:
    return f"""
SELECT 'data_types' AS checker_id, position AS seq, 'data_types_' || CASE verdict WHEN 'currency' THEN 'currency_as_string_'
    WHEN 'date' THEN 'date_as_string_' ELSE 'mixed_types_' END || col AS issue_id,
  CASE verdict WHEN 'date' THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  CASE verdict WHEN 'currency' THEN currency WHEN 'date' THEN dates END AS affected_rows_count,
  CASE verdict WHEN 'currency' THEN {pct('currency', 'n')} END AS affected_rows_percentage,
  CASE verdict WHEN 'currency' THEN 'clean_numeric_string:' WHEN 'date' THEN 'convert_to_datetime:'
    ELSE 'standardize_types:' END || col AS fix_action,
  CASE verdict WHEN 'mixed' THEN 6.0 ELSE 18.0 END AS penalty, true AS fails
FROM ({shapes(columns, t)}) s WHERE verdict IS NOT NULL
UNION ALL SELECT 'data_types', position, 'data_types_float_should_be_int_' || col, 'LOW', NULL, NULL, 'cast_to_int:' || col,
  6.0, true FROM ({whole_floats(columns, t)}) w WHERE as_integer"""


def constant_issues(columns, target, t="d") -> str:
    return f"""
SELECT 'constant_columns' AS checker_id, position AS seq, 'constant_columns_' || CASE state WHEN 'all_null' THEN 'all_null_column_'
    WHEN 'constant' THEN 'constant_column_' ELSE 'quasi_constant_' END || col AS issue_id,
  CASE state WHEN 'all_null' THEN 'HIGH' WHEN 'constant' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE state WHEN 'quasi_constant' THEN top_count ELSE n END AS affected_rows_count,
  CASE state WHEN 'quasi_constant' THEN top_pct ELSE 100.0 END AS affected_rows_percentage,
  'drop_column:' || col AS fix_action, CASE state WHEN 'quasi_constant' THEN 4.0 ELSE 10.0 END AS penalty, true AS fails
FROM ({constants(columns, target, t)}) s WHERE state IS NOT NULL"""


def suspicious_issues(columns, target, t="d") -> str:
    hit = pct("hits", "non_null")
    return f"""
SELECT 'suspicious_values' AS checker_id, position * 100 AS seq, 'suspicious_values_text_sentinels_' || col AS issue_id,
  CASE WHEN {hit} > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, hits AS affected_rows_count,
  {hit} AS affected_rows_percentage, 'replace_sentinels_with_nan:' || col AS fix_action, 10.0 AS penalty, true AS fails
FROM ({sentinel_words(columns, t)}) w WHERE hits > 0
UNION ALL SELECT 'suspicious_values', position * 100 + 1 + code_no, 'suspicious_values_numeric_sentinel_' || col || '_' || sentinel,
  'HIGH', hits, {hit}, 'replace_sentinels_with_nan:' || col, 10.0, true FROM ({sentinel_codes(columns, t)}) c
UNION ALL SELECT 'suspicious_values', position * 100 + 20 + rule_no, 'suspicious_values_' || CASE rule WHEN 'age' THEN 'invalid_age_range_'
    WHEN 'money' THEN 'negative_financial_' ELSE 'negative_medical_' END || col,
  CASE rule WHEN 'biometric' THEN 'CRITICAL' ELSE 'HIGH' END, bad,
  CASE WHEN rule <> 'biometric' THEN {pct('bad', 'non_null')} END,
  CASE rule WHEN 'age' THEN 'sanitize_age_bounds:' ELSE 'abs_or_nan:' END || col, 10.0, true
FROM ({impossible(columns, t)}) r"""


CHECKS = {  # checker -> (issues, cap)
    "missing_values": (missing_issues, 100), "duplicate_rows": (duplicate_issues, 100),
    "outliers": (outlier_issues, 50), "class_imbalance": (imbalance_issues, 100),
    "data_leakage": (leakage_issues, 100), "high_correlation": (correlation_issues, 50),
    "data_types": (type_issues, 50), "constant_columns": (constant_issues, 50),
    "suspicious_values": (suspicious_issues, 50),
}
SHOWN = "checker_id, issue_id, severity, affected_rows_count::DOUBLE AS affected_rows_count, affected_rows_percentage, fix_action, round(penalty::DOUBLE, 4) AS penalty"


def issue_list(columns, target, t="d") -> str:
    return union([f"SELECT checker_id, {ISSUE} FROM ({make(columns, target, t)}) q" for make, _ in CHECKS.values()])


def score_ctes(columns, target, t="d", prefix="") -> str:
    """CTEs issues, checkers and dims (with a prefix) over table ``t``."""
    p = prefix
    rows = ", ".join(f"({i}, '{c}', '{d}', {CHECKS[c][1]})" for i, c in enumerate(CHECKS)
                     for d, (_, members) in fixed.DIMENSIONS.items() if c in members)
    weights = ", ".join(f"({i}, '{d}', {w})" for i, (d, (w, _)) in enumerate(fixed.DIMENSIONS.items()))
    overall = f"(SELECT {pct('sum(nulls + blanks)::BIGINT', f'any_value(n) * {len(columns)}')} FROM ({nulls(columns, t)}) s)"
    by_severity = ", ".join(
        f"(SELECT count(*) FROM {p}issues i JOIN {p}checkers k USING (checker_id) WHERE k.dimension = w.dimension "
        f"AND i.severity = '{s}') AS {s.lower()}" for s in fixed.SEVERITIES
    )
    return f"""{p}issues AS ({issue_list(columns, target, t)}),
{p}checkers AS (SELECT checker_no, c.checker_id, dimension, NOT coalesce(bool_or(fails), false) AS passed,
  round(greatest(0, 100 - least(coalesce(sum(penalty), 0), cap)
    - CASE WHEN c.checker_id = 'missing_values' THEN 3.5 * {overall} ELSE 0 END), 1) AS score, count(i.issue_id) AS n_issues
  FROM (VALUES {rows}) c(checker_no, checker_id, dimension, cap) LEFT JOIN {p}issues i ON i.checker_id = c.checker_id
  GROUP BY checker_no, c.checker_id, dimension, cap),
{p}dims AS (SELECT dimension_no, dimension, score, weight, round(score * weight, 2) AS weighted_score, {by_severity},
  CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C'
    WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade
  FROM (SELECT dimension_no, v.dimension, weight::DOUBLE AS weight, (SELECT round(avg(score), 1) FROM {p}checkers k WHERE k.dimension = v.dimension) AS score
    FROM (VALUES {weights}) v(dimension_no, dimension, weight)) w)"""


GRADE = """CASE WHEN overall_score >= 95 THEN 'A+' WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B'
  WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END"""

# The default repair of the defective table, stage by stage.
_WORDS = quoted_list(fixed.REPAIR_TEXT_SENTINELS)
_CODES = number_list(fixed.REPAIR_NUMERIC_SENTINELS)
CLEAN_CTES = f"""r1 AS (SELECT DISTINCT * FROM d),
r2 AS (SELECT CASE WHEN k NOT IN ({_CODES}) THEN k END AS k,
  abs(CASE WHEN total_price NOT IN ({_CODES}) THEN total_price END) AS total_price,
  CASE WHEN lower(trim(status)) NOT IN ({_WORDS}) THEN status END AS status,
  regexp_replace(amount_txt, '[\\$€£¥₹\\s%,]', '', 'g')::DOUBLE AS amount_txt,
  strptime(date_txt, '%Y/%m/%d') AS date_txt, target, base_price, rare_target FROM r1),
r3 AS (SELECT k, CASE WHEN total_price IS NOT NULL THEN greatest(least(total_price, hi), lo) END AS total_price,
  status, amount_txt, date_txt, target, base_price, rare_target
  FROM r2, (SELECT quantile_cont(total_price, 0.01) AS lo, quantile_cont(total_price, 0.99) AS hi FROM r2) b),
c AS (SELECT k, coalesce(total_price, (SELECT median(total_price) FROM r3)) AS total_price,
  coalesce(status, (SELECT arg_min(status, (-n, status)) FROM (SELECT status, count(*) AS n FROM r3
    WHERE status IS NOT NULL GROUP BY status) m)) AS status, amount_txt, date_txt, target, base_price, rare_target FROM r3)"""
