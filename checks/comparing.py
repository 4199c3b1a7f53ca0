"""Validation, utility, fairness, class metrics and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from twintable.operators.class_metrics import (
    accuracy_and_f1,
    best_model,
    classification_report,
    confusion_counts,
    confusion_matrix,
    group_metrics,
    metric_gaps,
    metrics_lookup,
)
from twintable.operators.compare import comparison_table, ranked_rows, winner
from twintable.operators.counts import paired_row_counts, paired_value_counts
from twintable.operators.fairness import fairness_summary, group_label_l1, group_proportion_tvd, mean_group_label_l1
from twintable.operators.utility import (
    category_shares,
    correlation_mae,
    correlation_pairs,
    histogram_overlay,
    ks_statistic,
    moments,
    numeric_distance,
    top_categories,
    total_variation,
)
from twintable.operators.validate import (
    invalid_category_rates,
    rare_combinations,
    row_overlap,
    rule_matrix,
    validation_summary,
)
from twintable.spec import Rules

# Lines still open play the real table; finished lines, altered here and there,
# the synthetic one.
REAL = (
    "SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, CAST(l_linenumber AS BIGINT) AS line,"
    " l_returnflag AS flag, CASE WHEN l_extendedprice > 50000 THEN 'high' WHEN l_extendedprice > 20000 THEN 'mid'"
    " ELSE 'low' END AS price FROM {lineitem} WHERE l_linestatus = 'O'"
)
SYN = (
    "SELECT CASE WHEN l_tax = 0.08 THEN l_quantity + 10 WHEN l_tax = 0 THEN -l_quantity ELSE l_quantity END AS quantity,"
    " CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS discount, l_tax AS tax,"
    " CAST(l_linenumber AS BIGINT) AS line,"
    " CASE WHEN l_discount = 0.1 THEN 'X' WHEN l_discount = 0.09 THEN NULL ELSE l_returnflag END AS flag,"
    " CASE WHEN l_extendedprice > 60000 THEN 'high' WHEN l_extendedprice > 20000 THEN 'mid'"
    " ELSE 'low' END AS price FROM {lineitem} WHERE l_linestatus = 'F'"
)
SYN_KEYED = SYN.replace("SELECT ", "SELECT l_orderkey, l_linenumber, ", 1)
CTE = f"WITH real AS ({REAL}), syn AS ({SYN})"
NUMBERS = ["quantity", "discount", "tax", "line"]
RULES = Rules(positive=("quantity",), percent=("tax",), flags=("line",))


def _pair(t):
    return t.sql(REAL), t.sql(SYN)


RULE_COLUMNS = {
    **{
        f"{c}__in_real_range": f"coalesce({c} BETWEEN (SELECT min({c}) FROM real) AND (SELECT max({c}) FROM real), FALSE)"
        for c in NUMBERS
    },
    "quantity_positive": "coalesce(quantity > 0, FALSE)",
    "tax_0_100": "coalesce(tax BETWEEN 0 AND 100, FALSE)",
    "line_binary": "coalesce(line IN (0, 1), FALSE)",
    **{f"{c}__valid_category": f"coalesce({c} IN (SELECT {c} FROM real), FALSE)" for c in ("flag", "price")},
}
MATRIX = ", ".join(f"{test} AS {name}" for name, test in RULE_COLUMNS.items())
VALID = " AND ".join(RULE_COLUMNS)


@query(
    "rule_matrix_lineitem",
    f"""WITH real AS ({REAL}), syn AS ({SYN_KEYED}), m AS (SELECT l_orderkey, l_linenumber, {MATRIX} FROM syn)
        SELECT *, ({VALID}) AS row_valid, NOT ({VALID}) AS row_has_violation FROM m""",
)
def _(t):
    return rule_matrix(t.sql(REAL), t.sql(SYN_KEYED), RULES, keep=["l_orderkey", "l_linenumber"])


@query(
    "validation_summary_lineitem",
    f"""{CTE}, m AS (SELECT {MATRIX} FROM syn), d AS (SELECT DISTINCT * FROM syn)
        SELECT (SELECT count(*) FROM syn) AS rows,
               round((SELECT avg(CASE WHEN quantity IS NULL OR discount IS NULL OR tax IS NULL OR line IS NULL OR flag IS NULL OR price IS NULL THEN 1.0 ELSE 0 END) FROM syn), 6) AS missing_row_rate,
               round(((SELECT count(*) FROM syn) - (SELECT count(*) FROM d)) / (SELECT count(*) FROM syn), 6) AS duplicate_row_rate,
               round((SELECT count(*) FROM syn s WHERE EXISTS (SELECT 1 FROM real r WHERE r.quantity = s.quantity AND r.discount IS NOT DISTINCT FROM s.discount
                      AND r.tax = s.tax AND r.line = s.line AND r.flag IS NOT DISTINCT FROM s.flag AND r.price = s.price)) / (SELECT count(*) FROM syn), 6) AS exact_overlap_with_real_train_rate,
               round((SELECT avg(CASE WHEN {VALID} THEN 0.0 ELSE 1 END) FROM m), 6) AS any_rule_violation_rate""",
)
def _(t):
    return validation_summary(*_pair(t), RULES)


@query(
    "invalid_category_rates_lineitem",
    f"""{CTE} SELECT 'flag' AS "column", round(avg(CASE WHEN flag IN (SELECT flag FROM real) THEN 0.0 ELSE 1 END), 6) AS invalid_rate FROM syn
        UNION ALL SELECT 'price', round(avg(CASE WHEN price IN (SELECT price FROM real) THEN 0.0 ELSE 1 END), 6) FROM syn""",
)
def _(t):
    return invalid_category_rates(rule_matrix(*_pair(t)))


@query(
    "paired_row_counts_lineitem",
    f"""{CTE}, u AS (SELECT *, 1 AS r, 0 AS s FROM real UNION ALL SELECT *, 0, 1 FROM syn)
        SELECT round(quantity, 6) AS quantity, round(tax, 6) AS tax, flag, CAST(sum(r) AS BIGINT) AS real_n, CAST(sum(s) AS BIGINT) AS syn_n
        FROM u GROUP BY ALL""",
)
def _(t):
    return paired_row_counts(*_pair(t), ["quantity", "tax", "flag"])


@query(
    "exact_overlap_lineitem",
    f"""{CTE}, r AS (SELECT DISTINCT quantity, tax, flag FROM real)
        SELECT (SELECT count(*) FROM syn) AS rows,
               round(((SELECT count(*) FROM syn) - (SELECT count(*) FROM (SELECT DISTINCT quantity, tax, flag FROM syn))) / (SELECT count(*) FROM syn), 6) AS duplicate_row_rate,
               round((SELECT count(*) FROM syn JOIN r ON syn.quantity = r.quantity AND syn.tax = r.tax AND syn.flag IS NOT DISTINCT FROM r.flag) / (SELECT count(*) FROM syn), 6) AS exact_overlap_rate""",
)
def _(t):
    real, syn = _pair(t)
    return row_overlap(real.select("quantity", "tax", "flag"), syn)


@query(
    "rare_combinations_lineitem",
    f"""{CTE}, rare AS (SELECT quantity, discount, tax, line, flag FROM real GROUP BY ALL HAVING count(*) <= 2)
        SELECT round((SELECT count(*) FROM syn JOIN rare ON syn.quantity = rare.quantity AND syn.discount IS NOT DISTINCT FROM rare.discount
                      AND syn.tax = rare.tax AND syn.line = rare.line AND syn.flag IS NOT DISTINCT FROM rare.flag) / (SELECT count(*) FROM syn), 6) AS rare_combo_leakage_rate""",
)
def _(t):
    return rare_combinations(*_pair(t), [*NUMBERS, "flag"])


@query(
    "paired_value_counts_lineitem",
    f"""{CTE}, u AS (SELECT 'flag' AS c, flag AS v, 1 AS r, 0 AS s FROM real UNION ALL SELECT 'flag', flag, 0, 1 FROM syn
                     UNION ALL SELECT 'price', price, 1, 0 FROM real UNION ALL SELECT 'price', price, 0, 1 FROM syn)
        SELECT c AS "column", coalesce(v, 'nan') AS value, CAST(sum(r) AS BIGINT) AS real_n, CAST(sum(s) AS BIGINT) AS syn_n FROM u GROUP BY 1, 2""",
)
def _(t):
    return paired_value_counts(*_pair(t), ["flag", "price"])


@query(
    "moments_lineitem",
    f"{CTE} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round((SELECT avg({c}) FROM real), 6) AS real_mean, round((SELECT stddev_samp({c}) FROM real), 6) AS real_std,
            round((SELECT avg({c}) FROM syn), 6) AS syn_mean, round((SELECT stddev_samp({c}) FROM syn), 6) AS syn_std"""
        for c in NUMBERS
    ),
)
def _(t):
    return moments(*_pair(t), NUMBERS)


def ks_sql(columns) -> str:
    """CTEs ending in ``ks(c, real_n, syn_n, d)``."""
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS c, {c} AS v, 1 AS r, 0 AS s FROM real WHERE {c} IS NOT NULL
                UNION ALL SELECT '{c}', {c}, 0, 1 FROM syn WHERE {c} IS NOT NULL"""
        )
    return f"""u AS ({' UNION ALL '.join(parts)}), g AS (SELECT c, v, sum(r) AS r, sum(s) AS s FROM u GROUP BY 1, 2),
      w AS (SELECT c, sum(r) OVER (PARTITION BY c ORDER BY v) AS ur, sum(s) OVER (PARTITION BY c ORDER BY v) AS us,
                   sum(r) OVER (PARTITION BY c) AS nr, sum(s) OVER (PARTITION BY c) AS ns FROM g),
      ks AS (SELECT c, CAST(max(nr) AS BIGINT) AS real_n, CAST(max(ns) AS BIGINT) AS syn_n, max(abs(ur / nr - us / ns)) AS d FROM w GROUP BY c)"""


@query(
    "ks_statistic_lineitem",
    f'{CTE}, {ks_sql(NUMBERS)} SELECT c AS "column", real_n, syn_n, round(d, 6) AS ks_stat FROM ks',
)
def _(t):
    return ks_statistic(*_pair(t), NUMBERS)


EVENT_REAL = "SELECT value, value * value AS square FROM {events} WHERE event_type IN ('view', 'click', 'error')"
EVENT_SYN = "SELECT value * 1.01e0 AS value, value * value + 1 AS square FROM {events} WHERE event_type NOT IN ('view', 'click', 'error')"


@query(
    "ks_statistic_events",
    f"WITH real AS ({EVENT_REAL}), syn AS ({EVENT_SYN}), {ks_sql(['value', 'square'])}"
    ' SELECT c AS "column", real_n, syn_n, round(d, 6) AS ks_stat FROM ks',
)
def _(t):
    return ks_statistic(t.sql(EVENT_REAL), t.sql(EVENT_SYN), ["value", "square"])


MOMENTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS c, (SELECT avg({c}) FROM real) AS rm, (SELECT avg({c}) FROM syn) AS sm,
        (SELECT stddev_samp({c}) FROM real) AS rs, (SELECT stddev_samp({c}) FROM syn) AS ss"""
    for c in NUMBERS
)


@query(
    "numeric_distance_lineitem",
    f"""{CTE}, {ks_sql(NUMBERS)}, m AS ({MOMENTS}), x AS (SELECT *, d * sqrt(real_n * syn_n / (real_n + syn_n)) AS z FROM ks),
        p AS (SELECT c, d, CASE WHEN z < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, (SELECT sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * z * z))
                                FROM range(1, 101) t(k)))) END AS pv FROM x)
        SELECT m.c AS "column", round(rm, 6) AS real_mean, round(sm, 6) AS syn_mean, round(rs, 6) AS real_std, round(ss, 6) AS syn_std,
               round(d, 6) AS ks_stat, round(pv, 6) AS ks_pvalue FROM m JOIN p ON m.c = p.c""",
)
def _(t):
    # the limit law at every size, as SQL has no exact one
    return numeric_distance(*_pair(t), NUMBERS, method="asymptotic")


SHARES = f"""{CTE}, u AS (SELECT 'flag' AS c, coalesce(flag, 'nan') AS v, 1 AS r, 0 AS s FROM real UNION ALL SELECT 'flag', coalesce(flag, 'nan'), 0, 1 FROM syn
                     UNION ALL SELECT 'price', price, 1, 0 FROM real UNION ALL SELECT 'price', price, 0, 1 FROM syn
                     UNION ALL SELECT 'line', CAST(line AS VARCHAR), 1, 0 FROM real UNION ALL SELECT 'line', CAST(line AS VARCHAR), 0, 1 FROM syn),
   shares AS (SELECT c, v, sum(r) / (SELECT count(*) FROM real) AS p, sum(s) / (SELECT count(*) FROM syn) AS q FROM u GROUP BY 1, 2)"""
CATEGORIES = ["flag", "price", "line"]


@query(
    "category_shares_lineitem",
    f'{SHARES} SELECT c AS "column", v AS value, round(p, 6) AS real_share, round(q, 6) AS syn_share FROM shares',
)
def _(t):
    return category_shares(*_pair(t), CATEGORIES)


@query(
    "total_variation_lineitem",
    f'{SHARES} SELECT c AS "column", round(0.5 * sum(abs(p - q)), 6) AS tvd FROM shares GROUP BY c',
)
def _(t):
    return total_variation(category_shares(*_pair(t), CATEGORIES))


@query(
    "top_categories_lineitem",
    f"""{SHARES} SELECT c AS "column", 'real' AS side, row_number() OVER (PARTITION BY c ORDER BY p DESC, v) AS position, v AS value, round(p, 6) AS share FROM shares QUALIFY position <= 5
        UNION ALL SELECT c, 'syn', row_number() OVER (PARTITION BY c ORDER BY q DESC, v) AS position, v, round(q, 6) FROM shares QUALIFY position <= 5""",
)
def _(t):
    return top_categories(category_shares(*_pair(t), CATEGORIES))


def corr_sql(side: str, a: str, b: str) -> str:
    if a == b:
        return f"(SELECT CASE WHEN stddev_pop({a}) > 0 THEN 1.0 ELSE 0.0 END FROM {side})"
    return f"coalesce((SELECT corr({a}, {b}) FROM {side}), 0.0)"


CORR_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]]
CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {corr_sql('real', a, b)} AS real_corr, {corr_sql('syn', a, b)} AS syn_corr"
    for a, b in CORR_PAIRS
)


@query(
    "correlation_pairs_lineitem",
    f"{CTE}, k AS ({CORR}) SELECT a, b, round(real_corr, 6) AS real_corr, round(syn_corr, 6) AS syn_corr FROM k",
)
def _(t):
    return correlation_pairs(*_pair(t), NUMBERS)


@query(
    "correlation_mae_lineitem",
    f"""{CTE}, k AS ({CORR}) SELECT round(sum(abs(real_corr - syn_corr) * CASE WHEN a = b THEN 1 ELSE 2 END) / 16, 6) AS numeric_correlation_mae FROM k""",
)
def _(t):
    return correlation_mae(*_pair(t), NUMBERS)


def histogram_sql(side: str, c: str, bins: int) -> str:
    return f"""SELECT '{c}' AS "column", CAST(least(floor(({c} - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS bin,
        lo + least(floor(({c} - lo) / (hi - lo) * {bins}), {bins - 1}) * ((hi - lo) / {bins}) AS bin_low, (hi - lo) / {bins} AS width, k, '{side}' AS side
        FROM {side}, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS k FROM {side}) WHERE {c} IS NOT NULL"""


@query(
    "histogram_overlay_lineitem",
    f"{CTE}, h AS ({' UNION ALL '.join(histogram_sql(s, c, 20) for s in ('real', 'syn') for c in NUMBERS)})"
    """ SELECT "column", bin, round(bin_low, 6) AS bin_low, round(bin_low + width, 6) AS bin_high, CAST(count(*) AS BIGINT) AS n,
        round(count(*) / (k * width), 6) AS density, side FROM h GROUP BY "column", bin, bin_low, width, k, side""",
)
def _(t):
    return histogram_overlay(*_pair(t), NUMBERS)


@query(
    "group_proportion_tvd_lineitem",
    f"{SHARES} SELECT round(0.5 * sum(abs(p - q)), 6) AS group_proportion_tvd FROM shares WHERE c = 'flag'",
)
def _(t):
    return group_proportion_tvd(*_pair(t), "flag")


L1 = f"""{CTE}, g AS (SELECT DISTINCT coalesce(flag, 'nan') AS grp FROM real UNION SELECT DISTINCT coalesce(flag, 'nan') FROM syn),
   lab AS (SELECT DISTINCT price FROM real),
   p AS (SELECT coalesce(flag, 'nan') AS grp, price, count(*) / sum(count(*)) OVER (PARTITION BY coalesce(flag, 'nan')) AS x FROM real GROUP BY 1, 2),
   q AS (SELECT coalesce(flag, 'nan') AS grp, price, count(*) / sum(count(*)) OVER (PARTITION BY coalesce(flag, 'nan')) AS x FROM syn GROUP BY 1, 2),
   l1 AS (SELECT g.grp, sum(abs(coalesce(p.x, 0) - coalesce(q.x, 0))) AS d FROM g CROSS JOIN lab
          LEFT JOIN p ON p.grp = g.grp AND p.price = lab.price LEFT JOIN q ON q.grp = g.grp AND q.price = lab.price GROUP BY 1)"""


@query("group_label_l1_lineitem", f'{L1} SELECT grp AS "group", round(d, 6) AS label_l1 FROM l1')
def _(t):
    return group_label_l1(*_pair(t), "flag", "price")


@query(
    "mean_group_label_l1_lineitem",
    f"{L1} SELECT round(avg(d), 6) AS mean_group_label_distribution_l1 FROM l1",
)
def _(t):
    return mean_group_label_l1(*_pair(t), "flag", "price")


# A fixed rule plays the classifier.
PREDICTED = (
    "SELECT d.source, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS label,"
    " CASE WHEN d.n_chars > 1500 THEN 'good' WHEN d.lang = 'fr' THEN 'odd' ELSE 'poor' END AS prediction"
    " FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
)
F1 = f"""WITH p AS ({PREDICTED}), s AS (
      SELECT label AS c, count(*) AS t, 0 AS q, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS h FROM p GROUP BY 1
      UNION ALL SELECT prediction, 0, count(*), 0 FROM p GROUP BY 1),
    f AS (SELECT c, sum(t) AS t, sum(q) AS q, sum(h) AS h FROM s GROUP BY 1),
    k AS (SELECT c AS label, CASE WHEN q = 0 THEN 0 ELSE h / q END AS precision, CASE WHEN t = 0 THEN 0 ELSE h / t END AS recall,
                 CASE WHEN t + q = 0 THEN 0 ELSE 2 * h / (t + q) END AS f1_score, CAST(t AS BIGINT) AS support FROM f)"""


@query(
    "confusion_matrix_documents",
    f"""WITH p AS ({PREDICTED}) SELECT x.label AS true_label, CAST(count(*) FILTER (prediction = 'good') AS BIGINT) AS pred_good,
        CAST(count(*) FILTER (prediction = 'odd') AS BIGINT) AS pred_odd, CAST(count(*) FILTER (prediction = 'poor') AS BIGINT) AS pred_poor
        FROM (VALUES ('good'), ('odd'), ('poor')) x(label) LEFT JOIN p ON p.label = x.label GROUP BY 1""",
)
def _(t):
    return confusion_matrix(confusion_counts(t.sql(PREDICTED)), ["good", "odd", "poor"])


@query(
    "classification_report_documents",
    f"""{F1}, r AS (SELECT * FROM k
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM k
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM k
        UNION ALL SELECT 'accuracy', avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END), avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END),
                         avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END), count(*) FROM p)
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM r""",
)
def _(t):
    return classification_report(confusion_counts(t.sql(PREDICTED)))


@query(
    "accuracy_and_f1_documents",
    f"""{F1} SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) FROM p), 6) AS accuracy,
        round(avg(f1_score), 6) AS macro_f1 FROM k""",
)
def _(t):
    return accuracy_and_f1(confusion_counts(t.sql(PREDICTED)))


GROUP_F1 = f"""WITH p AS ({PREDICTED}), s AS (
      SELECT source AS g, label AS c, count(*) AS t, 0 AS q, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS h FROM p GROUP BY 1, 2
      UNION ALL SELECT source, prediction, 0, count(*), 0 FROM p GROUP BY 1, 2),
    f AS (SELECT g, c, 2 * sum(h) / (sum(t) + sum(q)) AS f1 FROM s GROUP BY 1, 2),
    b AS (SELECT source AS g, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0 END) AS accuracy FROM p GROUP BY 1),
    seen AS (SELECT b.g, n, accuracy, avg(f1) AS macro_f1 FROM b JOIN f ON b.g = f.g WHERE n >= 5 GROUP BY ALL),
    whole AS (SELECT b.g, n, accuracy, sum(CASE WHEN c IN (SELECT label FROM p) THEN f1 ELSE 0 END) / (SELECT count(DISTINCT label) FROM p) AS macro_f1
              FROM b JOIN f ON b.g = f.g GROUP BY b.g, n, accuracy)"""


@query(
    "group_metrics_seen_labels",
    f'{GROUP_F1} SELECT g AS "group", n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM seen',
)
def _(t):
    return group_metrics(confusion_counts(t.sql(PREDICTED), group="source"), min_n=5, all_labels=False)


@query(
    "group_metrics_all_labels",
    f'{GROUP_F1} SELECT g AS "group", n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM whole',
)
def _(t):
    return group_metrics(confusion_counts(t.sql(PREDICTED), group="source"))


@query(
    "metric_gaps_documents",
    f"""{GROUP_F1} SELECT count(*) AS groups_evaluated, round(max(macro_f1) - min(macro_f1), 6) AS macro_f1_gap_max_minus_min,
        round(max(accuracy) - min(accuracy), 6) AS accuracy_gap_max_minus_min FROM seen""",
)
def _(t):
    return metric_gaps(group_metrics(confusion_counts(t.sql(PREDICTED), group="source"), min_n=5, all_labels=False))


@query(
    "fairness_summary_lineitem",
    f"""{L1}, z AS (SELECT coalesce(flag, '<MISSING>') AS g, price AS label, CASE WHEN quantity > 30 THEN 'high' WHEN quantity > 12 THEN 'mid' ELSE 'low' END AS prediction FROM real),
        s AS (SELECT g, label AS c, count(*) AS t, 0 AS q, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS h FROM z GROUP BY 1, 2
              UNION ALL SELECT g, prediction, 0, count(*), 0 FROM z GROUP BY 1, 2),
        f AS (SELECT g, c, 2 * sum(h) / (sum(t) + sum(q)) AS f1 FROM s GROUP BY 1, 2),
        m AS (SELECT g, sum(CASE WHEN c IN (SELECT label FROM z) THEN f1 ELSE 0 END) / (SELECT count(DISTINCT label) FROM z) AS f1 FROM f GROUP BY g),
        u AS (SELECT coalesce(flag, 'nan') AS v, 1 AS r, 0 AS s FROM real UNION ALL SELECT coalesce(flag, 'nan'), 0, 1 FROM syn),
        sh AS (SELECT v, sum(r) / (SELECT count(*) FROM real) AS p, sum(s) / (SELECT count(*) FROM syn) AS q FROM u GROUP BY 1)
        SELECT FALSE AS skipped, CAST(NULL AS VARCHAR) AS reason, 'flag' AS group_col, round((SELECT 0.5 * sum(abs(p - q)) FROM sh), 6) AS group_proportion_tvd,
               round((SELECT avg(d) FROM l1), 6) AS mean_group_label_distribution_l1, round((SELECT max(f1) - min(f1) FROM m), 6) AS group_macro_f1_gap_max_minus_min""",
)
def _(t):
    real, syn = _pair(t)
    rule = F.when(F.col("quantity") > 30, "high").when(F.col("quantity") > 12, "mid").otherwise("low")
    scored = real.select("flag", F.col("price").alias("label"), rule.alias("prediction"))
    return fairness_summary(real, syn, scored, "flag", "price")


# Kinds of lines play the generators, aggregates over their lines the scores.
SCORES = (
    "SELECT 'gen_' || l_returnflag || l_linenumber AS model, avg(CASE WHEN l_tax > 0.07 THEN 1e0 ELSE 0e0 END) AS any_rule_violation_rate,"
    " avg(l_discount) AS tstr_macro_f1, 0.07e0 AS trtr_macro_f1,"
    " CASE WHEN l_linenumber = 3 THEN NULL ELSE min(l_quantity) END AS exact_overlap_with_real_train_rate,"
    " CASE WHEN l_linenumber = 5 THEN NULL ELSE max(l_tax) - min(l_tax) END AS group_macro_f1_gap_max_minus_min,"
    " CAST(count(*) AS DOUBLE) AS fit_seconds FROM {lineitem} GROUP BY l_returnflag, l_linenumber"
)
SCORE_ORDER = (
    "any_rule_violation_rate ASC NULLS LAST, tstr_macro_f1 DESC NULLS LAST, exact_overlap_with_real_train_rate ASC NULLS LAST,"
    " group_macro_f1_gap_max_minus_min ASC NULLS LAST, fit_seconds ASC NULLS LAST, model"
)


@query(
    "comparison_table_line_kinds",
    f"""WITH s AS ({SCORES}) SELECT model, round(any_rule_violation_rate, 6) AS any_rule_violation_rate, round(tstr_macro_f1, 6) AS tstr_macro_f1,
        round(trtr_macro_f1, 6) AS trtr_macro_f1, round(exact_overlap_with_real_train_rate, 6) AS exact_overlap_with_real_train_rate,
        round(group_macro_f1_gap_max_minus_min, 6) AS group_macro_f1_gap_max_minus_min, round(fit_seconds, 6) AS fit_seconds,
        round(tstr_macro_f1 - trtr_macro_f1, 6) AS tstr_minus_trtr_macro_f1 FROM s""",
)
def _(t):
    return comparison_table(t.sql(SCORES))


@query("winner_line_kinds", f"WITH s AS ({SCORES}) SELECT model FROM s ORDER BY {SCORE_ORDER} LIMIT 1")
def _(t):
    return winner(t.sql(SCORES))


@query(
    "ranked_rows_line_kinds",
    f"""WITH s AS ({SCORES}) SELECT row_number() OVER (ORDER BY {SCORE_ORDER}) AS position, model, round(any_rule_violation_rate, 4) AS violation,
        round(tstr_macro_f1, 4) AS tstr_f1, round(exact_overlap_with_real_train_rate, 4) AS overlap, round(group_macro_f1_gap_max_minus_min, 4) AS fairness_gap FROM s""",
)
def _(t):
    return ranked_rows(t.sql(SCORES))


MODEL_SCORES = (
    "SELECT event_type AS model, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 + length(event_type) END AS position,"
    " avg(CASE WHEN value > 20 THEN 1e0 ELSE 0e0 END) AS accuracy, CASE WHEN event_type = 'error' THEN NULL ELSE max(value) END AS macro_f1,"
    " count(*) AS n_rows_used, CAST(2 AS BIGINT) AS n_features FROM {events} GROUP BY event_type"
)


@query(
    "best_model_events",
    f"""WITH s AS ({MODEL_SCORES}) SELECT model, CAST(position AS BIGINT) AS position, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, n_rows_used, n_features
        FROM s ORDER BY macro_f1 DESC NULLS LAST, position LIMIT 1""",
)
def _(t):
    return best_model(t.sql(MODEL_SCORES))


@query(
    "metrics_lookup_events",
    f"""WITH s AS ({MODEL_SCORES}) SELECT model AS best_model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, n_rows_used, n_features
        FROM s ORDER BY macro_f1 DESC NULLS LAST, position LIMIT 1""",
)
def _(t):
    return metrics_lookup(t.sql(MODEL_SCORES))
