"""Value counts, column profiles, summaries, outliers, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from twintable.operators.counts import numeric_counts, quantiles, running_totals, value_counts
from twintable.operators.profile import (
    class_distribution,
    column_profile,
    id_like_columns,
    iqr_outliers,
    numeric_summary,
    range_flags,
    sample_values,
    schema_catalogue,
)

COLUMNS = {
    "lineitem": {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    },
    "orders": {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
    },
    "customer": {
        "c_custkey": "bigint",
        "c_name": "string",
        "c_nationkey": "int",
        "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "documents": {
        "doc_id": "bigint",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "bigint",
    },
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}
ID_NAME = "regexp_matches(lower('{c}'), 'id|uuid|serial|gtin|lot|batch|sku')"


def profile_sql(table: str, target: str, group: str, source: str | None = None) -> str:
    parts = []
    for c, kind in COLUMNS[table].items():
        numeric = kind in ("bigint", "int", "double")
        words = f"lower(trim(CAST({c} AS VARCHAR)))"
        if numeric:
            role = f"CASE WHEN count({c}) = 0 THEN 'unknown' WHEN count(DISTINCT {c}) <= 2 THEN 'binary' ELSE 'numeric' END"
        elif kind != "string":
            role = f"CASE WHEN count({c}) = 0 THEN 'unknown' ELSE 'unknown_type' END"
        else:
            role = (
                f"CASE WHEN count({c}) = 0 THEN 'unknown'"
                f" WHEN bool_and({words} IN ('yes','no','true','false','0','1','y','n')) THEN 'binary'"
                f" WHEN count(DISTINCT {words}) <= greatest(20, floor(0.2 * count({c}))) THEN 'categorical'"
                " ELSE 'text_or_id' END"
            )
        by_ratio = "FALSE" if numeric else f"(count({c}) > 0 AND count(DISTINCT {c}) / count({c}) >= 0.9)"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null_count,"
            f" CAST(count(*) - count({c}) AS BIGINT) AS missing_count,"
            f" round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct,"
            f" CAST(count(DISTINCT {c}) AS BIGINT) AS nunique_non_null, {role} AS inferred_role,"
            f" round(count(DISTINCT {c}) / greatest(1, count({c})), 6) AS nunique_ratio,"
            f" ({ID_NAME.format(c=c)} OR {by_ratio}) AS is_id_like,"
            f" {str(c == target).upper()} AS is_target, {str(c == group).upper()} AS is_group"
            f" FROM {source or table}"
        )
    return "\nUNION ALL\n".join(parts)


@query("column_profile_lineitem", profile_sql("lineitem", "l_returnflag", "l_linestatus"))
def _(t):
    return column_profile(t.lineitem, "l_returnflag", "l_linestatus")


@query("column_profile_orders", profile_sql("orders", "o_orderpriority", "o_orderstatus"))
def _(t):
    return column_profile(t.orders, "o_orderpriority", "o_orderstatus")


@query("column_profile_customer", profile_sql("customer", "c_mktsegment", "c_nationkey"))
def _(t):
    return column_profile(t.customer, "c_mktsegment", "c_nationkey")


@query("column_profile_documents", profile_sql("documents", "lang", "source"))
def _(t):
    return column_profile(t.documents, "lang", "source")


HOLED = (
    "SELECT doc_id, CASE WHEN toxic = 0 THEN quality END AS quality,"
    " CASE WHEN quality = 0 THEN NULL ELSE toxic END AS toxic FROM {labels}"
)


@query(
    "column_profile_missing_values",
    f"WITH holed AS ({HOLED}) " + profile_sql("labels", "quality", "toxic", source="holed"),
)
def _(t):
    return column_profile(t.sql(HOLED), "quality", "toxic")


@query(
    "value_counts_orders",
    """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 2
       UNION ALL SELECT 'o_orderpriority', o_orderpriority, CAST(count(*) AS BIGINT) FROM orders GROUP BY 2
       UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(count(*) AS BIGINT) FROM orders GROUP BY 2""",
)
def _(t):
    return value_counts(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(
    "running_totals_events",
    """WITH c AS (SELECT value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY value)
       SELECT 'value' AS "column", round(value, 6) AS value, CAST(n AS BIGINT) AS n,
              CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS upto_n, CAST(sum(n) OVER () AS BIGINT) AS all_n FROM c""",
)
def _(t):
    return running_totals(numeric_counts(t.events, ["value"]), ["n"])


@query(
    "quantiles_events",
    """SELECT 'value' AS "column", CAST(count(value) AS BIGINT) AS n,
              round(quantile_cont(value, 0.001), 6) AS p0_1, round(quantile_cont(value, 0.25), 6) AS p25,
              round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p99_9 FROM events""",
)
def _(t):
    return quantiles(t.events, ["value"], [0.001, 0.25, 0.5, 0.999])


WITH_GAPS = (
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN NULL"
    " ELSE o_orderpriority END AS priority FROM {orders}"
)


@query(
    "class_distribution_orders",
    f"""SELECT coalesce(priority, '<MISSING>') AS label, CAST(count(*) AS BIGINT) AS count,
               round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS pct FROM ({WITH_GAPS}) GROUP BY 1""",
)
def _(t):
    return class_distribution(t.sql(WITH_GAPS), "priority")


def sample_sql(table: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", value, CAST(row_number() OVER (ORDER BY value) AS BIGINT) AS position"
        f" FROM (SELECT DISTINCT {c} AS value FROM {table} WHERE {c} IS NOT NULL) QUALIFY position <= 15"
        for c in columns
    )


@query("sample_values_customer", sample_sql("customer", ["c_name", "c_mktsegment"]))
def _(t):
    return sample_values(t.customer)


@query("sample_values_documents", sample_sql("documents", ["text", "lang", "source"]))
def _(t):
    return sample_values(t.documents)


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def summary_sql(table: str, columns: list[str]) -> str:
    marks = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean,"
        f" round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,"
        + ", ".join(f" round(quantile_cont(CAST({c} AS DOUBLE), {p}), 6) AS {n}" for n, p in marks.items())
        + f", round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {table}"
        for c in columns
    )


@query("numeric_summary_lineitem", summary_sql("lineitem", NUMBERS))
def _(t):
    return numeric_summary(t.lineitem, NUMBERS)


@query("numeric_summary_part", summary_sql("part", ["p_partkey", "p_size", "p_retailprice"]))
def _(t):
    return numeric_summary(t.part)


def outlier_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS "column", round(q1 - 1.5 * (q3 - q1), 6) AS iqr_low, round(q3 + 1.5 * (q3 - q1), 6) AS iqr_high,
                CAST((SELECT count(*) FROM {source} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outlier_count
                FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
                             count({c}) AS k FROM {source}) WHERE k >= 10 AND q3 <> q1"""
        )
    return "\nUNION ALL\n".join(parts)


@query("iqr_outliers_lineitem", outlier_sql("lineitem", NUMBERS))
def _(t):
    return iqr_outliers(t.lineitem, NUMBERS)


STRETCHED = "SELECT value, value * value * value AS cubed, event_id * 0 AS constant FROM {events}"


@query(
    "iqr_outliers_events",
    f"WITH stretched AS ({STRETCHED}) " + outlier_sql("stretched", ["value", "cubed", "constant"]),
)
def _(t):
    return iqr_outliers(t.sql(STRETCHED))


FLAGGED = (
    "SELECT l_quantity AS order_qty, l_quantity - 2e0 AS net_mass, l_discount * 100 AS discount_pct,"
    " l_tax * 1500 AS tax_percent, l_extendedprice - 5e4 AS amount_pct, l_tax AS plain FROM {lineitem}"
)


@query(
    "range_flags_lineitem",
    f"""WITH f AS ({FLAGGED}), m AS (
          SELECT 'order_qty' AS c, min(order_qty) AS lo, max(order_qty) AS hi FROM f
          UNION ALL SELECT 'net_mass', min(net_mass), max(net_mass) FROM f
          UNION ALL SELECT 'discount_pct', min(discount_pct), max(discount_pct) FROM f
          UNION ALL SELECT 'tax_percent', min(tax_percent), max(tax_percent) FROM f
          UNION ALL SELECT 'amount_pct', min(amount_pct), max(amount_pct) FROM f
          UNION ALL SELECT 'plain', min(plain), max(plain) FROM f)
        SELECT c AS "column", flag FROM (
          SELECT c, CASE WHEN regexp_matches(c, 'mass|weight|co2|amount|qty|quantity') AND lo < 0
                         THEN 'negative_values_in_quantity_like_column'
                         WHEN regexp_matches(c, 'pct|percent') AND (lo < 0 OR hi > 100)
                         THEN 'values_outside_0_100_for_percentage_like_column' END AS flag FROM m)
        WHERE flag IS NOT NULL""",
)
def _(t):
    return range_flags(t.sql(FLAGGED))


@query(
    "recommended_drops_customer",
    """SELECT "column" FROM (""" + profile_sql("customer", "c_mktsegment", "c_nationkey") + """) WHERE is_id_like AND NOT is_target AND NOT is_group""",
)
def _(t):
    profile = column_profile(t.customer, "c_mktsegment", "c_nationkey")
    return profile.where("is_id_like AND NOT is_target AND NOT is_group").select("column")


@query(
    "generator_input_customer",
    "SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer",
)
def _(t):
    return t.customer.drop(*id_like_columns(t.customer, exempt=["c_mktsegment", "c_nationkey"]))


@query(
    "schema_catalogue_orders",
    "SELECT \"column\", dtype, inferred_role, missing_pct, nunique_non_null, is_target, is_group,"
    " CAST(NULL AS VARCHAR) AS flag FROM (" + profile_sql("orders", "o_orderpriority", "o_orderstatus") + ")",
)
def _(t):
    return schema_catalogue(column_profile(t.orders, "o_orderpriority", "o_orderstatus"), range_flags(t.orders))
