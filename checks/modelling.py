"""Neighbour distances, classifiers, samplers and whole runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.comparing import ks_sql
from checks.registry import query
from twintable.operators.models import fit_classifier
from twintable.operators.nearest import real_to_real, synthetic_to_real
from twintable.operators.network import BayesNetwork, PrivateBayesNetwork, pair_information
from twintable.operators.privacy import (
    distance_histograms,
    distance_summary,
    privacy_summary,
    suspiciously_close_rate,
)
from twintable.operators.sampling import generate_table, seed_of, timed_generation
from twintable.plans.baseline import run_baseline
from twintable.plans.evaluate import evaluate_generators, score_synthetic, train_and_score
from twintable.session import materialize
from twintable.spec import Roles

REAL = (
    "SELECT CASE WHEN p_size = 13 THEN NULL ELSE p_size END AS size, p_retailprice AS price,"
    " CASE WHEN p_size = 14 THEN NULL ELSE p_type END AS kind, p_brand AS brand, p_name AS label FROM {part}"
)
SYN = (
    "SELECT CASE WHEN p_size = 21 THEN NULL ELSE p_size + 2 END AS size, p_retailprice * 1.01e0 AS price, p_type AS kind,"
    " CASE WHEN p_size = 7 THEN 'Brand#99' ELSE p_brand END AS brand, p_name AS label FROM {part}"
)
POINTS = f"""real AS ({REAL}), syn AS ({SYN}),
    fill AS (SELECT quantile_cont(size, 0.5) AS m FROM real),
    mode AS (SELECT kind FROM real WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1),
    r AS (SELECT row_number() OVER () AS id, coalesce(size, m) AS size, price, coalesce(real.kind, mode.kind) AS kind, brand FROM real, fill, mode),
    s AS (SELECT row_number() OVER () AS id, coalesce(size, m) AS size, price, coalesce(syn.kind, mode.kind) AS kind, brand,
                 CASE WHEN brand IN (SELECT brand FROM real) THEN 2 ELSE 1 END AS wb FROM syn, fill, mode),
    sd AS (SELECT stddev_pop(size) AS a, stddev_pop(price) AS b FROM r),
    sr AS (SELECT s.id, sqrt(min(power((s.size - r.size) / sd.a, 2) + power((s.price - r.price) / sd.b, 2)
                  + CASE WHEN s.kind = r.kind THEN 0 ELSE 2 END + CASE WHEN s.brand = r.brand THEN 0 ELSE s.wb END)) AS d
           FROM s, r, sd GROUP BY s.id),
    rr AS (SELECT s.id, sqrt(min(power((s.size - r.size) / sd.a, 2) + power((s.price - r.price) / sd.b, 2)
                  + CASE WHEN s.kind = r.kind THEN 0 ELSE 2 END + CASE WHEN s.brand = r.brand THEN 0 ELSE 2 END)) AS d
           FROM r AS s, r, sd WHERE s.id <> r.id GROUP BY s.id)"""


def _pair(t):
    return t.sql(REAL), t.sql(SYN)


def _by_distance(distances):
    return distances.groupBy(F.round("distance", 6).alias("distance")).agg(F.sum("n").alias("n"))


@query(
    "nearest_synthetic_to_real_part",
    f"WITH {POINTS} SELECT round(d, 6) AS distance, CAST(count(*) AS BIGINT) AS n FROM sr GROUP BY 1",
)
def _(t):
    return _by_distance(synthetic_to_real(*_pair(t), "label"))


@query(
    "nearest_real_to_real_part",
    f"WITH {POINTS} SELECT round(d, 6) AS distance, CAST(count(*) AS BIGINT) AS n FROM rr GROUP BY 1",
)
def _(t):
    return _by_distance(real_to_real(t.sql(REAL), "label"))


CUSTOMERS = "SELECT c_acctbal AS balance, CAST(c_nationkey AS STRING) AS nation, c_mktsegment AS segment, c_name FROM {customer}"


@query(
    "nearest_real_to_real_customer",
    """WITH c AS (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey AS n, c_mktsegment AS m FROM customer),
            sd AS (SELECT stddev_pop(a) AS a FROM c)
       SELECT round(d, 6) AS distance, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT x.id, sqrt(min(power((x.a - y.a) / sd.a, 2) + CASE WHEN x.n = y.n THEN 0 ELSE 2 END + CASE WHEN x.m = y.m THEN 0 ELSE 2 END)) AS d
         FROM c x, c y, sd WHERE x.id <> y.id GROUP BY x.id) GROUP BY 1""",
)
def _(t):
    return _by_distance(real_to_real(t.sql(CUSTOMERS), "c_name"))


@query(
    "distance_summary_part",
    f"""WITH {POINTS} SELECT 'syn_to_real' AS side, round(min(d), 6) AS min, round(quantile_cont(d, 0.01), 6) AS p01,
        round(quantile_cont(d, 0.5), 6) AS median, round(avg(d), 6) AS mean FROM sr
        UNION ALL SELECT 'real_to_real', round(min(d), 6), round(quantile_cont(d, 0.01), 6), round(quantile_cont(d, 0.5), 6), round(avg(d), 6) FROM rr""",
)
def _(t):
    real, syn = _pair(t)
    syn_real = materialize(synthetic_to_real(real, syn, "label"))
    real_real = materialize(real_to_real(real, "label"))
    return distance_summary(syn_real, "syn_to_real").unionByName(distance_summary(real_real, "real_to_real"))


@query(
    "suspiciously_close_rate_part",
    f"""WITH {POINTS} SELECT round(avg(CASE WHEN d <= (SELECT quantile_cont(d, 0.01) FROM rr) THEN 1.0 ELSE 0 END), 6) AS suspiciously_close_rate FROM sr""",
)
def _(t):
    real, syn = _pair(t)
    return suspiciously_close_rate(
        materialize(synthetic_to_real(real, syn, "label")), materialize(real_to_real(real, "label"))
    )


def bins_sql(side: str, source: str) -> str:
    place = "least(floor((d - lo) / (hi - lo) * 30), 29)"
    return f"""SELECT CAST({place} AS BIGINT) AS bin, lo + {place} * ((hi - lo) / 30) AS bin_low, (hi - lo) / 30 AS width, k, '{side}' AS side
        FROM {source}, (SELECT min(d) AS lo, max(d) AS hi, count(*) AS k FROM {source})"""


@query(
    "distance_histograms_part",
    f"""WITH {POINTS}, h AS ({bins_sql('syn_to_real', 'sr')} UNION ALL {bins_sql('real_to_real', 'rr')})
        SELECT bin, round(bin_low, 6) AS bin_low, round(bin_low + width, 6) AS bin_high, CAST(count(*) AS BIGINT) AS n,
               round(count(*) / (k * width), 6) AS density, side FROM h GROUP BY bin, bin_low, width, k, side""",
)
def _(t):
    real, syn = _pair(t)
    return distance_histograms(
        materialize(synthetic_to_real(real, syn, "label")), materialize(real_to_real(real, "label"))
    )


@query(
    "privacy_summary_part",
    f"""WITH {POINTS}, combos AS (SELECT kind, brand, label FROM real GROUP BY ALL HAVING count(*) <= 2)
        SELECT 0.0::DOUBLE AS exact_overlap_with_real_train_rate,
          round((SELECT count(*) FROM syn JOIN combos c ON syn.kind IS NOT DISTINCT FROM c.kind AND syn.brand = c.brand AND syn.label = c.label) / (SELECT count(*) FROM syn), 6) AS rare_combo_leakage_rate,
          round((SELECT avg(CASE WHEN d <= (SELECT quantile_cont(d, 0.01) FROM rr) THEN 1.0 ELSE 0 END) FROM sr), 6) AS suspiciously_close_rate,
          round((SELECT min(d) FROM sr), 6) AS syn_to_real_min, round((SELECT quantile_cont(d, 0.01) FROM sr), 6) AS syn_to_real_p01,
          round((SELECT quantile_cont(d, 0.5) FROM sr), 6) AS syn_to_real_median, round((SELECT avg(d) FROM sr), 6) AS syn_to_real_mean,
          round((SELECT min(d) FROM rr), 6) AS real_to_real_min, round((SELECT quantile_cont(d, 0.01) FROM rr), 6) AS real_to_real_p01,
          round((SELECT quantile_cont(d, 0.5) FROM rr), 6) AS real_to_real_median, round((SELECT avg(d) FROM rr), 6) AS real_to_real_mean""",
)
def _(t):
    return privacy_summary(*_pair(t), "label", ["kind", "brand"])


LABELLED = (
    "SELECT d.lang, d.n_chars, length(d.text) - length(replace(d.text, ' ', '')) AS words,"
    " CASE WHEN l.toxic = 1 THEN 'yes' ELSE 'no' END AS toxic, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS verdict"
    " FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
)
LINES = (
    "SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status,"
    " CASE WHEN l_extendedprice > 50000 THEN 'high' WHEN l_extendedprice > 20000 THEN 'mid' ELSE 'low' END AS price FROM {lineitem}"
)


@query("logistic_regression_lineitem")
def _(t):
    lines = t.sql(LINES)
    scores, _predictions = train_and_score(
        lines.where("status = 'O'").drop("status"), lines.where("status = 'F'").drop("status"), "price"
    )
    return scores


@query("forest_importances_documents")
def _(t):
    return fit_classifier(t.sql(LABELLED), "verdict", "forest", trees=300).importances(t.spark)


@query("baseline_documents")
def _(t):
    return run_baseline(t.sql(LABELLED), "verdict", "lang").scores


def _bits(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || id), 1, 15))::BIGINT"


def _own(name: str) -> int:
    return seed_of(42, name)


NUMBERED = "d AS (SELECT range AS id FROM range((SELECT count(*) FROM orders))), r AS (SELECT *, row_number() OVER () - 1 AS place, count(*) OVER () AS rows FROM orders)"
ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()


@query(
    "sample_bootstrap_orders",
    f"WITH {NUMBERED} SELECT r.* EXCLUDE (place, rows) FROM d JOIN r ON r.place = {_bits(42)} % (SELECT count(*) FROM orders)",
)
def _(t):
    return generate_table(t.orders, "bootstrap")[0]


def _uniform_values() -> str:
    """Whole numbers and numbers over their range, other values by their rank among those seen."""
    parts, joins = [], []
    for c in ORDERS:
        bits = _bits(_own(c))
        if c in ("o_orderkey", "o_custkey"):
            parts.append(f"(SELECT min({c}) FROM orders) + {bits} % (SELECT max({c}) - min({c}) + 1 FROM orders) AS {c}")
        elif c == "o_totalprice":
            parts.append(f"round((SELECT min({c}) FROM orders) + ({bits} >> 7)::DOUBLE / 9007199254740992.0 * (SELECT max({c}) - min({c}) FROM orders), 6) AS {c}")
        else:
            parts.append(f"v_{c}.v AS {c}")
            joins.append(
                f"JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT {c} AS v FROM orders WHERE {c} IS NOT NULL)) v_{c}"
                f" ON v_{c}.k = {bits} % (SELECT count(DISTINCT {c}) FROM orders)"
            )
    return f"WITH {NUMBERED} SELECT {', '.join(parts)} FROM d {' '.join(joins)}"


@query("sample_uniform_domain_orders", _uniform_values())
def _(t):
    return generate_table(t.orders, "uniform_domain")[0]


def _marginal_values() -> str:
    joins = " ".join(f"JOIN r AS r_{c} ON r_{c}.place = {_bits(_own(c))} % (SELECT count(*) FROM orders)" for c in ORDERS)
    return f"WITH {NUMBERED} SELECT {', '.join(f'r_{c}.{c}' for c in ORDERS)} FROM d {joins}"


@query("sample_marginals_orders", _marginal_values())
def _(t):
    return generate_table(t.orders, "marginals")[0]


@query("sample_marginals_lineitem")
def _(t):
    return generate_table(t.sql(LINES), "marginals")[0]


@query("sample_bayes_network_lineitem")
def _(t):
    return generate_table(t.sql(LINES), "bayes_network")[0]


@query("sample_private_bayes_network_lineitem")
def _(t):
    return generate_table(t.sql(LINES), "private_bayes_network", options={"epsilon": 1.0, "n_iter": 5})[0]


CLERKS = "SELECT o_orderstatus AS status, concat(o_orderstatus, '-', o_custkey) AS clerk, o_orderpriority AS priority FROM {orders}"
CLERK_CODES = """seen AS (SELECT clerk, row_number() OVER (ORDER BY count(*) DESC, clerk) AS turn FROM o GROUP BY clerk),
    coded AS (SELECT o.*, '=' || status AS s, '=' || priority AS p, CASE WHEN turn <= 256 THEN '=' || clerk
        ELSE '#' || (('0x' || substr(md5(clerk), 1, 8))::BIGINT % 64) END AS c FROM o JOIN seen USING (clerk))"""
CLERK_NODES = [("status", ()), ("clerk", ("status",)), ("priority", ("status", "clerk"))]


@query(
    "network_rare_values_orders",
    f"""WITH o AS ({CLERKS}), {CLERK_CODES}
        SELECT s AS status, c AS bucket, clerk AS value, count(*) AS n FROM coded WHERE c LIKE '#%' GROUP BY ALL""",
)
def _(t):
    network = BayesNetwork(structure=CLERK_NODES).fit(t.sql(CLERKS))
    rare = network.rare_values(network.code(t.sql(CLERKS)))
    return rare.select(F.col("_cell._p0").alias("status"), F.col("_cell._value").alias("bucket"), "value", "n")


def _steps(name: str, parents: str) -> str:
    """Cumulative shares of a column's codes given its parents' codes."""
    by = f"PARTITION BY {parents}" if parents else ""
    group = ", ".join(x for x in (parents, name) if x)
    share = f"sum(n) OVER ({by} ORDER BY {name})::DOUBLE / sum(n) OVER ({by})::DOUBLE"
    return f"""{name}_steps AS (SELECT *, lag(upto) OVER ({by} ORDER BY {name}) AS before
        FROM (SELECT *, {share} AS upto FROM (SELECT {group}, count(*) AS n FROM coded GROUP BY {group})))"""


def _u(name: str) -> str:
    return f"(({_bits(_own(name))} >> 7)::DOUBLE / 9007199254740992.0)"


@query(
    "sample_network_orders",
    f"""WITH o AS ({CLERKS}), {CLERK_CODES}, {_steps('s', '')}, {_steps('c', 's')}, {_steps('p', 's, c')},
        d AS (SELECT range AS id FROM range((SELECT count(*) FROM orders))),
        d1 AS (SELECT id, s FROM d JOIN s_steps ON upto > {_u('status')} AND coalesce(before, -1) <= {_u('status')}),
        d2 AS (SELECT id, d1.s, c, n FROM d1 JOIN c_steps k ON k.s = d1.s AND upto > {_u('clerk')} AND coalesce(before, -1) <= {_u('clerk')}),
        d3 AS (SELECT id, d2.s, d2.c, d2.n, p FROM d2 JOIN p_steps k ON k.s = d2.s AND k.c = d2.c AND upto > {_u('priority')} AND coalesce(before, -1) <= {_u('priority')}),
        rare AS (SELECT s, c, clerk, row_number() OVER (PARTITION BY s, c ORDER BY clerk) - 1 AS at FROM coded WHERE c LIKE '#%')
        SELECT substr(d3.s, 2) AS status, coalesce(rare.clerk, substr(d3.c, 2)) AS clerk, substr(p, 2) AS priority FROM d3
        LEFT JOIN rare ON rare.s = d3.s AND rare.c = d3.c AND rare.at = {_bits(seed_of(44, 'clerk'))} % d3.n""",
)
def _(t):
    return generate_table(t.sql(CLERKS), "bayes_network", options={"structure": CLERK_NODES})[0]


def _coded_lineitem() -> str:
    """Codes of all columns of ``lineitem``: bins of 20 quantiles, or values and buckets."""
    marks = ", ".join(str(i / 20) for i in range(21))
    binned = "l_orderkey l_partkey l_suppkey l_quantity l_extendedprice".split()
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont({c}::DOUBLE, [{marks}]))) AS e_{c}" for c in binned)
    codes = [f"len(list_filter(e_{c}[2:-2], lambda e: e <= {c}))::VARCHAR AS {c}" for c in binned]
    codes += [f"{c}::VARCHAR AS {c}" for c in "l_linenumber l_discount l_tax l_returnflag l_linestatus".split()]
    codes.append("CASE WHEN turn <= 256 THEN '=' || day ELSE '#' || (('0x' || substr(md5(day), 1, 8))::BIGINT % 64) END AS l_shipdate")
    return f"""l AS (SELECT *, l_shipdate::VARCHAR AS day FROM lineitem), e AS (SELECT {edges} FROM lineitem),
        days AS (SELECT day, row_number() OVER (ORDER BY count(*) DESC, day) AS turn FROM l GROUP BY day),
        coded AS (SELECT {', '.join(codes)} FROM l JOIN days USING (day), e)"""


LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


def _pairs_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(LINE_COLUMNS) for b in LINE_COLUMNS[i + 1 :]]
    one = " UNION ALL ".join(f"SELECT '{c}' AS c, entropy({c}) AS h FROM coded" for c in LINE_COLUMNS)
    two = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, entropy({a} || '|' || {b}) AS h FROM coded" for a, b in pairs)
    return f"""WITH {_coded_lineitem()}, one AS ({one}), two AS ({two})
        SELECT a, b, round(x.h + y.h - two.h, 6) + 0.0 AS bits FROM two JOIN one x ON x.c = a JOIN one y ON y.c = b"""


@query("pair_information_lineitem", _pairs_sql())
def _(t):
    return pair_information(t.lineitem)


@query(
    "private_network_properties_lineitem",
    """SELECT 'rows' AS property, count(*)::DOUBLE AS value FROM lineitem UNION ALL SELECT 'columns', 11.0 UNION ALL SELECT 'epsilon spent', 1.0
       UNION ALL SELECT 'delta spent', 0.000001 UNION ALL SELECT 'values never seen', 0.0 UNION ALL SELECT 'mechanisms', 4.0""",
)
def _(t):
    network = PrivateBayesNetwork(epsilon=1.0, delta=1e-6, public=False).fit(t.lineitem)
    made = materialize(network.generate())
    flags = made.select(F.col("l_returnflag").alias("v")).union(made.select("l_linestatus")).where("v is not null").distinct()
    real = t.lineitem.select(F.col("l_returnflag").alias("v")).union(t.lineitem.select("l_linestatus")).distinct()
    strange = flags.join(real, "v", "left_anti").agg(F.count(F.lit(1)).cast("double").alias("value"))
    spent = network.ledger.table(t.spark)
    facts = [
        made.agg(F.lit("rows").alias("property"), F.count(F.lit(1)).cast("double").alias("value")),
        strange.select(F.lit("values never seen").alias("property"), "value"),
        spent.agg(F.lit("epsilon spent").alias("property"), F.sum("epsilon").alias("value")),
        spent.agg(F.lit("delta spent").alias("property"), F.sum("delta").alias("value")),
        spent.agg(F.lit("mechanisms").alias("property"), F.count_distinct(F.col("mechanism"), F.col("what").startswith("edges")).cast("double").alias("value")),
        t.spark.range(1).select(F.lit("columns").alias("property"), F.lit(float(len(made.columns))).alias("value")),
    ]
    return reduce(lambda a, b: a.unionByName(b), facts)


@query("generation_facts_lineitem")
def _(t):
    return generate_table(t.sql(LINES), "bootstrap", options={"n_iter": 5})[1]


@query("timed_generation_orders")
def _(t):
    run = timed_generation(t.orders.select("o_orderstatus", "o_orderpriority", "o_totalprice"), "bayes_network")
    return run.five_times.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


GOODS = "SELECT CAST(p_size AS BIGINT) AS size, p_retailprice AS price, p_type AS kind, p_brand AS brand, p_name AS title FROM {part}"
MADE = (
    "SELECT CAST(p_size + 2 AS BIGINT) AS size, p_retailprice * 1.01e0 AS price, CASE WHEN p_size < 5 THEN 'ODD' ELSE p_type END AS kind,"
    " CASE WHEN p_size = 7 THEN 'Brand#99' ELSE p_brand END AS brand, p_name AS title FROM {part}"
)


def _details_sql() -> str:
    """The tables behind a synthetic table's scores as ``report, item, value``."""
    rows = []
    for c in ("size", "price"):
        for side in ("real", "syn"):
            rows += [f"SELECT 'moments', '{c} {side}_mean', (SELECT avg({c}) FROM {side})", f"SELECT 'moments', '{c} {side}_std', (SELECT stddev_samp({c}) FROM {side})"]
    rows += ["SELECT 'numeric_distance', c || ' ks_stat', d FROM ks"]
    for c in ("brand", "title"):
        rows.append(f"""SELECT 'total_variation', '{c}', (SELECT 0.5 * sum(abs(coalesce(a.n, 0) / (SELECT count(*) FROM real) - coalesce(b.n, 0) / (SELECT count(*) FROM syn)))
            FROM (SELECT {c}, count(*) AS n FROM real GROUP BY 1) a FULL JOIN (SELECT {c}, count(*) AS n FROM syn GROUP BY 1) b USING ({c}))""")
    for c in ("kind", "brand", "title"):
        rows.append(f"SELECT 'invalid_category_rates', '{c}', (SELECT avg(CASE WHEN {c} IN (SELECT {c} FROM real) THEN 0.0 ELSE 1.0 END) FROM syn)")
    rows += [
        "SELECT 'validation', 'duplicate_row_rate', (SELECT 1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM syn)) / (SELECT count(*) FROM syn))",
        "SELECT 'validation', 'any_rule_violation_rate', (SELECT avg(CASE WHEN size BETWEEN (SELECT min(size) FROM real) AND (SELECT max(size) FROM real)"
        " AND price BETWEEN (SELECT min(price) FROM real) AND (SELECT max(price) FROM real) AND kind IN (SELECT kind FROM real) AND brand IN (SELECT brand FROM real) THEN 0.0 ELSE 1.0 END) FROM syn)",
        "SELECT 'privacy', 'rare_combo_leakage_rate', (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM rare r WHERE r.kind = s.kind AND r.brand = s.brand AND r.title = s.title) THEN 1.0 ELSE 0.0 END) FROM syn s)",
    ]
    for c, f in {"min": "min(d)", "p01": "quantile_cont(d, 0.01)", "median": "quantile_cont(d, 0.5)", "mean": "avg(d)"}.items():
        rows += [f"SELECT 'privacy', 'syn_to_real_{c}', (SELECT {f} FROM sr)", f"SELECT 'privacy', 'real_to_real_{c}', (SELECT {f} FROM rr)"]
    rows.append("SELECT 'fairness', 'group_proportion_tvd', (SELECT value FROM parts WHERE item = 'brand' AND report = 'total_variation')")
    near = "(({a}.size - r.size) / sd.a) ** 2 + (({a}.price - r.price) / sd.b) ** 2 + CASE WHEN {a}.title = r.title THEN 0 ELSE {k} END + CASE WHEN {a}.brand = r.brand THEN 0 ELSE {b} END"
    known = "CASE WHEN s.{c} IN (SELECT {c} FROM real) THEN 2 ELSE 1 END"
    to_real = near.format(a="s", k=known.format(c="title"), b=known.format(c="brand"))
    return f"""WITH real AS ({GOODS}), syn AS ({MADE}), {ks_sql(["size", "price"])},
        rare AS (SELECT kind, brand, title FROM real GROUP BY ALL HAVING count(*) <= 2), sd AS (SELECT stddev_pop(size) AS a, stddev_pop(price) AS b FROM real),
        si AS (SELECT row_number() OVER () AS id, * FROM syn), ri AS (SELECT row_number() OVER () AS id, * FROM real),
        sr AS (SELECT sqrt(min({to_real})) AS d FROM si s, real r, sd GROUP BY s.id),
        rr AS (SELECT sqrt(min({near.format(a="x", k=2, b=2)})) AS d FROM ri x, ri r, sd WHERE x.id <> r.id GROUP BY x.id),
        parts(report, item, value) AS ({" UNION ALL ".join(rows[:-1])}), whole(report, item, value) AS (SELECT * FROM parts UNION ALL {rows[-1]})
        SELECT report, item, round(value, 6) + 0.0 AS value FROM whole"""


@query("evaluation_details_part", _details_sql())
def _(t):
    real, syn = t.sql(GOODS), t.sql(MADE)
    roles = Roles(target="kind", group="brand", rare_keys=("kind", "brand", "title"))
    _, found = score_synthetic("made", real, real, syn, roles, 1.0)

    def long(report: str, table, key, values):
        item = [F.concat_ws(" ", *([F.col(key)] if key else []), F.lit(v)) if not key or len(values) > 1 or report == "numeric_distance" else F.col(key) for v in values]
        cells = F.array(*[F.struct(F.lit(report).alias("report"), i.alias("item"), F.col(v).cast("double").alias("value")) for i, v in zip(item, values, strict=True)])
        return table.select(F.inline(cells))

    parts = [
        long("moments", found["moments"], "column", ["real_mean", "real_std", "syn_mean", "syn_std"]),
        long("numeric_distance", found["numeric_distance"], "column", ["ks_stat"]),
        long("total_variation", found["total_variation"], "column", ["tvd"]),
        long("invalid_category_rates", found["invalid_category_rates"], "column", ["invalid_rate"]),
        long("validation", found["validation"], None, ["duplicate_row_rate", "any_rule_violation_rate"]),
        long("privacy", found["privacy"], None, ["rare_combo_leakage_rate", *[f"{a}_{b}" for a in ("syn_to_real", "real_to_real") for b in ("min", "p01", "median", "mean")]]),
        long("fairness", found["fairness"], None, ["group_proportion_tvd"]),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("evaluate_generators_documents")
def _(t):
    roles = Roles(target="verdict", group="lang", rare_keys=("lang", "toxic"))
    return evaluate_generators(t.sql(LABELLED), roles).ranking
