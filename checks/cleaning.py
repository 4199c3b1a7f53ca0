"""String, boolean and number clean-up, pseudonyms, duplicates, filters, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from twintable.operators import clean
from twintable.operators.clean import align
from twintable.operators.models import class_weights
from twintable.operators.naming import slug_columns, standardize_columns
from twintable.operators.split import run_context, split_rows, tag_split
from twintable.plans.prepare import prepare_flat
from twintable.plans.profile_clean import profile_and_clean
from twintable.sources.tables import conversion_summary, infer_types, null_tokens_to_null
from twintable.spec import Roles


@query(
    "normalize_strings_documents",
    r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM documents",
)
def _(t):
    return clean.normalize_strings(t.documents.select("doc_id", "text"))


@query(
    "normalize_strings_conversations",
    r"SELECT conv_id, turn, role, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM conversations",
)
def _(t):
    return clean.normalize_strings(t.conversations)


TOKENS = (
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'NaN' WHEN '2-HIGH' THEN 'NA'"
    " WHEN '3-MEDIUM' THEN 'None' WHEN '5-LOW' THEN ' none' ELSE o_orderpriority END AS priority,"
    " CASE o_orderstatus WHEN 'P' THEN ' ' WHEN 'F' THEN '' ELSE o_orderstatus END AS status FROM {orders}"
)


@query(
    "null_tokens_orders",
    f"""SELECT o_orderkey, CASE WHEN priority IN ('', ' ', 'nan', 'NaN', 'null', 'NULL', 'none', 'None') THEN NULL ELSE priority END AS priority,
               CASE WHEN status IN ('', ' ', 'nan', 'NaN', 'null', 'NULL', 'none', 'None') THEN NULL ELSE status END AS status
        FROM ({TOKENS})""",
)
def _(t):
    return null_tokens_to_null(t.sql(TOKENS))


AS_TEXT = (
    "SELECT CAST(l_orderkey AS STRING) AS k, CAST(l_quantity AS STRING) AS q, l_returnflag AS f,"
    " CASE WHEN l_linenumber = 1 THEN 'x' ELSE CAST(l_linenumber AS STRING) END AS mixed FROM {lineitem}"
)


@query(
    "infer_types_lineitem",
    """SELECT l_orderkey AS k, l_quantity AS q, l_returnflag AS f,
              CASE WHEN l_linenumber = 1 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS mixed FROM lineitem""",
)
def _(t):
    return infer_types(t.sql(AS_TEXT))


TEMPLATE = (
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN '(Enter ' || source || ')' WHEN lang = 'de' THEN ' (verify, if any) '"
    " WHEN lang = 'es' THEN '(entered) twice' ELSE source END AS source FROM {documents}"
)


@query(
    "null_placeholders_documents",
    rf"""WITH c AS (SELECT doc_id, nullif(trim(regexp_replace(source, '\s+', ' ', 'g')), '') AS source FROM ({TEMPLATE}))
         SELECT doc_id, CASE WHEN regexp_full_match(lower(source), '\((enter|verify).*\)') THEN NULL ELSE source END AS source FROM c""",
)
def _(t):
    return clean.null_placeholders(t.sql(TEMPLATE))


BOOLS = (
    "SELECT doc_id, CASE WHEN quality = 1 THEN ' Yes' ELSE 'n' END AS good,"
    " CASE WHEN toxic = 1 THEN 'TRUE' WHEN quality = 0 THEN NULL ELSE 'F' END AS bad,"
    " CASE WHEN toxic = 1 THEN 'yes' ELSE 'maybe' END AS unsure, CAST(toxic AS STRING) AS digit FROM {labels}"
)


@query(
    "coerce_booleans_labels",
    """SELECT doc_id, CAST(quality AS BIGINT) AS good,
              CASE WHEN toxic = 1 THEN CAST(1 AS BIGINT) WHEN quality = 0 THEN NULL ELSE 0 END AS bad,
              CASE WHEN toxic = 1 THEN 'yes' ELSE 'maybe' END AS unsure, CAST(toxic AS BIGINT) AS digit FROM labels""",
)
def _(t):
    return clean.coerce_booleans(t.sql(BOOLS))


NUMBER_TEXT = (
    "SELECT o_orderkey, CASE WHEN o_orderkey < 1000000 AND o_totalprice < 1500 THEN 'n/a'"
    " ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ',0' END AS mostly,"
    " CASE WHEN o_orderstatus = 'F' THEN 'none yet' ELSE CAST(o_custkey AS STRING) END AS partly FROM {orders}"
)


@query(
    "coerce_numeric_orders",
    f"""WITH s AS ({NUMBER_TEXT.replace('STRING', 'VARCHAR')}),
        r AS (SELECT avg(CASE WHEN try_cast(replace(mostly, ',', '') AS DOUBLE) IS NULL THEN 0.0 ELSE 1 END) AS a,
                     avg(CASE WHEN try_cast(replace(partly, ',', '') AS DOUBLE) IS NULL THEN 0.0 ELSE 1 END) AS b FROM s)
        SELECT o_orderkey, CASE WHEN a > 0.95 THEN try_cast(replace(mostly, ',', '') AS DOUBLE) END AS mostly,
               CASE WHEN b > 0.95 THEN NULL ELSE partly END AS partly FROM s, r""",
)
def _(t):
    return clean.coerce_numeric(t.sql(NUMBER_TEXT))


@query(
    "to_numeric_documents",
    "SELECT doc_id, try_cast(replace(source, 'src', '') AS DOUBLE) AS source, lang FROM documents",
)
def _(t):
    named = t.documents.select("doc_id", F.replace("source", F.lit("src"), F.lit("")).alias("source"), "lang")
    return clean.to_numeric(named, ["source", "absent"])


@query(
    "force_string_part",
    """SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS part_number, CAST(p_size AS VARCHAR) AS size_number,
              p_brand FROM part""",
)
def _(t):
    numbered = t.part.select(
        "p_partkey",
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("part_number"),
        F.col("p_size").alias("size_number"),
        "p_brand",
    )
    return clean.force_string(numbered, suffix="_number")


SPARSE = (
    "SELECT CASE WHEN c_nationkey < 10 THEN c_name END AS a, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS b,"
    " CAST(NULL AS STRING) AS never FROM {customer}"
)


@query(
    "drop_empty_customer",
    f"SELECT a, b FROM ({SPARSE.replace('STRING', 'VARCHAR')}) WHERE a IS NOT NULL OR b IS NOT NULL",
)
def _(t):
    return clean.drop_empty(t.sql(SPARSE))


@query(
    "provenance_region",
    "SELECT r_regionkey, r_name, 'region' AS source_file, 'table' AS source_type FROM region",
)
def _(t):
    return clean.with_provenance(t.region, file="region", type="table")


@query(
    "pseudonyms_customer",
    """SELECT substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS c_custkey, substr(sha256(c_name), 1, 16) AS c_name,
              c_mktsegment FROM customer""",
)
def _(t):
    kept = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return clean.hash_columns(kept, ["c_custkey", "c_name"])


@query("drop_columns_orders", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return clean.drop_columns(t.orders, ["o_custkey", "o_totalprice", "o_orderdate", "absent"])


@query(
    "standardize_columns_nation",
    'SELECT n_nationkey AS nation_key_no, n_name AS "größe_2", n_regionkey AS "größe" FROM nation',
)
def _(t):
    return standardize_columns(t.nation.select("n_nationkey", "n_regionkey", "n_name").toDF(" Nation Key (No.)", "größe", "Größe!"))


@query(
    "slug_columns_nation",
    "SELECT n_nationkey AS nation_key_no, n_name AS grosse, n_regionkey AS grosse_2 FROM nation",
)
def _(t):
    return slug_columns(t.nation.toDF("Nation – Key (No.)", "Grösse", "grosse"))


@query("deduplicate_lineitem_rows", "SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem")
def _(t):
    return clean.deduplicate(t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query(
    "deduplicate_documents_text",
    """SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents
       QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def _(t):
    first = clean.deduplicate(t.documents.select("doc_id", "text", "lang", "source"), ["text"], ["doc_id"])
    return first.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@query(
    "deduplicate_lineitem_first",
    """SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1""",
)
def _(t):
    kept = t.lineitem.select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.deduplicate(kept, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"])


MATERIALS = (
    "SELECT p_partkey, CASE WHEN p_size = 50 THEN NULL ELSE p_size * 2 END AS recycled_content_pct,"
    " CASE p_type WHEN 'ECONOMY' THEN 'Steel' WHEN 'PROMO' THEN 'glass' WHEN 'SMALL' THEN 'composite'"
    " WHEN 'LARGE' THEN NULL ELSE 'plastic' END AS material_main,"
    " CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN NULL WHEN p_brand = 'Brand#3' THEN 0 ELSE 1 END AS compliance_rohs,"
    " CASE WHEN p_brand = 'Brand#4' THEN 1 WHEN p_brand = 'Brand#5' THEN NULL ELSE 0 END AS contains_hazardous_substance"
    " FROM {part}"
)


@query(
    "proxy_label_part",
    f"""SELECT p_partkey, CASE
          WHEN recycled_content_pct < 10 OR contains_hazardous_substance = 1
               OR lower(material_main) IN ('composite', 'mixed_composite', 'unknown') THEN 'Low'
          WHEN recycled_content_pct >= 50
               AND lower(material_main) IN ('aluminum', 'aluminium', 'steel', 'copper', 'glass', 'paper', 'cardboard')
               AND coalesce(compliance_rohs, 1) = 1 AND coalesce(contains_hazardous_substance, 0) = 0 THEN 'High'
          ELSE 'Medium' END AS label FROM ({MATERIALS})""",
)
def _(t):
    return clean.proxy_label(t.sql(MATERIALS), "label").select("p_partkey", "label")


@query(
    "align_part",
    "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part",
)
def _(t):
    shuffled = t.part.select(
        F.col("p_size").cast("string").alias("p_size"), "p_retailprice", "p_type", "p_name", "p_brand", "p_partkey", F.lit(1).alias("extra")
    )
    return align(shuffled, t.part)


@query(
    "union_customer_supplier",
    """SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier""",
)
def _(t):
    left = t.customer.selectExpr("c_custkey key", "c_name name", "c_nationkey nation", "c_mktsegment segment")
    return clean.union_tables([left, t.supplier.selectExpr("s_suppkey key", "s_nationkey nation", "s_name name")])


@query(
    "drop_missing_target_orders",
    "SELECT o_orderkey, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'F'",
)
def _(t):
    holed = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("priority"))
    return clean.drop_missing_target(holed, "priority")


@query(
    "drop_rare_classes_orders",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 5)",
)
def _(t):
    return clean.drop_rare_classes(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 5)


@query(
    "columns_with_nulls_events",
    """SELECT 'event_id' AS "column" FROM events HAVING bool_or(event_id IS NULL)
       UNION ALL SELECT 'gap' FROM events HAVING bool_or(event_type = 'click')
       UNION ALL SELECT 'value' FROM events HAVING bool_or(value IS NULL)""",
)
def _(t):
    holed = t.events.select("event_id", "value", F.when(F.col("event_type") != "click", F.col("ts")).alias("gap"))
    return t.spark.createDataFrame([(c,) for c in clean.columns_with_nulls(holed)], "column string")


def quotas_sql(source: str, label: str, share: float = 0.2) -> str:
    """Largest-remainder quotas of the test set as CTEs ``sizes`` and ``quotas``."""
    return f"""sizes AS (SELECT {label} AS label, count(*) AS k FROM {source} GROUP BY 1),
      total AS (SELECT sum(k) AS n, ceil({share} * sum(k)) AS test_n FROM sizes),
      whole AS (SELECT label, k, floor(k * test_n / n) AS base, k * test_n / n - floor(k * test_n / n) AS rest FROM sizes, total),
      quotas AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
                   <= (SELECT test_n FROM total) - (SELECT sum(base) FROM whole) THEN 1 ELSE 0 END AS quota FROM whole)"""


@query(
    "stratified_split_orders",
    f"""WITH {quotas_sql('orders', 'o_orderpriority')}
        SELECT o_orderkey, o_orderpriority,
               row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || '|42')) <= quota AS is_test
        FROM orders JOIN quotas ON o_orderpriority = label""",
)
def _(t):
    return tag_split(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])


LINES = "SELECT l_returnflag, l_linestatus, CAST(l_suppkey AS STRING) AS supp FROM {lineitem}"


@query(
    "stratified_split_repeated_rows",
    f"""WITH src AS ({LINES.replace('STRING', 'VARCHAR')}), {quotas_sql('src', 'l_returnflag')},
        ranked AS (SELECT src.*, row_number() OVER (PARTITION BY l_returnflag
                     ORDER BY sha256(concat_ws(chr(1), l_returnflag, l_linestatus, supp, '42'))) <= quota AS is_test
                   FROM src JOIN quotas ON l_returnflag = label)
        SELECT l_returnflag, l_linestatus, supp, is_test, CAST(count(*) AS BIGINT) AS n FROM ranked GROUP BY ALL""",
)
def _(t):
    train, test = split_rows(t.sql(LINES), "l_returnflag")
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return both.groupBy(*both.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_context_orders",
    """SELECT CAST(42 AS BIGINT) AS seed, CAST(count(*) AS BIGINT) AS rows_all,
              CAST(count(*) - ceil(0.2 * count(*)) AS BIGINT) AS rows_train, CAST(ceil(0.2 * count(*)) AS BIGINT) AS rows_test,
              'o_orderkey,o_orderpriority' AS columns, 'o_orderpriority' AS target_col, CAST(NULL AS VARCHAR) AS group_col FROM orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderpriority")
    tagged = tag_split(df, "o_orderpriority", ["o_orderkey"])
    context = run_context(df, tagged.where("NOT is_test"), tagged.where("is_test"), "o_orderpriority", None, 42)
    return context.withColumn("columns", F.array_join("columns", ","))


@query(
    "class_weights_orders",
    """SELECT o_orderpriority AS label, round((SELECT count(*) FROM orders) / (count(*) * (SELECT count(DISTINCT o_orderpriority) FROM orders)), 6) AS weight
       FROM orders GROUP BY 1""",
)
def _(t):
    return class_weights(t.orders, "o_orderpriority")


@query(
    "conversion_summary_documents",
    """SELECT source AS source_file, 'table' AS source_type, 'converted' AS status, CAST(count(*) AS BIGINT) AS rows,
              CAST(2 + max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS columns, 'out' AS output_file FROM documents GROUP BY source
       UNION ALL SELECT 'documents', 'combined', 'combined', CAST(count(*) AS BIGINT), CAST(3 AS BIGINT), 'out' FROM documents""",
)
def _(t):
    df = t.documents.select("doc_id", "source", F.when(F.col("lang") == "en", F.col("n_chars")).alias("english"))
    return conversion_summary(df, "table", "converted", "out", "source", filled_only=True).unionByName(
        conversion_summary(df, "combined", "combined", "out", name="documents")
    )


RAW_ORDERS = (
    "SELECT '  ' || o_orderstatus || '  x ' AS `Order Status`, CAST(o_totalprice AS STRING) AS `mass_g`,"
    " CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no ' END AS `Is Final?`, o_orderkey AS `Order Key` FROM {orders}"
)


@query(
    "prepare_flat_orders",
    """SELECT o_orderstatus || ' x' AS order_status, round(o_totalprice, 6) AS mass_g,
              CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS BIGINT) ELSE 0 END AS is_final, o_orderkey AS order_key FROM orders""",
)
def _(t):
    return prepare_flat(t.sql(RAW_ORDERS))


RAW_LINES = (
    "SELECT CAST(l_suppkey AS STRING) AS `Supplier ID`, l_returnflag || '  ' || l_linestatus AS `Flag Pair`,"
    " CASE WHEN l_tax > 0.04 THEN 'TRUE' ELSE 'false' END AS `High Tax`, l_discount AS `discount pct` FROM {lineitem}"
)


@query(
    "profile_and_clean_table",
    """SELECT DISTINCT substr(sha256(CAST(l_suppkey AS VARCHAR)), 1, 16) AS supplier_id, l_returnflag || ' ' || l_linestatus AS flag_pair,
              CASE WHEN l_tax > 0.04 THEN CAST(1 AS BIGINT) ELSE 0 END AS high_tax, round(l_discount, 6) AS discount_pct FROM lineitem""",
)
def _(t):
    return profile_and_clean(t.sql(RAW_LINES), Roles(target="High Tax", hash=("Supplier ID",))).table


@query(
    "profile_and_clean_summary",
    """WITH d AS (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS f, l_tax > 0.04 AS h, l_discount FROM lineitem)
       SELECT (SELECT count(*) FROM lineitem) AS original_rows, CAST(4 AS BIGINT) AS original_cols, count(*) AS cleaned_rows,
              CAST(4 AS BIGINT) AS cleaned_cols, (SELECT count(*) FROM lineitem) - count(*) AS duplicates_removed,
              'Supplier ID,Flag Pair,High Tax,discount pct' AS columns_renamed_from, 'supplier_id,flag_pair,high_tax,discount_pct' AS columns_final,
              'high_tax' AS target_col, CAST(NULL AS VARCHAR) AS group_col, '' AS drop_cols_applied, 'Supplier ID' AS hash_cols_applied,
              CAST(0 AS BIGINT) AS range_flags, 'supplier_id' AS recommended_drop FROM d""",
)
def _(t):
    summary = profile_and_clean(t.sql(RAW_LINES), Roles(target="High Tax", hash=("Supplier ID",))).summary
    lists = [f.name for f in summary.schema if f.dataType.typeName() == "array"]
    return summary.withColumns(
        {c: F.array_join(c, ",") for c in lists} | {"range_flags": F.size("range_flags").cast("bigint")}
    )
