"""Sectioned text and sheet grids."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks.registry import query
from twintable.functions.text import squish
from twintable.operators.documents import (
    carry_section,
    classify_lines,
    documents_to_table,
    explode_lines,
    line_cells,
    merge_cells,
    sectioned_lines,
)
from twintable.operators.sheets import clean_sheet, promote_header

RENDERED = (
    "SELECT o_orderkey, 'DIGITAL PRODUCT PASSPORT for ' || o_orderkey || '\\n====\\n\\nSome opening   remark\\n"
    "1) Order Data (sample)\\n-----\\nCustomer:  ' || o_custkey || '\\nStatus: old\\nStatus: ' || o_orderstatus ||"
    " '\\nDelivery: (Enter delivery)\\n12) Priority & Terms\\r\\n• first ' || o_orderpriority || '\\n• second\\nfree text\\n"
    "Bullet items: reset ' || o_orderstatus || '\\n•• after\\nEND OF DOCUMENT' AS text FROM {orders}"
)


@query(
    "documents_to_table_orders",
    """SELECT o_orderkey AS source_file, 'text' AS source_type,
              'DIGITAL PRODUCT PASSPORT for ' || o_orderkey AS document_title, 'Some opening remark' AS document_header_notes,
              CAST(o_custkey AS VARCHAR) AS order_data_sample_customer, o_orderstatus AS order_data_sample_status,
              'reset ' || o_orderstatus || ' || after' AS priority_terms_bullet_items, 'free text' AS priority_terms_notes FROM orders""",
)
def _(t):
    return documents_to_table(t.sql(RENDERED), "o_orderkey")


@query(
    "document_cells_conversations",
    r"""WITH tidy AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations)
        SELECT conv_id AS file, 'document_header_' || role AS name, arg_max(text, turn) AS value
        FROM tidy WHERE text <> '' GROUP BY conv_id, role""",
)
def _(t):
    lines = t.conversations.select(
        F.col("conv_id").alias("file"),
        F.col("turn").alias("line_no"),
        F.lit("document_header").alias("section"),
        squish(F.concat_ws(": ", "role", "text")).alias("line"),
    )
    return merge_cells(line_cells(classify_lines(lines)))


KIND_SQL = r"""
    lines AS (SELECT doc_id, lang, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS raw
              FROM (SELECT doc_id, lang, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents)),
    tidy AS (SELECT doc_id, lang, line_no, nullif(trim(regexp_replace(raw, '\s+', ' ', 'g')), '') AS line FROM lines),
    kinds AS (SELECT *, CASE
        WHEN line IS NULL THEN 'blank'
        WHEN contains(line, 'END OF DOCUMENT') OR regexp_full_match(line, '[-=]+') THEN 'skip'
        WHEN regexp_full_match(line, '\d+\)\s+.+') THEN 'section'
        WHEN starts_with(line, 'IMPORTANT NOTE') THEN 'note_section'
        WHEN starts_with(line, 'DIGITAL PRODUCT PASSPORT') THEN 'title'
        WHEN starts_with(line, '•') THEN 'bullet'
        WHEN regexp_full_match(line, '[^:]+:\s*.+') THEN 'pair'
        ELSE 'note' END AS kind FROM tidy)"""


@query(
    "line_kinds_documents",
    f"WITH {KIND_SQL} SELECT lang, kind, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(length(line)), 0) AS BIGINT) AS chars FROM kinds GROUP BY 1, 2",
)
def _(t):
    lines = classify_lines(explode_lines(t.documents, "doc_id", "text"))
    return (
        lines.join(t.documents.select(F.col("doc_id").alias("file"), "lang"), "file")
        .groupBy("lang", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("line")), F.lit(0)).alias("chars"))
    )


JOINED_EVENTS = (
    "SELECT user_id, array_join(transform(array_sort(collect_list(struct(event_id, line))), x -> x.line), '\\n') AS text FROM ("
    "SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN '  ' || event_id || ')  Part ' || event_id"
    " WHEN 'error' THEN 'IMPORTANT  NOTE' WHEN 'view' THEN '3) END OF DOCUMENT' ELSE event_type END AS line FROM {events}) GROUP BY user_id"
)


@query(
    "sectioned_lines_events",
    """WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place,
                 CASE event_type WHEN 'signup' THEN 'part_' || event_id WHEN 'error' THEN 'important_note' END AS mark FROM events)
       SELECT user_id AS file, place, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY place
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'document_header') AS section FROM m""",
)
def _(t):
    lines = sectioned_lines(t.sql(JOINED_EVENTS), "user_id", "text").where(F.col("line") != "")
    place = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return lines.select("file", place.alias("place"), "section")


EVENT_LINES = (
    "SELECT user_id AS file, event_id AS line_no, CASE event_type WHEN 'signup' THEN '1) part ' || event_id"
    " WHEN 'error' THEN 'IMPORTANT NOTE' ELSE event_type END AS line FROM {events}"
)


@query(
    "sections_events",
    """WITH m AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'signup' THEN 'part ' || event_id WHEN 'error' THEN 'important_note' END AS mark FROM events)
       SELECT user_id AS file, event_id AS line_no, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'document_header') AS section FROM m""",
)
def _(t):
    return carry_section(classify_lines(t.sql(EVENT_LINES))).select("file", "line_no", "section")


def _grid(t):
    top = t.spark.createDataFrame(
        [
            (1, "Parts list", None, None, None, None, None),
            (2, None, " ", None, None, None, None),
            (3, "Position  Number", "Component Number", "", "VI recommendation", "Never", "Component name"),
            (4, " ", None, None, "", None, None),
        ],
        "row_no bigint, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string",
    )
    body = t.orders.select(
        (F.col("o_orderkey") + 10).alias("row_no"),
        F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("c1"),
        F.concat(F.lit(" 00"), F.col("o_custkey").cast("string")).alias("c2"),
        F.lit("unnamed").alias("c3"),
        F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("c4"),
        F.lit(None).cast("string").alias("c5"),
        F.concat(F.col("o_orderpriority"), F.lit("  part ")).alias("c6"),
    )
    return top.unionByName(body)


@query(
    "promote_header_orders",
    """SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS "Position Number", ' 00' || o_custkey AS "Component Number",
              CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS "VI recommendation",
              CAST(NULL AS VARCHAR) AS "Never", o_orderpriority || '  part ' AS "Component name" FROM orders""",
)
def _(t):
    return promote_header(_grid(t))


@query(
    "clean_sheet_orders",
    """SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS position_number, '00' || o_custkey AS component_number,
              CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS DOUBLE) END AS vi_recommendation,
              o_orderpriority || ' part' AS component_name, 'heat_pump' AS source_product_scope, 'Parts' AS source_sheet,
              'Heat pump_BOM.csv' AS source_file FROM orders""",
)
def _(t):
    return clean_sheet(_grid(t), "Heat pump_BOM.csv", "Parts")
