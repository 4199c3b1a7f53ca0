"""A query for each operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from twintable.llm import byte_bpe, chat_template, decontaminate, hash_tree, merkle, metric_join, ngram_join, posting_lists, secret_scan, suffix_dedup, toxicity, vector_codes, warc
from twintable.llm.common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_hash_tree(spark, sf_dir):
    return hash_tree.hash_tree_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 24)


@query
def op8_edit_matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        F.col("items.item_id").alias("item_ids"),
        F.array_min("items.distance").cast("long").alias("least_distance"),
    )


@query
def op9_secret_owners(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, "doc_id", "text", F.col("source"), F.concat_ws("/", "source", "lang"))


@query
def op10_chat_template(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return chat_template.chat_digests(chat_template.format_conversations(rows.union(more)))


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_jaccard(table(spark, sf_dir, "documents"))


@query
def op7_metric_join(spark, sf_dir):
    return metric_join.metric_join(table(spark, sf_dir, "embeddings"))


@query
def op4_warc(spark, sf_dir):
    folder = scratch(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    back = warc.read_warc(spark, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")



@query
def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"), "doc_id", "text", byte_bpe.public_ranks())


@query
def op2_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.withColumn("repeated", F.col("n_removed") > 0)


@query
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    rows = merkle.manifest(docs, changed={"text": merkle.lowered(F.col("doc_id"), F.col("text"))})
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("way")).alias("proof_sha256"), "folded_root", "verified")


def _sized(text: str) -> str:
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sized(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE checksummed AS (
    -- CRC-32 bit by bit: a byte comes in, then eight shifts, each marked by -1
    SELECT *, xor(4294967295, list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''),
        lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
    FROM documents
), leaves AS (
    SELECT row_number() OVER () AS id, doc_id, lang, {_leaf("text")} AS leaf,
        CASE WHEN crc % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS found
    FROM checksummed
), places AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes AS (
    SELECT lang, 0 AS level, place AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS hash FROM places
    UNION ALL
    SELECT lang, level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8
), subroots AS (
    SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS turn FROM nodes WHERE n = 1
), crown AS (
    SELECT 0 AS level, turn AS pos, count(*) OVER () AS n, subroot AS hash FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 8
), steps AS (
    SELECT id, x.level AS step, coalesce(string_agg(hash, '' ORDER BY pos) FILTER (pos < (place >> 3 * x.level)), '') AS before,
        coalesce(string_agg(hash, '' ORDER BY pos) FILTER (pos > (place >> 3 * x.level)), '') AS after
    FROM (SELECT id, p.lang, level, place FROM places p, (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) l WHERE l.lang IS NOT DISTINCT FROM p.lang) x
    JOIN nodes n ON n.lang IS NOT DISTINCT FROM x.lang AND n.level = x.level AND n.pos // 8 = (place >> 3 * x.level) // 8
    GROUP BY id, x.level
    UNION ALL
    SELECT id, 1000 + x.level, coalesce(string_agg(hash, '' ORDER BY pos) FILTER (pos < (turn >> 3 * x.level)), ''),
        coalesce(string_agg(hash, '' ORDER BY pos) FILTER (pos > (turn >> 3 * x.level)), '')
    FROM (SELECT id, level, turn FROM places p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, (SELECT DISTINCT level FROM crown WHERE n > 1)) x
    JOIN crown c ON c.level = x.level AND c.pos // 8 = (turn >> 3 * x.level) // 8
    GROUP BY id, x.level
), ways AS (
    SELECT p.*, subroot, coalesce(way, []) AS way, (SELECT hash FROM crown WHERE n = 1) AS root
    FROM places p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN (SELECT id, list({{'b': before, 'a': after}} ORDER BY step) AS way FROM steps GROUP BY id) USING (id)
), folds AS (
    SELECT id, 1 AS k, found AS h FROM ways
    UNION ALL
    SELECT f.id, k + 1, sha256(way[k].b || h || way[k].a) FROM folds f JOIN ways w ON w.id = f.id WHERE k <= len(way)
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(way, lambda s: s.b || s.a), ''), '')) AS proof_sha256,
    h AS folded_root, h = root AS verified
FROM ways JOIN folds ON folds.id = ways.id AND k = len(way) + 1
"""


@query
def op11_posting_lists(spark, sf_dir):
    return posting_lists.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op12_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int = 2) -> str:
    """Codebooks ``c0`` to ``c<rounds>`` by part, entry and position, and assignments to each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS (
    SELECT id, x.part, entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c ON c.part = x.part AND c.j = x.j GROUP BY id, x.part, entry
), near{r} AS (
    SELECT id, part, min(d) AS d, arg_min(entry, d * 64 + entry) AS entry FROM far{r} GROUP BY id, part
)""")
        if r < rounds:  # floor(s / n) in whole numbers
            steps.append(f"""sums{r} AS (
    SELECT n.part, n.entry, x.j, sum(x.v) AS s, count(*) AS n FROM near{r} n JOIN x ON x.id = n.id AND x.part = n.part GROUP BY ALL
), c{r + 1} AS (
    SELECT c.part, c.entry, c.j, CASE WHEN n IS NULL THEN c.v ELSE ((s - ((s % n) + n) % n) // n)::bigint END AS v FROM c{r} c LEFT JOIN sums{r} USING (part, entry, j)
)""")
    return ", ".join(steps)


ORACLES["op12_vector_codes"] = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, embedding, len(embedding) // 16 AS w
    FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding) AND len(embedding) > 0
), x AS MATERIALIZED (
    SELECT id, (i - 1) // w AS part, (i - 1) % w AS j, floor(256 * embedding[i]::double)::bigint AS v
    FROM (SELECT id, w, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), c0 AS (
    SELECT part, id AS entry, j, v FROM x WHERE id < 64
), {_lloyd_sql()}, coded AS (
    SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM near2 GROUP BY id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
    (SELECT sha256(string_agg(v::varchar, ',' ORDER BY part, entry, j)) FROM c2) AS codebooks_sha256
FROM kept JOIN coded USING (id)
"""
