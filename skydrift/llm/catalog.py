"""One query per operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .hard_negatives import hard_negatives
from .line_dedup import line_dedup
from .lm_score import lm_scores
from .near_dedup import near_duplicates
from .packing import pack
from .pii import KINDS, personal_data
from .quality import quality_rules
from .substring_dedup import repeated_substrings
from .toxicity import toxicity
from .url_filter import host_of, path_of, url_filter
from .vector_codes import books_digest, label_errors, vector_codes
from .vector_dedup import near_duplicate_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINE_DEDUP_SQL = """
    WITH lines AS (
        SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
    heavy AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
    FROM lines LEFT JOIN heavy USING (key) GROUP BY doc_id"""


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1_line_dedup(spark, sf):
    out = line_dedup(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op3_quality_rules")
def op3_quality_rules(spark, sf):
    return quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("broken", "row")


DECONTAMINATION_SQL = r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS span
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
    occ AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
    hit AS (SELECT doc_id, i, occ.n, item_id FROM occ JOIN win USING (n, span)),
    words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM hit) GROUP BY doc_id),
    ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query("op6_decontamination", DECONTAMINATION_SQL)
def op6_decontamination(spark, sf):
    out = decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op4_packing")
def op4_packing(spark, sf):
    return pack(table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op10_toxicity")
def op10_toxicity(spark, sf):
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op9_pii")
def op9_pii(spark, sf):
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    listed = lambda spans: F.array_join(F.transform(
        F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]].alias("k"), s["end"], s["kind"]))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    out = personal_data(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, KINDS[:4]), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


@query("op2_near_dedup")
def op2_near_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id")


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf):
    return repeated_substrings(table(spark, sf, "documents")).drop("spans")


URL_SQL = r"""
    WITH p AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '(:[0-9]*|\.)$', '')) AS host,
                      list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts,
                      TIMESTAMP '2024-01-01' + to_seconds((page_id * 7919) % 2592000) AS fetched_at FROM pages),
    e AS (SELECT CASE event_id % 3 WHEN 0 THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') WHEN 1 THEN host ELSE host || '/' || coalesce(parts[1], '') END AS pattern,
                 CASE event_type WHEN 'error' THEN 'block' WHEN 'purchase' THEN 'allow' ELSE 'none' END AS verdict, date_trunc('minute', ts) AS effective_at
          FROM events JOIN p ON page_id = user_id WHERE ts IS NOT NULL AND host <> ''),
    one AS (SELECT pattern, effective_at AS valid_from, min(verdict ORDER BY verdict) FILTER (verdict <> 'none') AS top, count(*) FILTER (verdict = 'block') AS blocks, count(*) FILTER (verdict = 'allow') AS allows
            FROM e GROUP BY 1, 2),
    v AS (SELECT pattern, CASE WHEN blocks > 0 THEN 'block' WHEN allows > 0 THEN 'allow' ELSE 'none' END AS verdict, valid_from, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM one),
    k AS (SELECT page_id, url, fetched_at, array_to_string(list_slice(string_split(host, '.'), -i, -1), '.') AS pattern, i AS rank
          FROM (SELECT *, unnest(range(least(2, len(string_split(host, '.'))), len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
          UNION ALL
          SELECT page_id, url, fetched_at, host || '/' || array_to_string(list_slice(parts, 1, i), '/'), i + 1000 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p WHERE host <> '')),
    hit AS (SELECT page_id, rank, k.pattern, verdict FROM k JOIN v ON k.pattern = v.pattern AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) WHERE verdict <> 'none'),
    best AS (SELECT page_id, arg_max(verdict, rank) AS verdict, arg_max(pattern, rank) AS pattern, count(DISTINCT pattern) AS n_active FROM hit GROUP BY page_id)
    SELECT page_id, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(verdict, 'none') AS verdict, pattern, coalesce(n_active, 0) AS n_active FROM p LEFT JOIN best USING (page_id)"""


@query("op8_url_filter", URL_SQL)
def op8_url_filter(spark, sf):
    """Pages have no times and there is no list, so both are derived: a capture's time from its id, list entries from events about the page of that user's number."""
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    pages = table(spark, sf, "pages").select("page_id", "url", F.timestamp_seconds(start + (F.col("page_id") * 7919) % 2592000).cast("timestamp_ntz").alias("fetched_at"))
    host, first = host_of(F.col("url")), F.filter(F.split(path_of(F.col("url")), "/"), lambda p: p != "")
    labels = F.split(host, r"\.")
    pattern = (
        F.when(F.col("event_id") % 3 == 0, F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), 3), "."))
        .when(F.col("event_id") % 3 == 1, host).otherwise(F.concat(host, F.lit("/"), F.coalesce(F.get(first, F.lit(0)), F.lit("")))))
    entries = (
        table(spark, sf, "events").join(pages.withColumnRenamed("page_id", "user_id"), "user_id").where(host != "")
        .select(pattern.alias("pattern"), F.when(F.col("event_type") == "error", "block").when(F.col("event_type") == "purchase", "allow").otherwise("none").alias("verdict"),
                F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("effective_at")))
    return url_filter(pages, entries).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


@query("pipeline")
def pipeline(spark, sf):
    from corpus_pipeline import run

    return run(spark, sf)


@query("op7_lm_score")
def op7_lm_score(spark, sf):
    import public_tokenizers

    return lm_scores(table(spark, sf, "documents"), (tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


USABLE_SQL = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

NEGATIVES_SQL = f"""
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND {USABLE_SQL}),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark, sf):
    items = table(spark, sf, "embeddings")
    items = items.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(items, F.col("vec_id") % 50 == 0)


def codes_sql(rounds: int = 4) -> str:
    """Each round is two steps: assign every part to its nearest entry, then replace the entries by the floored means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT vec_id, p, x.v, min((list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v))::BIGINT * 256 + e) AS best FROM parts x JOIN book{k} b USING (p) GROUP BY ALL)")
        if k < rounds:
            steps.append(f"mean{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, best % 256 AS e, i, floor(sum(x) / count(*)) AS m FROM (SELECT p, best, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{k}) GROUP BY ALL) GROUP BY p, e)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e))")
    return f"""
    WITH r AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE {USABLE_SQL}),
    parts AS MATERIALIZED (SELECT vec_id, p, list_slice(q, p * (len(q) // 4) + 1, (p + 1) * (len(q) // 4)) AS v FROM (SELECT *, unnest(range(4)) AS p FROM r)),
    book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts QUALIFY e < 256),
    {", ".join(steps)},
    coded AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
    FROM coded JOIN r USING (vec_id)"""


@query("op12_vector_codes", codes_sql())
def op12_vector_codes(spark, sf):
    coded, books = vector_codes(table(spark, sf, "embeddings"), carry=["label"])
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


VECTOR_LINKS_SQL = f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {USABLE_SQL} AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0),
    link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept
    FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) USING (vec_id)"""


@query("op13_vector_dedup", VECTOR_LINKS_SQL)
def op13_vector_dedup(spark, sf):
    return near_duplicate_vectors(table(spark, sf, "embeddings"))
