"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    from .chat_format import format_preferences

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sided = turns.withColumn("pair_id", F.expr("conv_id div 2")).withColumn("side", F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected"))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    out = format_preferences(sided)
    return out.select("pair_id", F.col("n_prefix").cast("long").alias("n_prefix"), "prompt", "chosen", "rejected", mask("chosen_mask").alias("chosen_mask"), mask("rejected_mask").alias("rejected_mask"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1, with_ids=False)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


#: The key of the registered queries' surrogates; a user brings a secret one.
SURROGATE_KEY = b"a key for the registered query only"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.transform("entities", lambda e: e["kind"]).alias("kinds"))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that language identification may learn from."""
    return docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(training_rows(docs)), keep=["doc_id"], rejecting=False)
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "lang_pred", "score")


def op6_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import top_inner_products

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_inner_products(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import covered_spans

    out = covered_spans(table(spark, sf_dir, "documents"), window=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")


def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_output import read_tokens, write_tokens

    folder = write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, folder, with_ids=False)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), similarity=0.85, shingle=5).drop("text_digest", "keeper")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_best_fit_packing, op3_token_counts, op4_pii_surrogates, op5_language_id,
        op6_top_inner_products, op7_decontamination, op8_substring_dedup, op9_binary_output, op10_near_dedup,
    )
}

# In DuckDB's dialect. Sets of words or hashes are compared in full, so these serve small tables.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_chat_format": """
        WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k
                   FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT pair_id FROM t GROUP BY pair_id HAVING bool_or(chosen) AND bool_or(NOT chosen)),
        size_ AS (SELECT pair_id, least(max(k) FILTER (WHERE chosen), max(k) FILTER (WHERE NOT chosen)) AS n FROM t JOIN p USING (pair_id) GROUP BY pair_id),
        bad AS (SELECT a.pair_id, min(a.k) - 1 AS n FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.k = b.k AND a.chosen AND NOT b.chosen
                WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
        pre AS (SELECT pair_id, least(size_.n, coalesce(bad.n, size_.n)) AS n_prefix FROM size_ LEFT JOIN bad USING (pair_id)),
        r AS (SELECT t.*, n_prefix, k <= n_prefix AS in_prompt, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN pre USING (pair_id)),
        s AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, chosen, in_prompt ORDER BY k) - length(body) AS begin_,
                sum(length(head) + length(body)) OVER (PARTITION BY pair_id, chosen, in_prompt ORDER BY k) AS end_ FROM r)
        SELECT pair_id, CAST(any_value(n_prefix) AS BIGINT) AS n_prefix,
          coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE chosen AND in_prompt), '') AS prompt,
          coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE chosen AND NOT in_prompt), '') AS chosen,
          coalesce(string_agg(head || body, '' ORDER BY k) FILTER (WHERE NOT chosen AND NOT in_prompt), '') AS rejected,
          coalesce(string_agg(begin_::BIGINT || '-' || end_::BIGINT, ',' ORDER BY k) FILTER (WHERE chosen AND NOT in_prompt AND role = 'assistant'), '') AS chosen_mask,
          coalesce(string_agg(begin_::BIGINT || '-' || end_::BIGINT, ',' ORDER BY k) FILTER (WHERE NOT chosen AND NOT in_prompt AND role = 'assistant'), '') AS rejected_mask
        FROM s GROUP BY pair_id""",
    "op6_top_inner_products": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS g
                FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT doc_id, n, i, w[i : i + n - 1] AS g FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
        m AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
          sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS u(i)),
        first_ AS (SELECT h, min(doc_id) AS first_id FROM win GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, i FROM win JOIN first_ USING (h) WHERE first_id < win.doc_id), unnest(range(i, i + 50)) AS u(p)),
        lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        kept AS (SELECT lists.doc_id, string_agg(w[p], ' ' ORDER BY p) AS words
                 FROM lists JOIN d USING (doc_id), unnest(range(1, len(w) + 1)) AS u(p) WHERE NOT list_contains(ps, p) GROUP BY lists.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
          sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(words, '') END) AS kept_sha256
        FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op10_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS u(i)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
        SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
}
