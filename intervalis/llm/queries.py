"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervalis.llm import backoff_lm, bootstrap_pii, compact_windows, config_packing, cover_top_k, harmonic_packing, hyper_language, interaction_audit, parity_join, prefix_forest, prefix_trie, source_mixing, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int, value: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == value


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity_join.jaccard_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_texts(_table(spark, sf_dir, "documents"), _fold(10, 0))


#: (verdict, host, path)
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document of its number: block if toxic or of low quality."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    bad = (F.max("toxic") == 1) | (F.min("quality") == 0)
    verdicts = labels.groupBy("doc_id").agg(F.when(bad, "block").otherwise("allow").alias("verdict"))
    labelled = pages.join(verdicts, F.col("page_id") == F.col("doc_id")).select("url", "verdict")
    return url_rules.judge_urls(pages, labelled, URL_RULES)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of at least 50 words of each document that repeat in another; first_doc_id is the least document linked by passages."""
    return compact_windows.repeated_passages(_table(spark, sf_dir, "documents")).withColumnRenamed("first_id", "first_doc_id")


#: How much likelier a document that is labelled good comes early than another, and one labelled bad or toxic.
GOOD, BAD = 2.0, 0.5


def quality_weights(labels: DataFrame) -> DataFrame:
    """(id, weight) of the labelled documents."""
    toxic, good = F.max("toxic") == 1, F.min("quality") == 1
    weight = F.when(toxic, BAD).when(good, GOOD).otherwise(BAD)
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(weight.alias("weight"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix_sources(_table(spark, sf_dir, "documents"), quality_weights(_table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_top_k.top_k_products(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap_pii.find_pii(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_language.identify(_table(spark, sf_dir, "documents"), _fold(4, 2))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_packing.pack_best(_table(spark, sf_dir, "documents"), word_tokenizer_path())


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: A rebuilt conversation takes at most so many first turns of the first of its five.
HEADS = 8


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(id, path): conversations whose first turns are those of conversation id - id % 5."""
    return prefix_trie.with_heads(prefix_trie.paths(conversations, F.col("id") - F.col("id") % 5), HEADS)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(rebuilt_paths(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op1_url_filters": op1_url_filters,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixing": op3_mixing,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op3_mixing": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS size,
                   -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0)
                       / coalesce((SELECT CASE WHEN max(toxic) = 1 THEN 0.5 WHEN min(quality) = 1 THEN 2.0 ELSE 0.5 END FROM labels l WHERE l.doc_id = d.doc_id HAVING count(*) > 0), 1.0) AS key
            FROM documents d),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3.0 * sum(size) AS cap,
                   [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
            FROM docs GROUP BY source),
        levels(step, level) AS (
            SELECT 0, 0::DOUBLE
            UNION ALL
            SELECT step + 1, (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (cap <= level * weight), 0)) / sum(weight) FILTER (cap > level * weight) FROM sources)::DOUBLE
            FROM levels WHERE step <= (SELECT count(*) FROM sources)),
        targets AS (
            SELECT source, source_size, least(cap, weight * (SELECT max_by(level, step) FROM levels WHERE level IS NOT NULL))::DOUBLE AS target FROM sources),
        placed AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
               ((whole + CASE WHEN size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
        FROM placed""",
    "op4_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        e AS (SELECT r, vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM v),
        s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, sum(q.x * d.x)::BIGINT AS score FROM e q JOIN e d ON q.i = d.i AND q.r <> d.r WHERE q.vec_id % 50 = 0 GROUP BY q.r, q.vec_id, d.r, d.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op12_filter_interactions": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        fails AS (
            SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
                   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f
            FROM docs),
        counts AS (
            SELECT part, list_sum(list_transform(f, lambda x, i: CASE WHEN x THEN 1 << (i - 1) ELSE 0 END))::INT AS mask, count(*) AS n,
                   count(*) FILTER (EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)) AS good,
                   count(*) FILTER (EXISTS (FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)) AS toxic
            FROM fails d GROUP BY ALL),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
        orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)),
        steps AS (
            SELECT o AS filter_order, k AS step, x, bit, (SELECT coalesce(sum(y.bit), 0)::INT FROM letters y WHERE contains(o[1:k - 1], y.x)) AS before
            FROM orders, range(1, 6) AS r(k), letters WHERE len(o) = 5 AND o[k:k] = x),
        per AS (
            SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
                   coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS removed, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & before > 0), 0) AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost
            FROM counts, steps GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
        FROM per""",
    "op13_conversation_trie": """
        WITH own AS (
            SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                                 ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        crc_table AS (SELECT b, list_reduce([b::UBIGINT] || [x::UBIGINT FOR x IN range(8)], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) AS r(b)),
        crc_list AS (SELECT list(v ORDER BY b) AS vs FROM crc_table),
        heads AS (
            SELECT conv_id, p, xor(list_reduce([4294967295::UBIGINT] || [ascii(s)::UBIGINT FOR s IN string_split(conv_id::VARCHAR, '')],
                   lambda c, x: xor(c >> 8, vs[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT) % 9 AS h
            FROM own, crc_list),
        built AS (
            SELECT c.conv_id, list_concat(coalesce(b.p, [])[1:c.h::INT], c.p[c.h::INT + 1:]) AS p
            FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
        members AS (SELECT conv_id, len(p) = d AS ends, d, p[1:d::INT] AS node, p[1:greatest(d::INT - 1, 0)] AS up, strlen(p[d::INT].t) AS b FROM built, range(len(p) + 1) AS r(d)),
        nodes AS (
            SELECT d, node, CASE WHEN d > 0 THEN md5(up::VARCHAR) END AS up, md5(node::VARCHAR) AS name, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY d, node, members.up),
        kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
        below AS (
            SELECT m.name, m.d, x.name AS other, any_value(x.n) AS n, any_value(x.b) AS b, any_value(x.d) AS xd, any_value(x.leaf) AS leaf
            FROM (SELECT conv_id, md5(node::VARCHAR) AS name, d FROM members) m
            JOIN (SELECT y.conv_id, y.name, y.d, n.n, n.b, k.n IS NULL AS leaf FROM (SELECT conv_id, md5(node::VARCHAR) AS name, d FROM members) y
                  JOIN nodes n USING (name, d) LEFT JOIN kids k ON k.up = y.name AND k.d = y.d) x ON x.conv_id = m.conv_id AND x.d >= m.d
            GROUP BY m.name, m.d, x.name, x.d),
        sums AS (SELECT name, d, count(*) FILTER (leaf) AS n_leaves, coalesce(sum((n - 1) * b) FILTER (xd > 0), 0) AS saved FROM below GROUP BY ALL)
        SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums s ON s.name = n.name AND s.d = n.d LEFT JOIN nodes q ON q.name = n.up AND q.d = n.d - 1 LEFT JOIN kids k ON k.up = n.name AND k.d = n.d""",
    "op8_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        half AS (SELECT a, b FROM inter JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
        links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN sizes USING (doc_id)
        JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id""",
}
