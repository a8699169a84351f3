"""The registered queries of the numbered operators, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.records import record_digests

    return record_digests(spark, table(spark, sf_dir, "documents"), word_bpe())


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.lengths import histogram, with_suffix_sums

    return with_suffix_sums(histogram(table(spark, sf_dir, "documents"), word_bpe()))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.signature_tree import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
    FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (na + nb - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""

def op2_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.pivots import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
components AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN components c ON c.a = e.vec_id LEFT JOIN counts k ON k.a = e.vec_id
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("k1", "k2")


OP6_SQL = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS m FROM items WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t
    FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT m FROM windows),
grams AS (
    SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)),
found AS (SELECT g.doc_id, g.m, g.i, x.item_id FROM grams g JOIN windows x ON g.m = x.m AND g.t = x.t),
hit AS (
    SELECT doc_id, count(*) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.sentence_spans import remove_repeated_spans

    return remove_repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.conversations import rendered

    return rendered(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH turns AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
lines AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
        '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM turns),
prefixes AS (
    SELECT conv_id, n, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY n) AS chat FROM lines),
ends AS (SELECT conv_id, max(n) AS n FROM prefixes GROUP BY conv_id),
whole AS (SELECT p.conv_id, p.n, p.chat FROM prefixes p JOIN ends e ON p.conv_id = e.conv_id AND p.n = e.n),
inner_ones AS (
    SELECT DISTINCT p.n, p.chat FROM prefixes p JOIN ends e ON p.conv_id = e.conv_id AND p.n < e.n),
kept AS (SELECT min(conv_id) AS conv_id, n, chat FROM whole GROUP BY n, chat)
SELECT k.conv_id, k.n AS n_turns, k.chat FROM kept k
WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.n = k.n AND i.chat = k.chat)
"""


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"), word_bpe())


def op10_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes in SQL. A byte's table entry is the sum without carry of those of
    its bits: 0x77073096 for the lowest, and so on."""
    bits = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)
    value = "c >> 8"
    for i, entry in enumerate(bits):
        value = f"xor({value}, ((xor(c, b) >> {i}) & 1) * {entry})"
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {value}))"


def op11_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.sharding import shard_digests

    return shard_digests(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size,
        (('0x' || md5(coalesce(text, ''))[1:8])::BIGINT << 30)
            + (('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT >> 2) AS key
    FROM documents),
sums AS (SELECT key, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY key),
runs AS (SELECT key, s, CAST(sum(s) OVER (ORDER BY key) AS BIGINT) - s AS before FROM sums),
total AS (SELECT CAST(sum(s) AS BIGINT) AS t FROM sums),
wanted AS (
    SELECT k, t, key AS x FROM (SELECT unnest(range(1, 24)) AS k), total, runs
    WHERE 24 * before <= k * t AND k * t < 24 * (before + s)),
probes AS (
    SELECT k, t, shift, (x >> shift) << shift AS lo, ((x >> shift) << shift) + (1::BIGINT << shift) AS hi
    FROM wanted, (SELECT unnest([46, 38, 30, 20, 10, 0]) AS shift)),
counted AS (
    SELECT k, shift, lo, hi, t,
        k * t - 24 * coalesce((SELECT sum(s) FROM sums WHERE key < lo), 0) AS below,
        24 * coalesce((SELECT sum(s) FROM sums WHERE key < hi), 0) - k * t AS above
    FROM probes),
cuts AS (
    SELECT k, arg_max(CASE WHEN below <= above THEN lo ELSE hi END, shift) AS cut FROM counted
    WHERE least(below, above) * 200 <= t OR shift = 0 GROUP BY k),
placed AS (SELECT *, CAST((SELECT count(*) FROM cuts WHERE cut <= key) AS INTEGER) AS shard FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, {crc32_sql('text')} AS text_crc32, 'bytes' AS law, shard,
    CAST(row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, text) - 1 AS BIGINT) AS slot,
    CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


def op12_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from bitcurve.llm.alignment import alignment_digests

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment_digests(table(spark, sf_dir, "documents"), *paths)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitcurve.llm.spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(
        unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
hashed AS (SELECT r, {crc32_sql("doc || ':' || r")} AS h, length(r) AS k FROM runs WHERE length(r) >= 6),
words AS (
    SELECT CASE WHEN h % 199 = 0 THEN substring(r, 1, h % k) || substring(r, h % k + 2, k) ELSE r END AS word FROM hashed),
counts AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
places AS (SELECT word, length(word) AS k, unnest(range(1, length(word) + 1)) AS i FROM counts),
holes AS (
    SELECT word, i, substring(word, 1, i - 1) AS a, substring(word, i + 1, k) AS b FROM places),
shorter AS (SELECT DISTINCT h.word, c.word AS near FROM holes h JOIN counts c ON h.a || h.b = c.word),
pairs AS (
    SELECT x.word, y.word AS near FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION ALL SELECT word, near FROM shorter UNION ALL SELECT near, word FROM shorter),
ranked AS (
    SELECT p.word, p.near, c.n AS m, row_number() OVER (PARTITION BY p.word ORDER BY c.n DESC, p.near) AS place,
        count(*) OVER (PARTITION BY p.word) AS n_near
    FROM pairs p JOIN counts c ON c.word = p.near),
forms AS (
    SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * c.n THEN near END AS form,
        CASE WHEN m >= 5 * c.n THEN m END AS form_n
    FROM counts c LEFT JOIN ranked r ON r.word = c.word AND r.place = 1),
steps AS (
    SELECT word, word AS root FROM forms
    UNION SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN ends e ON e.word = f.word
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_records,
        op2_pivot_dedup,
        op3_length_histogram,
        op4_toxicity,
        op5_ngram_jaccard,
        op6_decontamination,
        op7_sentence_spans,
        op8_chat_snapshots,
        op9_best_fit,
        op10_co_training,
        op11_histogram_sort,
        op12_shared_cuts,
        op13_spelling_variants,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op2_pivot_dedup": OP2_SQL,
    "op5_ngram_jaccard": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_chat_snapshots": OP8_SQL,
    "op11_histogram_sort": OP11_SQL,
    "op13_spelling_variants": OP13_SQL,
}
