"""The registered queries of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import (
    chat,
    fingerprints,
    html_text,
    licenses,
    minhash_dedup,
    mixing,
    packing,
    periodic_runs,
    pii,
    quality,
    topk,
    toxicity,
    whitening,
)
from knotwork.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def word_vocabulary() -> str:
    """Place of the public vocabulary of the packing query; imported when it is needed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_minhash_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), word_vocabulary())


@query("op3_fingerprints")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, folder, "documents"))


TOP_SQL = """
WITH known AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS BIGINT) AS score
    FROM known q JOIN known c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op4_top_k", TOP_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(table(spark, folder, "embeddings"))


@query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.importance_resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


# A conversation whose texts hold the markers themselves.
MARKER_CONVERSATION = -1
MARKER_TEXT = f"{chat.END}{chat.START}assistant ok"

CHAT_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {MARKER_CONVERSATION}, 0, 'user', '{MARKER_TEXT}'
    UNION ALL SELECT {MARKER_CONVERSATION}, 1, 'assistant', '{MARKER_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    CAST(sum({len(chat.START) + len(chat.END) + 2} + length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query("op6_chat", CHAT_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    marked = [("user", 0), (chat.LOSS_ROLE, 1)]
    rows = [
        F.struct(
            F.lit(MARKER_CONVERSATION).cast("long").alias("conv_id"),
            F.lit(turn).cast("long").alias("turn"),
            F.lit(role).alias("role"),
            F.lit(MARKER_TEXT).alias("text"),
        )
        for role, turn in marked
    ]
    own = spark.range(1).select(F.inline(F.array(*rows)))
    typed = turns.unionByName(own).withColumn("parts", chat.text_part(F.col("text")))
    return chat.digest(chat.format_conversations(typed))


@query("op7_html_text")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(table(spark, folder, "pages"))


MIX_SQL = f"""
WITH sizes AS (
    SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), weighed AS (
    SELECT source, size, pow(size, {mixing.TEMPERATURE}) AS weight FROM sizes
), rated AS (
    SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM weighed)
        * (SELECT sum(size) FROM weighed) / size ELSE 1.0 END AS rate FROM weighed
), stepped AS (
    SELECT source, greatest(1, CAST(ceil(rate / {mixing.MEAN_STEP}) AS INTEGER)) AS steps,
        rate / greatest(1, CAST(ceil(rate / {mixing.MEAN_STEP}) AS INTEGER)) AS mean FROM rated
), events AS (
    SELECT source, steps, mean, unnest(generate_series(0, CAST(ceil(mean + 10 * sqrt(mean) + 20) AS INTEGER))) AS k FROM stepped
), tables AS (
    SELECT source, steps, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM events
), draws AS (
    SELECT doc_id, d.source, text, lang, n_chars, unnest(generate_series(1, steps)) AS step
    FROM documents d JOIN stepped s ON d.source IS NOT DISTINCT FROM s.source
), hashed AS (
    SELECT *, (CAST(concat('0x', substr(md5(concat('{mixing.SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', step)), 1, 12)) AS BIGINT) + 0.5)
        / 281474976710656.0 AS u FROM draws
), counted AS (
    SELECT doc_id, text, lang, h.source, n_chars, sum((SELECT count(*) FROM tables t WHERE t.source IS NOT DISTINCT FROM h.source AND t.p <= h.u)) AS n
    FROM hashed h GROUP BY doc_id, text, lang, h.source, n_chars
), copies AS (
    SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(0, CAST(n AS BIGINT) - 1)) AS INTEGER) AS copy FROM counted WHERE n > 0
)
SELECT *, (CAST(concat('0x', substr(md5(concat('{mixing.SEED + 1}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', copy)), 1, 12)) AS BIGINT) + 0.5)
    / 281474976710656.0 AS shuffle_key
FROM copies
"""


@query("op8_mix_sources", MIX_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


# A document of so few words that states a license stands for a licence file of its language's directory.
LICENSE_FILE_WORDS = 25


def license_files(documents: DataFrame) -> DataFrame:
    """doc_id, path, text: documents as files /source/lang/thousand/doc_id.txt and /source/lang/LICENSE-doc_id."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n]+"), ""))
    short = (words <= LICENSE_FILE_WORDS) & F.coalesce(F.col("text").rlike(licenses.HEADER), F.lit(False))
    root = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"))
    number = F.col("doc_id").cast("string")
    folder = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.when(short, F.concat(root, F.lit("LICENSE-"), number)).otherwise(F.concat(root, folder, F.lit("/"), number, F.lit(".txt")))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text")


def _license_sql() -> str:
    idf, other, rows = licenses.template_weights(licenses.TEMPLATES)
    header = licenses.HEADER.replace("(?i)", "")
    weights = ", ".join(f"({n}, '{l}', '{t}', {w!r})" for n, l, t, w in rows)
    terms = ", ".join(f"('{t}', {w!r})" for t, w in idf.items())
    return f"""
WITH weights(template, license, term, weight) AS (VALUES {weights}),
idf(term, idf) AS (VALUES {terms}),
named AS (
    SELECT doc_id, text, concat('/', coalesce(source, ''), '/', coalesce(lang, ''), '/') AS root,
        len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n]+'), lambda x: x <> '')) <= {LICENSE_FILE_WORDS}
            AND regexp_matches(coalesce(text, ''), '{header}', 'i') AS short
    FROM documents
), files AS (
    SELECT doc_id, text, CASE WHEN short THEN concat(root, 'LICENSE-', doc_id)
        ELSE concat(root, CAST(floor(doc_id / 1000) AS BIGINT), '/', doc_id, '.txt') END AS path,
        CASE WHEN short THEN rtrim(root, '/') ELSE concat(root, CAST(floor(doc_id / 1000) AS BIGINT)) END AS dir, short FROM named
), lines AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS header
    FROM files WHERE regexp_matches(text, '{header}', 'i')
), headers AS (
    SELECT * FROM lines WHERE regexp_matches(header, '{header}', 'i')
), terms AS (
    SELECT doc_id, line, unnest(regexp_extract_all(lower(header), '{licenses.TERM}')) AS term FROM headers
), weighed AS (
    SELECT doc_id, line, t.term, count(*) * coalesce(max(idf.idf), {other!r}) AS w
    FROM terms t LEFT JOIN idf ON t.term = idf.term GROUP BY doc_id, line, t.term
), norms AS (
    SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY doc_id, line
), scored AS (
    SELECT w.doc_id, w.line, template, license, round(sum(w.w * weight) / max(norm), 9) AS similarity
    FROM weighed w JOIN weights ON w.term = weights.term JOIN norms n ON w.doc_id = n.doc_id AND w.line = n.line
    GROUP BY w.doc_id, w.line, template, license
), own AS (
    SELECT doc_id, license, similarity FROM scored WHERE similarity >= {licenses.LEAST_COSINE}
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, license) = 1
), held AS (
    SELECT f.doc_id, f.path, f.dir, f.short, o.license, o.similarity FROM files f LEFT JOIN own o ON f.doc_id = o.doc_id
), givers AS (
    SELECT dir AS above, license, similarity, path FROM held WHERE license IS NOT NULL AND short
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, license, path) = 1
), nearest AS (
    SELECT h.doc_id, g.license, g.similarity, g.path FROM held h JOIN givers g
        ON h.dir = g.above OR starts_with(h.dir, concat(g.above, '/')) WHERE h.license IS NULL
    QUALIFY row_number() OVER (PARTITION BY h.doc_id ORDER BY length(g.above) DESC) = 1
)
SELECT h.doc_id, h.path, coalesce(h.license, n.license) AS license,
    CASE WHEN h.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    coalesce(h.similarity, n.similarity) AS similarity,
    CASE WHEN h.license IS NOT NULL THEN h.path ELSE n.path END AS license_path
FROM held h LEFT JOIN nearest n ON h.doc_id = n.doc_id
"""


@query("op10_licenses", _license_sql())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(license_files(table(spark, folder, "documents")), "doc_id")


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op12_pii")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, folder, "documents")))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.repeated_runs(table(spark, folder, "documents"), edit=True)
