"""The thin ``opN_<name>`` queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, html_text, language, line_dedup, media, mixing, secrets, simhash, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


#: The rules of the URL query: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload as mu-law, and its resampled PCM; also as A-law and as ADPCM blocks, read back."""
    stored = media.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    stored = media.encode_texts(stored, name="alaw", tag=media.ALAW)
    stored = media.encode_texts(stored, name="adpcm", tag=media.IMA_ADPCM).select(
        "doc_id", "media.n_bytes", F.col("media.bytes").alias("media"), F.col("alaw.bytes").alias("alaw"), F.col("adpcm.bytes").alias("adpcm")
    )
    found = media.to_pcm(media.describe_media(stored))
    for name in ("alaw", "adpcm"):
        found = media.describe_media(found, name, f"{name}_audio")
    return found.select(
        "doc_id", "n_bytes", "audio.*", F.length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
        F.col("alaw_audio.payload_sha256").alias("alaw_payload_sha256"), F.col("alaw_audio.feature").alias("alaw_feature"),
        F.col("adpcm_audio.payload_sha256").alias("adpcm_payload_sha256"), F.col("adpcm_audio.feature").alias("adpcm_feature"),
    )


def llm6_media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: sizes and payloads read back from each of the stored forms."""
    return op6_media_columns(spark, sf_dir).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "alaw_payload_sha256", "adpcm_payload_sha256", "media_bytes"
    )


def llm8_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: sizes and targets, and whether each source's draws come near its target."""
    plan = op8_mixing(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    of_source = plan.groupBy("source").agg(F.sum("taken").alias("all_taken"), F.max("size").alias("largest"))
    near = F.abs(F.col("all_taken") - F.col("target")) <= F.col("largest")
    return plan.join(of_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", F.round("target", 3).alias("target"), near.alias("near"), (F.col("taken") <= 2 * F.col("size")).alias("within")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("__lines.kept", 256).alias("kept_sha256")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", secrets.is_base)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.filter("spans", lambda s: secrets.is_base(s) | s["live"])).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        secrets.joined(F.filter("spans", lambda s: s["live"]), "owners", "repositories").alias("live_spans"),
        secrets.joined(F.filter("spans", lambda s: ~s["live"]), "owners", "repositories").alias("copied_spans"),
    )


def llm10_secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that the base patterns fix."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def llm10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of op10 that SQL can find, each with the distinct owners and repositories of its value."""
    found = secrets.explode_spans(secrets.scan_secrets(_table(spark, sf_dir, "documents")))
    return found.where("kind <> 'private'")


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_media_columns": op6_media_columns,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_html_extraction": op9_html_extraction,
    "op10_secret_scan": op10_secret_scan,
    "llm6_media_payload": llm6_media_payload,
    "llm8_mix_targets": llm8_mix_targets,
    "llm10_secret_base": llm10_secret_base,
    "llm10_secret_ownership": llm10_secret_ownership,
}

OP3_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] END AS rest FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT * FROM (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
      ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) t(rule, rh, rp, verdict)),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM h JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
shared AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.i, l.line, s.k IS NOT NULL AND s.last <> l.doc_id AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

LLM6_SQL = r"""
WITH r AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, greatest(64, CAST(ceil(octet_length(raw) / 64.0) AS BIGINT) * 64) AS padded, raw FROM r),
h AS (SELECT doc_id, n, padded, sha256(raw || encode(repeat(chr(0), CAST(padded - n AS BIGINT)))) AS digest FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(padded AS BIGINT) AS payload_bytes, digest AS payload_sha256, digest AS alaw_payload_sha256, digest AS adpcm_payload_sha256,
       CAST(padded + 58 AS BIGINT) AS media_bytes FROM h
"""

LLM8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
-- the share a weight at which the sources reach 150 % of all sizes: one of the steps where a source is full
steps AS (SELECT 2.0 * source_size / w AS step FROM s WHERE source_size > 0),
found AS (
  SELECT step, (SELECT 1.5 * sum(source_size) FROM s) - coalesce((SELECT sum(2.0 * source_size) FROM s WHERE source_size > 0 AND 2.0 * source_size / w < step), 0) AS rest,
         (SELECT sum(w) FROM s WHERE source_size > 0 AND 2.0 * source_size / w >= step) AS free FROM steps),
level AS (SELECT arg_min(rest / free, step) AS share FROM found WHERE rest / free <= step)
SELECT doc_id, size, source_size, round(CASE WHEN source_size = 0 THEN 0.0 ELSE least(2.0 * source_size, w * (SELECT share FROM level)) END, 3) AS target, true AS near, true AS within
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
"""

#: Kind, pattern, group of the value and its least length; the token pattern's runs are judged one by one.
_SECRETS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 12"),
    ("access", "AKIA[A-Z0-9]+", 0, "length(v) >= 18"),
    ("hex", "[0-9a-f]{16,}", 0, "true"),
    ("token", "[A-Za-z0-9+/_=-]{24,}", 0, "regexp_full_match(v, '[A-Za-z0-9+/_-]{24,}={0,2}') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]')"),
)
_SPANS_SQL = (
    "WITH "
    + ", ".join(
        f"""{kind}_m AS (
  SELECT doc_id, source, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS found, regexp_split_to_array(t, '{pattern}') AS gap
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
{kind}_s AS (
  SELECT doc_id, source, '{kind}' AS kind, whole[i] AS w, found[i] AS v,
         list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS place
  FROM (SELECT *, unnest(generate_series(1, len(whole))) AS i FROM {kind}_m))"""
        for kind, pattern, group, _ in _SECRETS
    )
    + ",\ns AS ("
    + " UNION ALL ".join(f"SELECT * FROM {kind}_s WHERE {least}" for kind, _, _, least in _SECRETS)
    + ")"
)
LLM10_SQL = (
    _SPANS_SQL
    + """,
n AS (SELECT v, count(DISTINCT source) + max((source IS NULL)::INT) AS owners, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS repositories FROM s GROUP BY v)
SELECT doc_id, kind, CAST(place AS INT) AS "start", CAST(place + length(w) AS INT) AS "end", owners, repositories, owners <= 2 AND repositories <= 10 AS live FROM s JOIN n ON s.v = n.v"""
)
LLM10_BASE_SQL = (
    _SPANS_SQL
    + """
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || CAST(place AS BIGINT) || ':' || CAST(place + length(w) AS BIGINT), ',' ORDER BY place, list_position(['assign', 'access', 'hex'], kind)), '')) AS base_sha256
FROM documents d LEFT JOIN (SELECT * FROM s WHERE kind <> 'token') b ON d.doc_id = b.doc_id GROUP BY d.doc_id"""
)

ORACLE_SQL: dict[str, str] = {"op3_url_filter": OP3_SQL, "op5_decontamination": OP5_SQL, "op7_line_dedup": OP7_SQL, "llm6_media_payload": LLM6_SQL, "llm8_mix_targets": LLM8_SQL, "llm10_secret_base": LLM10_BASE_SQL, "llm10_secret_ownership": LLM10_SQL}
