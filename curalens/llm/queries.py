"""The registered queries of the training-data operators: thin digests of their results, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .collocations import collocations
from .common import remainder, scratch_path, table
from .decontaminate import find_leaks
from .html_text import Weights, extract_main_text, learn
from .lm import lm_scores
from .minhash import near_duplicates
from .packing import pack_documents
from .pivots import near_vectors
from .repacking import repack_documents
from .set_sketch import window_algebra
from .url_filter import judge_urls, path_of
from .warc import URN, assemble, read_warc, write_warc

#: The url rules of the contract.
URL_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, bad) of labelled pages. A page shows the document whose number ends its path; that document's labels are
    the page's outcome, bad if it is of low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    doc = F.try_to_number(F.nullif(F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1), F.lit("")), F.lit("9" * 18))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    seen = pages.where(F.col("url").isNotNull()).select("url", doc.cast("long").alias("doc_id"))
    return seen.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH base AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
named AS (
  SELECT *, regexp_extract(host, '((?:[^.]+\.)?(?:(?:ac|co|com|edu|gov|net|org)\.[^.]{2}|[^.]+))$', 1) AS domain,
    regexp_extract(host, '((?:(?:ac|co|com|edu|gov|net|org)\.[^.]{2}|[^.]+))$', 1) AS suffix
  FROM base),
seen AS (
  SELECT host, domain, suffix, CASE WHEN quality = 0 OR toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bad
  FROM named JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[/.]|$)', 1) AS BIGINT)
  WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad) AS k FROM seen GROUP BY ALL),
d AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
o AS (SELECT coalesce((sum(k) + 1) / (sum(n) + 2), 0.5) AS p FROM h),
moments AS (
  SELECT lv, sum(k) / sum(n) AS m, sum(n) AS t, count(*) AS g, sum(n * (k / n) * (k / n)) AS q
  FROM (SELECT 's' AS lv, n, k FROM s UNION ALL SELECT 'd', n, k FROM d UNION ALL SELECT 'h', n, k FROM h) GROUP BY lv),
strength AS (
  SELECT lv, greatest(1.0, least(1000.0, CASE WHEN q / t - m * m - m * (1 - m) * g / t > 1e-9
    THEN m * (1 - m) / (q / t - m * m - m * (1 - m) * g / t) - 1 ELSE 1000.0 END)) AS w FROM moments),
ps AS (SELECT suffix, (k + w * p) / (n + w) AS p FROM s, o, strength WHERE lv = 's'),
pd AS (SELECT domain, (k + w * ps.p) / (n + w) AS p FROM d JOIN ps USING (suffix), strength WHERE lv = 'd'),
ph AS (SELECT host, (k + w * pd.p) / (n + w) AS mean, n + w AS weight FROM h JOIN pd USING (domain), strength WHERE lv = 'h'),
known AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) AS bound FROM ph),
rules(rule, said) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
fits AS (
  SELECT page_id, host AS h0, path AS p0, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM (SELECT DISTINCT page_id, host, path FROM base) b JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
      AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id, host, path)
SELECT b.page_id, b.host, b.path, f.rule,
  coalesce(f.said, CASE WHEN k.bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM base b LEFT JOIN fits f ON b.page_id = f.page_id AND b.host = h0 AND b.path = p0 LEFT JOIN known k ON b.host = k.host
"""

def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"), modulus=3, held_out=1)
    scored = quality.score_quality(documents, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    found = toxicity.find_passages(documents, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder("doc_id", 7) == 2
    found = lm_scores(table(spark, sf_dir, "documents"), ~held, tokenizer_path())
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, URN + r"(-?[0-9]+):", 1), F.lit("")).cast("long")
    answer = F.col("response")
    return assemble(read_warc(spark, path, with_block=False)).select(
        page(F.col("capture_id")).alias("page_id"), answer["payload_bytes"].alias("payload_bytes"), answer["payload_digest"].alias("payload_digest"),
        answer["type"].alias("record_type"), page(answer["refers_to"]).alias("refers_to"),
    )


OP5_SQL = """
WITH base AS (SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
first AS (SELECT digest, min(page_id) AS original FROM base WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, b.digest AS payload_digest,
  CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM base b LEFT JOIN first f ON b.digest = f.digest AND n >= 100
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("carried")


#: Bounds of the labelled sample for the html weights: pages, and characters of html in each.
HTML_SAMPLE, HTML_SAMPLE_CHARS = 300, 20_000


def html_weights(spark: SparkSession, sf_dir: str) -> Weights:
    """Weights from a bounded sample of labelled pages: those whose document, named by the number that ends the path, is
    at hand, as that document's text is the page's known main text."""
    pages = table(spark, sf_dir, "pages").where(F.length("html") <= HTML_SAMPLE_CHARS)
    doc = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[/.]|$)", 1)
    sample = pages.select("page_id", doc.alias("doc"), "html").where(F.col("doc") != "")
    sample = sample.orderBy(F.xxhash64("page_id"), "page_id").limit(HTML_SAMPLE).collect()
    wanted = sorted({int(r["doc"]) for r in sample})
    if not wanted:
        return Weights()
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isin(wanted) & (F.length("text") <= HTML_SAMPLE_CHARS))
    gold = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    return learn((r["html"], gold[int(r["doc"])]) for r in sample if int(r["doc"]) in gold)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), html_weights(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT row_number() OVER () AS id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
words AS (SELECT id, lang, unnest(w) AS w, unnest(range(len(w))) AS i FROM split),
starts AS (SELECT lang, w AS x, lead(w, 1) OVER v AS y, lead(w, 2) OVER v AS z FROM words WINDOW v AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, x AS phrase, count(*) AS f FROM starts GROUP BY ALL
  UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM starts WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM starts WHERE z IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
phrases AS (SELECT * FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, k, f, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS first, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') AS rest
  FROM phrases, (VALUES (1), (2)) t(j) WHERE j < k),
rated AS (
  SELECT c.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM weakest c WHERE NOT EXISTS (
    SELECT 1 FROM phrases p WHERE p.lang = c.lang AND p.k = 3 AND c.k = 2 AND 100 * p.f >= 50 * c.f
      AND c.phrase IN (array_to_string(string_split(p.phrase, ' ')[1 : 2], ' '), array_to_string(string_split(p.phrase, ' ')[2 : 3], ' ')))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, f AS a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_repacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_algebra(table(spark, sf_dir, "clicks"))


OP13_SQL = """
WITH used AS (
  SELECT DISTINCT client_id, kind, (ts::DATE - DATE '1970-01-01')::BIGINT AS day
  FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
days AS (SELECT DISTINCT day FROM used),
kinds AS (SELECT DISTINCT kind FROM used),
frame AS (SELECT day, a.kind AS kind_a, b.kind AS kind_b FROM days, kinds a, kinds b),
inside AS (SELECT DISTINCT client_id, kind, unnest(range(day, day + 7)) AS day FROM used),
one AS (SELECT day, kind, count(*) AS n FROM inside GROUP BY ALL),
two AS (
  SELECT x.day, x.kind AS kind_a, y.kind AS kind_b, count(*) AS n
  FROM inside x JOIN inside y ON x.client_id = y.client_id AND y.day = x.day - 1 GROUP BY ALL),
hashed AS (
  SELECT kind, day, bits & 511 AS bucket, bits >> 10 AS v, CASE WHEN bits >> 10 = 0 THEN 0 ELSE length(bin(bits >> 10)) END AS len
  FROM (SELECT kind, day, ('0x' || substr(md5(client_id::VARCHAR), 1, 14))::BIGINT AS bits FROM used)),
registers AS (
  SELECT kind, unnest(range(day, day + 7)) AS day, bucket,
    (47 - len) * 1024 + 1023 - ((CASE WHEN len > 11 THEN v >> (len - 11) ELSE v << (11 - len) END) & 1023) AS code
  FROM hashed),
sketches AS (SELECT kind, day, bucket, max(code) AS code FROM registers GROUP BY ALL),
zipped AS (
  SELECT f.day, kind_a, kind_b, coalesce(a.code, 0) AS a, coalesce(b.code, 0) AS b
  FROM frame f, range(512) r(bucket)
  LEFT JOIN sketches a ON a.day = f.day AND a.kind = kind_a AND a.bucket = r.bucket
  LEFT JOIN sketches b ON b.day = f.day - 1 AND b.kind = kind_b AND b.bucket = r.bucket),
placed AS (
  SELECT *, CASE WHEN a = 0 THEN 1.0::DOUBLE ELSE least(1.0, pow(2.0, -(a >> 10)) * (1 + (1023 - (a & 1023) + 0.5) / 1024)) END AS pa,
    CASE WHEN b = 0 THEN 1.0::DOUBLE ELSE least(1.0, pow(2.0, -(b >> 10)) * (1 + (1023 - (b & 1023) + 0.5) / 1024)) END AS pb
  FROM zipped),
sums AS (
  SELECT day, kind_a, kind_b, count(*) FILTER (a > 0 OR b > 0)::DOUBLE AS k, sum(CASE WHEN a >= b THEN pa ELSE pb END) AS s,
    count(*) FILTER (a > 0) / sum(pa) * 511 / 512 AS la, count(*) FILTER (b > 0) / sum(pb) * 511 / 512 AS lb,
    count(*) FILTER (a > 0 AND a = b)::DOUBLE AS agree, count(*) FILTER (a > b)::DOUBLE AS first
  FROM placed GROUP BY ALL),
sized AS (
  SELECT *, k * 511 / s AS n, CASE WHEN la > 0 AND lb > 0 THEN 512 * la * lb / (la + lb) * list_sum(list_transform(range(1, 47),
    lambda i: pow(2.0, -(i + 10)) * (exp(-(la + lb) * pow(2.0, -i)) - exp(-(la + lb) * pow(2.0, 1 - i))))) ELSE 0 END AS chance
  FROM sums),
parts AS (
  SELECT *, CASE WHEN k > 0 THEN least(greatest((agree - chance) / greatest(k - chance, 1), 0), 1) ELSE 0 END AS p, greatest(n, 1e-9) / 512 AS t FROM sized),
rated AS (
  SELECT *, CASE WHEN k > 0 THEN (1 - p) * coalesce(first / nullif(k - agree, 0), 0) ELSE 0 END AS q,
    n * n / 512 * CASE WHEN t < 0.01 THEN 0.5 + t / 12 ELSE 1 / (1 - exp(-t)) - 1 / t END AS spread,
    n * n / greatest(k, 1) * greatest(1 - k / greatest(n, 1), 0.02) AS own, CASE WHEN n > 0 THEN 0.5 ELSE 0 END AS half, 8 * n / sqrt(512) + 3 AS most
  FROM parts)
SELECT r.day, r.kind_a, r.kind_b, coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(t.n, 0) AS n_union, coalesce(t.n, 0) AS n_both,
  coalesce(a.n, 0) - coalesce(t.n, 0) AS n_only_a, round(r.n, 6) AS est_union, round(r.n * p, 6) AS est_both, round(r.n * q, 6) AS est_only_a,
  round(least(3 * sqrt(spread) + half, most), 6) AS err_union, round(least(3 * sqrt(own * p * (1 - p) + p * p * spread) + half, most), 6) AS err_both,
  round(least(3 * sqrt(own * q * (1 - q) + q * q * spread) + half, most), 6) AS err_only_a
FROM rated r LEFT JOIN one a ON a.day = r.day AND a.kind = r.kind_a LEFT JOIN one b ON b.day = r.day - 1 AND b.kind = r.kind_b
  LEFT JOIN two t ON t.day = r.day AND t.kind_a = r.kind_a AND t.kind_b = r.kind_b
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxic_segments": op2_toxic_segments,
    "op3_attention_lm": op3_attention_lm,
    "op4_pivot_index": op4_pivot_index,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_minhash": op8_minhash,
    "op9_html_text": op9_html_text,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_repacking": op12_repacking,
    "op13_set_algebra": op13_set_algebra,
}
ORACLE_SQL: dict[str, str] = {"op5_warc": OP5_SQL, "op10_url_filter": OP10_SQL, "op11_collocations": OP11_SQL, "op13_set_algebra": OP13_SQL}
