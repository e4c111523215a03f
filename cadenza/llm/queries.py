"""The contract queries of the thirteen operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, fingerprints, jaccard_join, lexical_search, packing, pii, quality_pu, rules, sentencepiece, suffix_dedup, url_filter, warc
from .common import LOWER, UPPER, materialise, table

HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 3) = 1"
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), f"NOT ({HELD_OUT})")
    return scores.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.stored(table(spark, sf_dir, "documents"))
    old = rules.apply_policy(led, "v1").withColumnRenamed("kept", "kept_v1").drop("base_failed")
    both = rules.apply_policy(old, "v2")
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits", "kept_v1")


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, and rejects alone, over all documents."""
    return rules.ablation(rules.stored(table(spark, sf_dir, "documents")), "v2")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified_gap")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_groups(table(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=1000)
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).drop("text")


def reported_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of canonical URLs: those of the pages that ``labels`` reports as toxic under the page's number."""
    reports = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    return table(spark, sf_dir, "pages").join(reports, "page_id", "left_semi").select(url_filter.canonical(F.col("url").cast("string")).alias("url"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url").cast("string")
    host, path = url_filter.parse(url)
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), url_filter.canonical(url).alias("key"))
    judged = url_filter.listed(pages, reported_urls(spark, sf_dir), "key").withColumn("r", url_filter.longest_rule(F.col("host"), F.col("path"), URL_RULES))
    verdict = F.coalesce("r.verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "is_listed")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, top=10)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_pu": op1_quality_pu,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
    "op11_lexical_search": op11_lexical_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_fingerprints": op13_fingerprints,
    "rules_ablation": rules_ablation,
}

_WORDS = r"list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SQUEEZED = r"regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]', '', 'g')"
_LINES = r"list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_UPPER_SET = "[A-ZÁÉÍÓÚÑÄÖÜÀÈÇÊ]"

RULES_CTE = f"""
w AS (SELECT doc_id, coalesce(text,'') AS text, {_WORDS} AS w, {_LINES} AS lines FROM documents),
g AS (SELECT doc_id, i, list_extract(w, i) || ' ' || list_extract(w, i+1) || ' ' || list_extract(w, i+2) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-1, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length({_SQUEEZED}) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        length(text) - length(regexp_replace(text, '{_UPPER_SET}', '', 'g')) AS n_upper,
        length(text) - length(replace(text, '!', '')) AS n_exclaim
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 50) OR (100 * n_repeat_words > 50 * n_words) AS base_failed,
        (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100*n_repeat_words > 50*n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10*n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 100*n_dup_lines > 30*n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN n_words > 0 AND (word_chars < 2*n_words OR word_chars > 14*n_words) THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars > 0 AND 100*n_upper > 50*word_chars THEN 32 ELSE 0 END)
        + (CASE WHEN 10*n_exclaim > n_words THEN 64 ELSE 0 END) AS failed_bits FROM m)"""

_HOST = r"coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"

ORACLE = {
    "op3_quality_rules": f"""WITH {RULES_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_bits = 0 AS kept, CAST(failed_bits AS INTEGER) AS failed_bits,
       failed_bits & 15 = 0 AS kept_v1 FROM b""",
    "rules_ablation": f"""WITH {RULES_CTE},
r(rule, bit) AS (VALUES {', '.join(f"('{name}', {1 << k})" for k, name in enumerate(rules.RULES))})
SELECT r.rule, CAST(sum(CASE WHEN b.failed_bits & r.bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejects,
       CAST(sum(CASE WHEN b.failed_bits = r.bit THEN 1 ELSE 0 END) AS BIGINT) AS rejects_alone FROM b, r GROUP BY r.rule""",
    "op6_exact_dedup": f"""WITH d AS (SELECT doc_id, translate(coalesce(text,''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op8_warc": """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html,''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html,'')) AS payload_digest FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM l""",
    "op10_url_filter": rf"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
      regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&+', '') AS query FROM u),
k AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM h),
bad AS (SELECT DISTINCT key FROM k WHERE key IS NOT NULL AND page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r(verdict, rhost, rpath) AS (VALUES ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')),
f AS (SELECT k.page_id, r.rhost || r.rpath AS rule, r.verdict, row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS rn
      FROM k JOIN r ON (k.host = r.rhost OR k.host LIKE '%.' || r.rhost) AND starts_with(k.path, r.rpath))
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, CASE WHEN bad.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, bad.key IS NOT NULL AS is_listed
FROM k LEFT JOIN f ON f.page_id = k.page_id AND f.rn = 1 LEFT JOIN bad ON bad.key = k.key""",
    "op11_lexical_search": rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text,''),'{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text,'{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
u AS (SELECT k, doc_id, len(w) AS n, unnest(w) AS term FROM d),
p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT p.k, p.doc_id, p.term, CAST(floor(1000 * ln((2*c.N+2)::DOUBLE / (2*f.df+1))) AS BIGINT) * ((1000000000*p.tf) // (1000*p.tf + 20*(100-50+((50*p.n*c.N)//c.L)))) AS x FROM p JOIN f USING (term), c),
s AS (SELECT q.item_id, i.k, i.doc_id, CAST(sum(i.x) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op12_source_divergence": rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang,'') AS lang, coalesce(source,'') AS source, coalesce(text,'') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text,'{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS kinds, sum(total) AS size FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n,0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n,0)+2)) // (coalesce(s.size,0) + 2*v.kinds) AS p,
        1 + (1000000000::HUGEINT * (kept.total+2)) // (v.size + 2*v.kinds) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p-b.p)*(a.p-b.p)) // (a.p+b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p-q)*(p-q)) // (p+q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
