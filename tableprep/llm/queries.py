"""The registered queries of this subpackage, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import (chat, decontam, fingerprints, line_dedup, ngram_join, pieces, pii_crf, sharding, spelling, token_counts, toxicity,
                           url_reputation, whitening)
from tableprep.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


#: Vocabulary file of the SentencePiece operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(strpos(url, '://'), 0) AS spot, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
q AS (SELECT page_id, CASE WHEN spot > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN spot > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
h AS (SELECT *, split_part(regexp_replace(host, ':[0-9]*$', ''), '.', -1) AS suffix,
  array_to_string(list_slice(string_split(regexp_replace(host, ':[0-9]*$', ''), '.'), -2, -1), '.') AS domain FROM q),
o AS (SELECT host, domain, suffix, count(*) AS n, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS s
  FROM h JOIN labels ON doc_id = TRY_CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
a AS (SELECT coalesce(sum(s) / nullif(sum(n), 0), 0.5) AS mu FROM o),
s0 AS (SELECT suffix, sum(n) AS n, sum(s) AS s, any_value(mu) AS mu FROM o, a GROUP BY suffix),
sk AS (SELECT 1 / least(greatest(coalesce(sum((s - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * mu * (1 - mu) * (n - 1)), 0), 0.5), 0.001), 0.5) - 1 AS k FROM s0),
s1 AS (SELECT suffix, (k * mu + s) / (k + n) AS m FROM s0, sk),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s, any_value(m) AS mu FROM o JOIN s1 USING (suffix) GROUP BY domain, suffix),
dk AS (SELECT 1 / least(greatest(coalesce(sum((s - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * mu * (1 - mu) * (n - 1)), 0), 0.5), 0.001), 0.5) - 1 AS k FROM d0),
d1 AS (SELECT domain, (k * mu + s) / (k + n) AS m FROM d0, dk),
h0 AS (SELECT host, o.n, o.s, m AS mu FROM o JOIN d1 USING (domain)),
hk AS (SELECT 1 / least(greatest(coalesce(sum((s - n * mu) ** 2 - n * mu * (1 - mu)) / nullif(sum(n * mu * (1 - mu) * (n - 1)), 0), 0.5), 0.001), 0.5) - 1 AS k FROM h0),
w AS (SELECT page_id, h.host, path, k + coalesce(o.n, 0) AS weight, (k * coalesce(d1.m, s1.m, a.mu) + coalesce(o.s, 0)) / (k + coalesce(o.n, 0)) AS mean
  FROM h LEFT JOIN o ON o.host = h.host LEFT JOIN d1 ON d1.domain = h.domain LEFT JOIN s1 ON s1.suffix = h.suffix, hk, a),
b AS (SELECT *, greatest(mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)), 0.0) AS bound, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM w)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN bound >= 0.75 THEN 'allow' ELSE 'block' END AS verdict, round(bound, 6) AS bound FROM b
"""


@query("op1_url_reputation", OP1_SQL)
def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes come from the labels of the document whose number the page's path carries: good is quality 1, toxic 0."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), "([0-9]+)", 1).try_cast("long")
    outcomes = pages.select(url_reputation.host_of(F.col("url")).alias("host"), number.alias("doc_id")).join(
        read(spark, sf_dir, "labels"), "doc_id")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    judged = url_reputation.judge(pages, outcomes.select("host", good.alias("good")), RULES)
    return judged.withColumn("bound", F.round("bound", 6))


# Rows of one block are numbered by key, checksum and size: below 800,000 rows a shard is one block.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    hex(encode(coalesce(text, ''))) AS h, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS k FROM documents),
j AS (SELECT r, g AS n, 0::BIGINT AS step, -1::BIGINT AS b, 0::BIGINT AS spot, ('0x' || k)::UBIGINT::UHUGEINT AS key FROM d, (VALUES (16), (17)) t(g)
  UNION ALL
  SELECT r, n, step + 1, spot, floor((spot + 1) * (2147483648::DOUBLE / (((nk // 8589934592) + 1)::DOUBLE)))::BIGINT, nk FROM (
    SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS nk FROM j WHERE spot < n)),
s AS (SELECT r, max(b) FILTER (WHERE n = 16)::INT AS shard, max(b) FILTER (WHERE n = 17)::INT AS grown_shard FROM j GROUP BY r),
w AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
e AS (SELECT r, doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
  regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(crcs[(xor(a, b) & 255) + 1], a >> 8))) AS text_crc32 FROM d, w)
SELECT doc_id, size, text_crc32, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard, 'key' AS law FROM e JOIN s USING (r)
"""


@query("op4_jump_shards", OP4_SQL)
def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_table(read(spark, sf_dir, "documents"), "doc_id", "text", 16)
    return placed.withColumn("law", F.lit("key"))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, replace(replace(replace(coalesce(text, ''), '\', '\0'), '<', '\1'), '[', '\2') AS x,
    replace(replace(replace(replace(coalesce(role, ''), '\', '\0'), '<', '\1'), '[', '\2'), chr(10), '\3') AS y FROM c),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS rows, sum(length(x) + length(y) + 9) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = rows THEN upto ELSE 0 END)::BIGINT AS formatted_chars FROM n GROUP BY conv_id
"""


@query("op7_prefix_targets", OP7_SQL)
def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", words), (-7, 1, "assistant", words)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(talks.unionByName(extra)))


@query("op9_ngram_join")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_pii_field")
def op2_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(read(spark, sf_dir, "documents").select("doc_id", "text"))


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    question, answer = decontam.last_sentence(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "benchmark").select("item_id", question.alias("question"), answer.alias("answer"),
                                                  F.lit(True).alias("whole"))


@query("op3_benchmark_passages")
def op3_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(read(spark, sf_dir, "documents").select("doc_id", "text"), benchmark_items(spark, sf_dir))
    return found.withColumn("score", F.round("score", 6))


@query("op5_prefix_fingerprints")
def op5_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_table(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query("op6_fuzzy_lines")
def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs)


@query("op8_suffix_array_pieces")
def op8_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_table(docs, pieces.load(PIECES))


OP11_SQL = r"""
WITH RECURSIVE crcs AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
g AS (SELECT w, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM r WHERE length(w) >= 5 GROUP BY doc_id, w),
e AS (SELECT w, c, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
  regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(crcs[(xor(a, b) & 255) + 1], a >> 8))) AS crc FROM g, crcs),
x AS (SELECT CASE WHEN crc % 97 = 0 THEN substr(w, 1, (crc % length(w))::INT) || substr(w, (crc % length(w))::INT + 2) ELSE w END AS word, c FROM e),
v AS (SELECT word, sum(c)::BIGINT AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
k AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM k a JOIN v ON a.less = v.word
  UNION SELECT v.word, a.word, a.n FROM k a JOIN v ON a.less = v.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, b.m, min(p.other) AS form FROM v JOIN b ON b.word = v.word AND b.m >= 2 * v.n JOIN p ON p.word = v.word AND p.m = b.m GROUP BY ALL),
w AS (SELECT word, form AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root),
z AS (SELECT word, root FROM w WHERE root NOT IN (SELECT word FROM f))
SELECT v.word, f.form, coalesce(z.root, v.word) AS root, v.n, coalesce(b.n_near, 0) AS n_near, f.m AS form_n
FROM v LEFT JOIN f ON f.word = v.word LEFT JOIN b ON b.word = v.word LEFT JOIN z ON z.word = v.word
"""


@query("op11_permuterm_variants", OP11_SQL)
def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_table(read(spark, sf_dir, "documents"))


@query("op12_polar_whitening")
def op12_polar_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_table(read(spark, sf_dir, "embeddings"))


@query("op13_rank_merged_tokens")
def op13_rank_merged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_table(read(spark, sf_dir, "documents"), token_counts.load(PIECES))
