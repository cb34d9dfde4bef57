"""The registered queries of the training-data operators.

Each ``opN_<name>`` applies its operator with production parameters to the
whole table and derives the columns that its contract names.  ``ORACLES``
holds DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm import alignment, bytepairs, decontaminate, html, licences, lm, minhash, mixing, quality, repair, sharding, suffixes, toxicity
from vulnlake.llm.common import tokenizer_file, word_pattern
from vulnlake.sources.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn
        return fn
    return deco


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@oracle("op3_mix_sources")
def _op3_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('3:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS cap,
             CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER lower, 0)) / sum(weight) OVER upper AS level
      FROM w WINDOW lower AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    upper AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT min_by(level, cap / weight) AS level FROM f WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(weight * l.level, cap) AS target FROM w, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.whole,
             CAST(floor(e.target + 0.5) AS BIGINT) - e.whole * e.source_size
             - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(whole * size + greatest(0, least(size, room)) AS BIGINT) AS taken, source FROM c"""


@query
def op8_shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.document_shards(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@oracle("op9_host_quality")
def _op9_sql() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT uid, i, words[i:i+7] AS gram FROM (SELECT uid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, gram) AS n FROM g) WHERE n >= 2),
c AS (SELECT uid, sum(least(8, coalesce(nxt - i, 8))) AS covered
      FROM (SELECT uid, i, lead(i) OVER (PARTITION BY uid ORDER BY i) AS nxt FROM r) GROUP BY uid),
s AS (SELECT w.doc_id, w.source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (uid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines AS other_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR other_failed) AS bad FROM f GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS mean, sum(n) AS total, count(*) AS hosts FROM h),
v AS (SELECT any_value(mean) AS mean, any_value(mean * (1 - mean)) AS chance,
             (sum(n * pow(bad / n - mean, 2)) - any_value(hosts * mean * (1 - mean))) / any_value(total) AS between_hosts FROM h, m),
p AS (SELECT mean, CASE WHEN between_hosts <= 0 THEN 1e6 ELSE least(greatest(chance / between_hosts - 1, 1), 1e6) END AS strength FROM v),
k AS (SELECT source, (bad + mean * strength) / (n + strength) <= 0.5 AS host_ok FROM h, p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM f JOIN k ON f.source IS NOT DISTINCT FROM k.source"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model).select("doc_id", "held_out", "score", "predicted", "n_hits")


@query
def op1_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), width=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@oracle("op1_minmax_dedup")
def _op1_sql() -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i:i+1])
                                          WHEN len(w) = 1 THEN [w] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query
def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_tokens", "n_covered", "n_windows", "coverage")


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark, table(spark, sf_dir, "pages"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"))


@query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "paragraph", "family", "probability", "guess", "template", "contained", "confirmed")


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytepairs.encode_documents(spark, table(spark, sf_dir, "documents"),
                                     tokenizer_file("byte_bpe_multi_50k.tiktoken"), word_pattern())
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair(spark, repair.damage(conversations), conversations)


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align_documents(spark, table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
