"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm import (
    alignment, chat, collocations, exact_dedup, mixing, near_dups, packing, quality, quality_network, sentence_pieces, token_counts,
    toxicity, warc,
)
from cardlake.llm.common import stored, table
from cardlake.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


@register("op1_minhash_near_dedup", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
x AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
          ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n, g, md5(array_to_string(list_sort(g), ' | ')) AS m FROM x),
h AS (SELECT m, min(doc_id) AS head, any_value(n) AS n, any_value(g) AS g FROM n WHERE n > 0 GROUP BY m),
s AS (SELECT head, n, unnest(g) AS g FROM h),
p AS (SELECT a.head AS a, b.head AS b FROM s a JOIN s b ON a.g = b.g AND a.head < b.head AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, root) AS (SELECT head, head FROM h UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.root, n.doc_id) AS component_id, n.doc_id = coalesce(c.root, n.doc_id) AS kept
FROM n LEFT JOIN h ON n.m = h.m AND n.n > 0 LEFT JOIN c ON c.node = h.head""")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles are 85 % alike."""
    return near_dups.grouped(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_key")


@register("op2_chat_formatting")
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, written and read back."""
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.formatted_and_read(rows)


@register("op3_quality_rules", r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
      FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
p AS (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
n AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM p GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS caps,
        length(t) - length(replace(t, '!', '')) AS excl
      FROM w LEFT JOIN n USING (r)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
       OR 100 * caps > 30 * n_words OR 100 * excl > 30 * n_words) AS kept
FROM v""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current policy over the stored ledger of all documents."""
    rows = quality.verdicts(stored(quality.ledger(table(spark, sf_dir, "documents")), "ledger"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@register("op4_mixing", r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
p AS (SELECT *, tokens / (sum(tokens) OVER ())::DOUBLE AS share, (sum(tokens) OVER ())::BIGINT AS total FROM s WHERE tokens > 0),
l AS (SELECT list(share) AS shares FROM p),
-- The smallest multiple of 2^-20 under which no source is read more than twice.
b(low, high) AS (
  SELECT 0, 1048576
  UNION ALL
  SELECT CASE WHEN ok THEN low ELSE (low + high) // 2 END, CASE WHEN ok THEN (low + high) // 2 ELSE high END
  FROM (SELECT low, high, pow(list_min(shares), ((low + high) // 2) / 1048576.0::DOUBLE - 1)
          / list_sum(list_transform(shares, lambda x: pow(x, ((low + high) // 2) / 1048576.0::DOUBLE))) <= 2 AS ok
        FROM b, l WHERE high - low > 1)),
e AS (SELECT CASE WHEN 1.0 / (list_min(shares) * len(shares)) <= 2 THEN 0 ELSE (SELECT min(high) FROM b) / 1048576.0::DOUBLE END AS a FROM l),
w AS (SELECT p.*, pow(share, a) / (sum(pow(share, a)) OVER ()) AS weight, ceil(docs / 1000.0)::BIGINT AS blocks FROM p, e),
q AS (SELECT source, tokens, blocks, floor(weight * total)::BIGINT AS quota FROM w),
r AS (SELECT *, quota // tokens AS passes, quota % tokens AS rest FROM q
      UNION ALL SELECT source, tokens, ceil(docs / 1000.0)::BIGINT, 0, 1, 0 FROM s WHERE tokens = 0),
k AS (SELECT d.*, tokens, quota, passes, rest,
        ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || n_tokens), 1, 8))::BIGINT % blocks AS block
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
g AS (SELECT k.*, unnest(generate_series(0, passes - CASE WHEN rest > 0 THEN 0 ELSE 1 END)) AS pass FROM k),
o AS (SELECT *, md5('mix|' || pass || '|' || coalesce(source, '') || '|' || block) AS bo, md5('mix|' || pass || '|' || coalesce(doc_id::VARCHAR, '')) AS dd
      FROM g WHERE pass < passes OR n_tokens <= rest),
t AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY bo, block, dd, doc_id, n_tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_token FROM o)
SELECT doc_id, source, pass, block, n_tokens, start_token, (pass * tokens + start_token) / greatest(quota, 1)::DOUBLE AS place
FROM t WHERE pass < passes OR start_token + n_tokens <= rest""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all sources for a budget of all tokens, in which no source is read more than twice."""
    return mixing.schedule(table(spark, sf_dir, "documents"), ratio=1.0, repetitions=2.0)


@register("op5_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


@register("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests."""
    coded = sentence_pieces.decode(sentence_pieces.encode(table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows without an id are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select(
        "doc_id", F.coalesce(toxicity.bucket() == 2, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, from the counts of all prefixes."""
    counts = token_counts.truncated(token_counts.prefix_counts(table(spark, sf_dir, "documents")), 512)
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_in_limit")


@register("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of ids, written and read back."""
    path = scratch_dir(spark, "matrices")
    packing.write_matrices(packing.packed(table(spark, sf_dir, "documents")), path)
    return packing.read_matrices(spark, path)


@register("op10_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT *, octet_length(encode(t)) AS n,
        CASE WHEN octet_length(encode(t)) >= 100 THEN min(page_id) OVER (PARTITION BY t) ELSE page_id END AS first FROM (
          SELECT page_id, t FROM p))
SELECT page_id, n::BIGINT AS payload_bytes, sha256(t) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    return warc.with_full_payload(warc.archive(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@register("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all documents to be good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_network.scored(docs, quality_network.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select(
        "doc_id", F.coalesce(toxicity.bucket() == 2, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= quality_network.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


@register("op12_collocations", r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS k FROM w),
o AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM g WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM o GROUP BY lang, k, phrase),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 30),
x AS (SELECT lang, phrase, k, a, ws, unnest(generate_series(1, k - 1)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.a, cut, l.n AS l, r.n AS r, (2000000::HUGEINT * x.a) // (l.n + r.n) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:cut], ' ')
             JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:x.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
u AS (SELECT lang, a, ws, k, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2),
v AS (SELECT lang, a, unnest(list_transform(generate_series(1, k - m + 1), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM u),
y AS (SELECT lang, phrase, max(a) AS around FROM v GROUP BY lang, phrase),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN y ON b.lang = y.lang AND b.phrase = y.phrase WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a)
SELECT z.lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score FROM z JOIN t ON z.lang = t.lang WHERE rank <= 2000""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over all documents."""
    return alignment.aligned(table(spark, sf_dir, "documents"))
