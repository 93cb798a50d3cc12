"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import ngram_join

    return ngram_join.join_components(_table(spark, sf_dir, "documents"), percent=80, words=5)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import pii

    return pii.query(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import html_text

    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import decontaminate

    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import sharding

    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import quality

    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import warc
    from sievemark.llm.common import new_path

    root = new_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), root, dedupe_min_bytes=0)
    return warc.read_records(spark, root)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import fingerprint

    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sievemark.llm import bpe

    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sievemark.llm import sstable

    return sstable.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import filter_audit

    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import exact_dedup

    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"), keep="largest")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemark.llm import collocations

    return collocations.mine(_table(spark, sf_dir, "documents"), most=2000)


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_pii, op3_html_text, op4_decontaminate, op5_sharding, op6_quality, op7_warc, op8_fingerprint, op9_bpe, op10_sstable, op11_filter_audit, op12_exact_dedup, op13_collocations)}

_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN coalesce(w.doc_id > first_id, false) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(list_sum(bits[1:step]) AS INTEGER) AS after, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(step)),
y AS (SELECT part, filter_order, step, bit,
  CAST(coalesce(sum(n) FILTER ((mask & after) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER ((mask & before) > 0 AND (mask & bit) > 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(x) FILTER ((mask & before) = 0 AND (mask & bit) > 0), 0) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM y"""

_COLLOCATIONS = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, s AS size, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM o, range(1, 6) r(s) WHERE i + s - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS q FROM f WHERE size > 1),
d AS (SELECT lang, array_to_string(q[1:size - 1], ' ') AS phrase, a FROM c WHERE size > 2 UNION ALL SELECT lang, array_to_string(q[2:], ' '), a FROM c WHERE size > 2),
k AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS m FROM d GROUP BY ALL) x ON c.lang = x.lang AND c.phrase = x.phrase WHERE m IS NULL OR 100 * m < 100 * a),
u AS (SELECT k.lang, k.phrase, a, x.f AS l, y.f AS r, n, cut, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k, range(1, 5) s(cut), f x, f y, t WHERE cut < k.size AND x.lang = k.lang AND y.lang = k.lang AND t.lang = k.lang AND x.phrase = array_to_string(q[1:cut], ' ') AND y.phrase = array_to_string(q[cut + 1:], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b)
SELECT * FROM z WHERE rank <= 2000"""

SQL: dict[str, str] = {
    "op11_filter_audit": _AUDIT,
    "op12_exact_dedup": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op13_collocations": _COLLOCATIONS,
}
