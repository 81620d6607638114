"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewarden.llm import collocations, decontaminate, fingerprint, langid, linededup, mixing, neardup, quality, secrets, sharding, toxicity, urlfilter, variants
from tidewarden.llm.common import fold, table

URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda d: fold(d, 5) != 0)
    return _judged(toxicity.scores(docs, model), 5, 0, 0.5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        F.col("repo").alias("doc_id"), *[secrets.count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.label(base), 256).alias("base_sha256"), secrets.label(F.col("spans")).alias("spans"), "n_live", "n_copied")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predictions(docs, langid.train(docs, lambda d: fold(d, 4) != 2))
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda d: fold(d, 4) != 2)
    return _judged(quality.scores(docs, model), 4, 2, 0.7)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.word_counts(table(spark, sf_dir, "documents")))


def _held_out(folds: int, held: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")


def _judged(scores: DataFrame, folds: int, held: int, limit: float) -> DataFrame:
    return scores.select("doc_id", _held_out(folds, held), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontamination": op2_decontamination,
    "op3_fingerprints": op3_fingerprints,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_sharding": op11_sharding,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"
_RUNS = "list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))"

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM rest
), rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
  SELECT page_id, host, path,
    (SELECT max(struct_pack(n := length(h || p), k := length(h), rule := h || p, v := v)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM parts
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM judged""",
    "op2_decontamination": f"""
WITH i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
ir AS (SELECT item_id, {_RUNS} AS runs FROM i WHERE len(w) >= 5),
dr AS (SELECT doc_id, unnest({_RUNS}) AS run FROM d WHERE len(w) >= 5),
iu AS (SELECT item_id, len(runs) AS n_item, unnest(runs) AS run FROM ir)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM iu JOIN dr USING (run) GROUP BY doc_id, item_id, n_item HAVING count(*) / n_item >= 0.8 - 1e-9""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM split GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM split, (VALUES (1), (2), (3), (4), (5)) t(k) WHERE len(w) >= k
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100
), cuts AS (
  SELECT lang, k, phrase, f, unnest(generate_series(1, k - 1)) AS cut, string_split(phrase, ' ') AS w FROM counted WHERE k > 1
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN total t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_parts AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[i:i + m - 1], ' ') AS phrase, c.f FROM (SELECT DISTINCT lang, k, phrase, f, w FROM cuts) c,
    (VALUES (2), (3), (4)) t(m), (VALUES (1), (2), (3), (4)) u(i) WHERE m < k AND i + m - 1 <= k
), kept AS (
  SELECT * FROM lowest WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = lowest.lang AND p.phrase = lowest.phrase AND 100 * p.f >= 100 * lowest.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op13_spelling_variants": r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
), coded AS (
  -- code points below 256 are one byte, or C3 and one byte
  SELECT run, list_concat(list_transform(range(1, length(id) + 1), lambda i: unicode(id[i])), [58],
    flatten(list_transform(range(1, length(run) + 1), lambda i:
      CASE WHEN unicode(run[i]) < 128 THEN [unicode(run[i])] ELSE [195, unicode(run[i]) - 64] END))) AS bytes
  FROM runs WHERE length(run) >= 6
), hashed AS (
  SELECT run, xor(list_reduce(bytes, lambda crc, byte: list_reduce([1, 2, 3, 4, 5, 6, 7, 8],
    lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(crc, byte::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM coded
), words AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed
), vocab AS (
  SELECT word, count(*) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), cut AS (
  -- place 0 is the whole word; levenshtein() here counts bytes, so it is not used
  SELECT word, n, x.i AS place, x.rest FROM (SELECT word, n, unnest(list_transform(range(0, length(word) + 1), lambda i:
    {'i': i, 'rest': CASE WHEN i = 0 THEN word ELSE word[:i - 1] || word[i + 1:] END})) AS x FROM vocab)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest)
  WHERE a.word <> b.word AND (a.place = b.place OR a.place = 0 OR b.place = 0)
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word
), judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
  FROM vocab LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS root FROM judged WHERE form IS NOT NULL
  UNION ALL
  SELECT chain.word, judged.form FROM chain JOIN judged ON chain.root = judged.word WHERE judged.form IS NOT NULL
), roots AS (SELECT chain.word, chain.root FROM chain JOIN judged ON chain.root = judged.word WHERE judged.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM judged LEFT JOIN roots USING (word)""",
}
