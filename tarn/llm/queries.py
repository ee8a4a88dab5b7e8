"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import (
    byte_bpe,
    decontamination,
    exact_dedup,
    html_extraction,
    licenses,
    quality,
    secrets,
    sharding,
    simhash,
    spelling,
    token_counts,
    toxicity,
    vector_codes,
)
from tarn.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.described(table(spark, sf_dir, "documents"))
    return quality.scores(rows, quality.fit(rows)).withColumnRenamed("id", "doc_id")


def op2_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)
    text = F.col("text").cast("string")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, _tokenizer("word_bpe_49k.json"), limit=2048).withColumnRenamed(
        "id", "doc_id"
    )


def op4_block_rule_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s.kind.isin([r.kind for r in secrets.BASE]))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    return found.select(
        F.col("id").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def op6_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
  FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (
  SELECT r, s, starts.n, item_id FROM starts
  JOIN windows ON windows.n = starts.n AND windows.win = list_slice(w, s, s + starts.n - 1)),
hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
  FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def op7_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_polynomial_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
       sha256(body) AS text_sha256
FROM d
"""


def op9_naive_bayes_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).withColumnRenamed("id", "doc_id")


def op10_merge_replay_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = byte_bpe.encode_and_decode(
        table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_orchard_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.codes(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _op11_round(number: int) -> str:
    """The assignment of all parts to the entries of a round; except for the last, the entries after it."""
    near = f"""
near{number} AS (
  SELECT r, part, min({{'d': vv + cc - 2 * list_dot_product(v, c), 'entry': entry}}) AS best
  FROM parts JOIN entries{number} USING (part) GROUP BY r, part)"""
    if number == vector_codes.ROUNDS:
        return near
    return f"""{near},
means{number} AS (
  SELECT part, entry, list(mean ORDER BY place) AS c
  FROM (SELECT part, best.entry AS entry, place, floor(sum(x) / count(*)) AS mean
        FROM (SELECT part, best, unnest(v) AS x, unnest(range(len(v))) AS place FROM parts JOIN near{number} USING (r, part))
        GROUP BY ALL)
  GROUP BY part, entry),
entries{number + 1} AS (
  SELECT part, entry, coalesce(m.c, e.c) AS c, list_dot_product(coalesce(m.c, e.c), coalesce(m.c, e.c)) AS cc
  FROM entries{number} e LEFT JOIN means{number} m USING (part, entry)),"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, part, v, list_dot_product(v, v) AS vv
  FROM (SELECT r, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS v FROM kept, range(4) AS p(part))),
entries0 AS (SELECT part, r - 1 AS entry, v AS c, vv AS cc FROM parts WHERE r <= 256),{"".join(map(_op11_round, range(vector_codes.ROUNDS + 1)))},
coded AS (
  SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{vector_codes.ROUNDS} GROUP BY r),
books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS place FROM entries{vector_codes.ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


def op12_reduced_alphabet_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, x)) AS entry),
runs AS (
  SELECT k, w, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[a-z\x{C0}-\x{FF}]+')) AS w
    FROM documents)
  WHERE length(w) >= 7 GROUP BY ALL),
bytes AS (
  SELECT w, c, flatten(list_transform(string_split(k || ':' || w, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS b
  FROM runs),
hashed AS (
  SELECT w, c, xor(list_reduce(b, lambda a, x: xor(a >> 8, entry[xor(a % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM bytes, crc),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word
    FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON words.word = rest
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON words.word = rest),
best AS (
  SELECT word, count(*) AS n_near, min({'a': -near_n, 'b': near}) AS best FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 10 * n THEN best.b END AS form,
         CASE WHEN -best.a >= 10 * n THEN -best.a END AS form_n
  FROM words LEFT JOIN best USING (word)),
path AS (
  SELECT word, word AS last, 0 AS step FROM words
  UNION ALL SELECT path.word, forms.form, step + 1 FROM path JOIN forms ON forms.word = path.last WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(last, step) AS root FROM path GROUP BY word) USING (word)
"""


def op13_positional_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x.base)

    def listed(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x.label))), ",")

    starts = F.transform(base, lambda x: x.start)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.score)), F.lit(0.0)).alias("score"),
    )


def _op13_templates() -> str:
    """The templates as rows of SQL: label, base, words, first phrase, its place, and the other phrases."""

    def listed(found):
        return "[" + ", ".join(f"'{x}'" for x in found) + "]"

    rows = []
    for t in licenses.TEMPLATES:
        (place, first), *others = t.phrases
        more = ", ".join(f"{{'place': {p}, 'n': {len(w)}, 'text': ' {' '.join(w)} '}}" for p, w in others)
        more = f"[{more}]" if more else "[]::STRUCT(place INTEGER, n INTEGER, text VARCHAR)[]"
        rows.append(f"('{t.label}', {t.base}, {listed(t.words)}, {place}, {listed(first)}, {more})")
    return ",\n  ".join(rows)


OP13_SQL = rf"""
WITH templates(label, base, body, place, first, more) AS (VALUES
  {_op13_templates()}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
joined AS (SELECT r, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
places AS (
  SELECT r, w, label, base, body, more, s - place AS start
  FROM (SELECT *, unnest(range(len(w) - len(first) + 1)) AS s
        FROM joined JOIN templates ON contains(line, ' ' || array_to_string(first, ' ') || ' '))
  WHERE w[s + 1] = first[1] AND list_slice(w, s + 1, s + len(first)) = first),
found AS (
  SELECT r, label, base, start,
         len(list_filter(range(len(body)), lambda k: start + k >= 0 AND w[start + k + 1] = body[k + 1])) / len(body) AS score
  FROM places
  WHERE len(list_filter(more, lambda p: NOT contains(' ' || array_to_string(list_slice(w,
          greatest(0, start + p.place - {licenses.SLACK}) + 1, start + p.place + p.n + {licenses.SLACK}), ' ') || ' ', p.text))) = 0),
by_row AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN by_row USING (r)
"""


def queries() -> dict:
    found = (
        op1_weak_label_quality,
        op2_hypergeometric_sharding,
        op3_transducer_token_counts,
        op4_block_rule_extraction,
        op5_trigram_secret_scan,
        op6_suffix_automaton_decontamination,
        op7_pivot_simhash,
        op8_polynomial_exact_dedup,
        op9_naive_bayes_ngram_toxicity,
        op10_merge_replay_bpe,
        op11_orchard_vector_codes,
        op12_reduced_alphabet_spelling,
        op13_positional_license_scan,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_suffix_automaton_decontamination": OP6_SQL,
        "op8_polynomial_exact_dedup": OP8_SQL,
        "op11_orchard_vector_codes": OP11_SQL,
        "op12_reduced_alphabet_spelling": OP12_SQL,
        "op13_positional_license_scan": OP13_SQL,
    }
