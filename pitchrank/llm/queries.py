"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchrank.llm.decontam import find_items
from pitchrank.llm.minhash import near_duplicates
from pitchrank.llm.notices import find_notices
from pitchrank.llm import langid, negatives, packing, resample, rules, spm, tokencount, toxicity
from pitchrank.llm.sharding import assign_shards
from pitchrank.llm.substring import mark_repeats
from pitchrank.session import scratch_path

TOKENIZERS = "/opt/tokenizers"
TEXT_END = 50256  # end of text of the byte-pair vocabulary, the id behind its last rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def piece_ids(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``docs`` with the piece ids of each text, their number, and whether they decode to the text again."""
    vocabulary = spm.Vocabulary.load(f"{tokenizers}/piece_bpe_32k.model")
    done = spm.decode(spm.encode(docs, vocabulary), vocabulary)
    return done.withColumns({"n_tokens": F.size("ids"), "round_trip": F.col("decoded").eqNullSafe(F.col("text")),
                             "decoded_crc32": F.crc32(F.col("decoded").cast("binary"))}).drop("decoded")


@query
def op1_sentencepiece(spark, sf_dir):
    return piece_ids(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


@query
def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id")


@query
def op3_sharding(spark, sf_dir):
    done = assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def remainder(modulus: int):
    """The fold of a row by its id; -1 without one."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


@query
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(remainder(5) != 0)
    index = toxicity.fit(docs, labels)
    done = toxicity.score(docs, index)
    return done.select("doc_id", (remainder(5) == 0).alias("held_out"), "score",
                       F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


@query
def op6_benchmark_decontamination(spark, sf_dir):
    """Documents that contain benchmark items, one row per document and item."""
    hits = find_items(table(spark, sf_dir, "documents", "doc_id", "text"),
                      table(spark, sf_dir, "benchmark", "item_id", "text"))
    return hits.select("doc_id", F.explode("hits").alias("hit")).select(
        "doc_id", "hit.*", (F.col("hit.n_shared") / F.col("hit.n_shingles")).alias("containment"))


SQL["op6_benchmark_decontamination"] = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
t AS (SELECT kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM w),
s AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS sh
      FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n_shingles FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::BIGINT AS n_shared, any_value(n_shingles)::BIGINT AS n_shingles,
       count(*) / any_value(n_shingles)::DOUBLE AS containment
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.sh = i.sh JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n_shingles)
"""


@query
def op7_substring_dedup(spark, sf_dir):
    done = mark_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0), lambda n, run: n + run["last"] - run["first"] + F.lit(1))
    return done.select("doc_id", "n_words", gone.cast("long").alias("n_removed"),
                       F.sha2("kept", 256).alias("kept_sha256"))


SQL["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM g),
m AS (SELECT win, min(doc_id) AS first_doc FROM k GROUP BY win),
c AS (SELECT DISTINCT k.doc_id, k.i + o.j AS p FROM k JOIN m USING (win), range(0, 13) o(j)
      WHERE m.first_doc < k.doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
s AS (SELECT x.doc_id, count(*) FILTER (WHERE c.p IS NOT NULL) AS n_removed,
             string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL) AS kept
      FROM x LEFT JOIN c USING (doc_id, p) GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(s.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""


@query
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder(4) != 2))
    done = langid.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "spans")


@query
def op9_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    learned = rules.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    done = rules.apply(rules.count_texts(docs), learned)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & (F.col("rule") == 0)).alias("kept"), "rule")


@query
def op5_token_counts(spark, sf_dir):
    """Writes the ids of all documents to flat files and counts the tokens of each there.

    Each document begins with its own id, written as a few token ids that are not counted.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path, end = scratch_path(spark, "tokens"), TEXT_END
    ids = tokencount.byte_pair_ids(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken").select("doc_id", "ids")
    tokencount.write_flat(tokencount.sign(ids), path, end)
    found = tokencount.count_tokens(spark, path, end, head=tokencount.DIGITS)
    return found.select(tokencount.signature(F.col("head")).alias("doc_id"),
                        (F.col("n_tokens") - tokencount.DIGITS).alias("n_tokens"))


@query
def op8_token_packing(spark, sf_dir):
    """All documents as token ids, an end of text after each, in packed rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL")
    ids = tokencount.byte_pair_ids(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken").select("doc_id", "ids")
    return packing.pack(packing.closed(ids, TEXT_END), pad=TEXT_END)


@query
def op13_importance_resampling(spark, sf_dir):
    """A tenth of the documents of 20 words or more, drawn towards the words of the benchmark."""
    done = resample.resample(table(spark, sf_dir, "documents", "doc_id", "text"),
                             table(spark, sf_dir, "benchmark", "text"), percent=10, seed=2024, least_words=20)
    return done.select("doc_id", "n_features", "weight", "score", "rank")


SQL["op13_importance_resampling"] = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i:
           CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
w AS (
  SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
t AS (
  SELECT kind, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM w),
f AS (SELECT kind, doc_id, unnest(w) AS f FROM t),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS (
  SELECT f, xor(4294967295, list_reduce(list_concat([4294967295],
           list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
           lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM x, tab),
n AS (
  SELECT bucket, count(*) FILTER (WHERE kind = 'd') AS s, count(*) FILTER (WHERE kind = 't') AS t
  FROM f JOIN b USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE
                                 / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain
  FROM n),
m AS (
  SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY doc_id),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5)
                                                    / 4294967296)))::BIGINT AS score
  FROM t LEFT JOIN m USING (doc_id) WHERE kind = 'd'),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM r
"""


@query
def op12_hard_negatives(spark, sf_dir):
    """The anchors are all rows whose id is divisible by 50; every seventh label is moved on first."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


SQL["op12_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r a JOIN r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM s JOIN p USING (anchor_id)
WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query
def op11_license_scan(spark, sf_dir):
    """Licence phrases and notices of every document; the score falls with the edits of the best hit."""
    done = find_notices(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("found", lambda e: e["phrase"])
    starts = F.transform(base, lambda e: e["first_word"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda e: e["label"]))), ",")
    sure = F.transform("found", lambda e: 1 - e["edits"] / (e["allowed"] + 1))
    return done.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                       F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
                       labels("found").alias("labels"), F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"), "found")
