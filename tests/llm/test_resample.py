import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import prose
from pyspark.sql import functions as F

from pitchrank.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest=1):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, seed, least, longest=1, buckets=R.BUCKETS):
    """(id, n_features, weight, score, rank) by the definition, one text at a time."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in runs(t, longest))
    t = Counter(bucket(f) for x in target for f in runs(x, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in docs:
        own = [gain(bucket(f)) for f in runs(text, longest)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = [r for r, (_, text) in zip(out, docs, strict=True) if len(runs(text)) >= least]
    fit.sort(key=lambda r: (-r[3], R.LAST_ID if r[0] is None else r[0], r[1]))
    for place, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=str)


DOCS = [(k, " ".join(prose(k, 5 + k * 7 % 60, 300))) for k in range(1, 400)] + [
    (900, None), (901, ""), (902, "!? --"), (903, "ÄRGER Ärger " * 20), (904, "x" * 5000 + " " + "é" * 90),
    (905, " ".join(prose(5, 30000, 300))), (906, " ".join(prose(6, 30, 300))), (906, " ".join(prose(6, 30, 300))),
    (906, " ".join(prose(7, 40, 300))), (None, " ".join(prose(8, 40, 300))), (None, None)]
TARGET = [" ".join(prose(k, 40, 90)) for k in range(30)] + [None, ""]


def frames(spark, docs=DOCS, target=TARGET):
    return (spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
            spark.createDataFrame([(t,) for t in target], "text string"))


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    docs, target = frames(spark)
    assert rows(R.resample(docs, target, 30, 2024, 20)) == brute(DOCS, TARGET, 30, 2024, 20)
    assert rows(R.resample(docs, target, 100, 7, 1, longest=3, buckets=97)) == brute(DOCS, TARGET, 100, 7, 1, 3, 97)
    assert rows(R.resample(docs, target, 0, 7, 1))[0][4] is None


def test_ranks_over_many_segments_and_equal_scores(spark):
    table = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 11)
                                     .alias("score"), F.lit("x").alias("rank"), F.lit(1).alias("n"))
    done = R.draw(table.repartition(9), 50, F.when(F.col("doc_id") != 7, True), segments=16).collect()
    want = sorted((r for r in done if r.doc_id != 7), key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in want] == [*range(1, 2500), *[None] * 2500] and len(done) == 5000
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("score"))
    got = [r["rank"] for r in R.draw(same, 40, segments=8).collect()]
    assert sorted(x for x in got if x) == list(range(1, 1201)) and got.count(None) == 1800


def test_exchanged_segments_are_even(spark):
    """No segment holds a third of the rows, though a third of them have one score and no id."""
    hot = [(0, R.LAST_ID)] * 3000 + [(-k, k) for k in range(6000)]
    table = spark.createDataFrame([(*h, n) for n, h in enumerate(hot)], "_k0 long, _k1 long, _k2 long")
    cuts = R._splitters(table.repartition(8).sortWithinPartitions("_k0", "_k1", "_k2"), 9000, 16)
    sizes = np.diff([0, *np.searchsorted(np.arange(9000), [sorted((*h, n) for n, h in enumerate(hot)).index(c) for c in cuts]), 9000])
    assert len(sizes) == 16 and max(sizes) < 2 * 9000 / 16


def test_empty_tables_and_clashing_columns(spark):
    docs, target = frames(spark)
    assert R.resample(docs.limit(0), target, 10, 1, 20).count() == 0
    assert rows(R.resample(docs, target.limit(0), 10, 1, 20)) == brute(DOCS, [], 10, 1, 20)
    odd = docs.select("*", *(F.lit("old").alias(c) for c in ("n_words", "n_features", "weight", "score", "rank", "lang")))
    done = R.resample(odd, target, 10, 1, 20)
    assert done.columns == ["doc_id", "score", "lang", "n_words", "n_features", "weight", "rank"]
    assert rows(done) == brute(DOCS, TARGET, 10, 1, 20)
