import itertools

import numpy as np
from pyspark.sql import functions as F

from pitchrank.llm import langid as L

WORDS = {"en": "the quick brown fox jumps over this lazy dog while they were thinking".split(),
         "de": "der schnelle braune Fuchs springt über den faulen Hund während sie schliefen".split(),
         "ru": "быстрая коричневая лиса прыгает через ленивую собаку пока они спали".split()}


def text(lang, seed, n=40):
    return " ".join(WORDS[lang][(seed * 7 + k * k) % len(WORDS[lang])] for k in range(n))


def test_languages_spans_and_nulls(spark):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(list(WORDS) * 30)]
    odd = [(500, None, "en"), (501, "", "de"), (502, "12 34 !!", "en"), (503, text("en", 1), None), (None, text("de", 2), "de")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = L.fit(docs)
    mixed = text("en", 3, 30) + " 7 " + text("de", 4, 30) + "\n" + text("ru", 5, 10)
    asked = spark.createDataFrame([*rows, *odd, (600, mixed, "x"), (601, text("ru", 9, 30000), "x")],
                                  "doc_id long, text string, score string").withColumn("word", F.lit(1))
    done = {r.doc_id: r for r in L.identify(asked, model).collect()}
    assert all(done[i].lang_pred == lang and done[i].score > 0.9 for i, _, lang in rows)
    assert all((done[i].lang_pred, done[i].score, done[i].spans) == ("und", 0.0, []) for i in (500, 501, 502))
    assert [tuple(s) for s in done[600].spans] == [("en", 0, 29), ("de", 30, 59), ("ru", 60, 69)]
    assert done[601].lang_pred == "ru" and done[503].word == 1
    assert L.identify(asked.limit(0), model).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(docs, L.fit(docs)).collect()] == [("und", 0.0)]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    lengths = [0, 1, 5, 3, 6, 0, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(first[-1], 3)) * 3
    path = L.viterbi(scores, first, 2.0)
    for a, b in zip(first, first[1:]):
        value = lambda p: sum(scores[a + k, s] for k, s in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        if b > a:
            best = max(itertools.product(range(3), repeat=b - a), key=value)
            assert abs(value(best) - value(path[a:b])) < 1e-9


def test_every_letter_counts(spark):
    hans, kana = "我们今天在学校里学习新的知识和语言", "わたしはきょうがっこうでべんきょうします"
    rows = [(i, t[i % 7:] + t, lang) for i, (lang, t) in enumerate([("zh", hans), ("ja", kana), ("en", text("en", 1))] * 20)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, hans * 2 + "。" + kana * 9), (2, (hans * 4)[:60]), (3, "\u00a0".join(text("en", 1).split()[:30])),
             (4, hans + "\u3000" + hans), (5, "。、\u3000")]
    done = {r.doc_id: r for r in L.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert done[1].lang_pred == "ja" and [s.lang for s in done[1].spans] == ["zh", "ja"]
    share = len(kana) * 9 / (len(kana) * 9 + len(hans) * 2)
    assert abs(done[1].score - share) < 1e-9
    assert [tuple(s) for s in done[2].spans] == [("zh", 0, 2)]  # 24, 24 and 12 letters
    assert [tuple(s) for s in done[3].spans] == [("en", 0, 29)]
    assert [tuple(s) for s in done[4].spans] == [("zh", 0, 1)]
    assert (done[5].lang_pred, done[5].spans) == ("und", [])
