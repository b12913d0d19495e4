import re
from collections import Counter

import numpy as np
from helpers import prose, words

from pitchrank.llm import rules as R

DOCS = "doc_id long, text string"


def brute(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    three = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))


def test_counts(spark):
    texts = [None, "", " \n ", "a", "a\na\na", "x y z x y z x", "é ü\n\né ü\n é ü\n", "## $%&|<> **", "same line\nother\nsame line",
             "ends with line\n", "\nstarts", "same line", "日本 語 日本 語 日本 語", " ".join(prose(3, 20000)), "w " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(4, "a\na\na")], DOCS).selectExpr("*", "'k' AS n_words")
    done = R.count_texts(docs).collect()
    assert len(done) == len(texts) + 1
    for r in done:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id
    assert R.count_texts(docs.limit(0)).count() == 0


def test_list_is_learned_and_applied(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        body = prose(i, 80)
        text = " ".join(w + "###" for w in body) if bad and i % 8 else "again " * 80 if bad else " ".join(body)
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([*labels, (None, 0), (9999, 0), (1, None)], "doc_id long, quality int")
    learned = R.learn(docs, known)
    assert 1 <= len(learned) <= 3 and all(r.describe() for r in learned)
    got = {r.doc_id: r.rule for r in R.apply(R.count_texts(docs), learned).collect()}
    assert all((got[i] > 0) == (q == 0) for i, q in labels)
    # the first rule that holds decides
    for r in R.apply(R.count_texts(docs), learned[:1]).collect():
        assert r.rule == (1 if got[r.doc_id] == 1 else 0)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    assert R.learn(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert [r.rule for r in R.apply(R.count_texts(docs), []).collect()] == [0]
    assert R.cover(np.zeros((50, 2)), np.arange(50) % 2 == 0, ["a", "b"]) == []  # ties everywhere
