import numpy as np
import pytest
from helpers import prose

from pitchrank.llm import toxicity as X

DOCS = "doc_id long, text string"


def corpus():
    rows, labels = [], []
    for i in range(300):
        words = prose(i, 60)
        if i % 6 == 0:
            words[10:10] = ["Nasty", "brute!!"] + ["brutevile"] * (i % 3)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return rows, labels


def test_scores_and_nulls(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "NASTY brute " * 5000), (None, "nasty"), (1, rows[1][1])], DOCS)
    known = spark.createDataFrame([*[x for x in labels if x[0] % 5], (None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    index = X.fit(docs, known)
    done = X.score(docs.selectExpr("*", "'x' AS score", "1 AS terms"), index).collect()
    assert len(done) == docs.count() and all(r.terms == 1 for r in done)
    by = {r.doc_id: r.score for r in done}
    assert all((by[i] >= 0.5) == bool(t) for i, t in labels)
    assert by[900] == by[901] == index.plain < 0.1 and by[902] > 0.5
    assert all(0 <= r.score <= 1 for r in done)


def test_nearest_equals_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    index = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    n = len(index.toxic)
    dense = np.zeros((n, len(index.terms)))
    for t in range(len(index.terms)):
        a, b = index.first[t], index.first[t + 1]
        dense[index.example[a:b], t] = index.weight[a:b]
    rng = np.random.default_rng(0)
    for _ in range(30):
        terms = np.sort(rng.choice(len(index.terms), min(4, len(index.terms)), replace=False))
        counts = rng.integers(1, 5, len(terms))
        weight = (1 + np.log(counts)) * index.idf[terms]
        cosine = dense[:, terms] @ (weight / np.sqrt((weight ** 2).sum()))
        order = [i for i in np.lexsort((np.arange(n), -cosine.round(9))) if cosine[i] > 1e-12][:5]
        found, similar = X.nearest(index, terms, counts, 5)
        np.testing.assert_allclose(similar, cosine[order], atol=1e-9)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    index = X.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in X.score(docs, index).collect()] == [0.5]
    assert X.score(docs.limit(0), index).count() == 0


@pytest.mark.parametrize("tenths", [4, 6, 8])
def test_any_class_balance(spark, tenths):
    toxic = {i: int(i % 10 < tenths) for i in range(400)}
    rows = [(i, " ".join(prose(i, 40) + ["nasty", "brute"] * t)) for i, t in toxic.items()]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([x for x in toxic.items() if x[0] % 7], "doc_id long, toxic int")
    index = X.fit(docs, labels)
    assert "nasty" in index.terms and index.plain < 0.5
    assert {r.doc_id: int(r.score >= 0.5) for r in X.score(docs, index).collect()} == toxic
