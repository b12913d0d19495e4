import zlib
from collections import Counter, defaultdict

import pytest

from pitchrank.llm import sharding
from pitchrank.llm.sharding import assign_shards

DOCS = "doc_id long, text string"


def check(rows, done, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in done) == sorted((i is None, i or 0) for i, _ in rows)
    n = Counter(r.shard for r in done)
    assert max(n[s] for s in range(shards)) - min(n[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in done if r.shard == s) == list(range(n[s]))


def cut(rows, done):
    text, where = dict(rows), defaultdict(set)
    for r in done:
        if text[r.doc_id] is not None:
            where[text[r.doc_id]].add(r.shard)
    return sum(len(v) - 1 for v in where.values())


@pytest.mark.parametrize("bucket", [20_000, 7])
def test_law_slots_and_cuts(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET", bucket)
    rows = [(i, "hot" if i % 3 == 0 else f"pair{i // 4}" if i % 3 == 1 else f"t{i}") for i in range(601)]
    rows += [(700, None), (701, None), (702, ""), (703, "")]
    docs = spark.createDataFrame(rows, DOCS)
    done = assign_shards(docs).collect()
    check(rows, done, 8)
    # the hot text fills two shards and part of a third; hardly anything else is cut
    assert cut(rows, done) <= 4
    for r in done:
        body = (dict(rows)[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))


def test_odd_tables(spark):
    assert assign_shards(spark.createDataFrame([], DOCS)).count() == 0
    same = [(1, "x")] * 5 + [(None, "x"), (None, None)]
    done = assign_shards(spark.createDataFrame(same, DOCS).selectExpr("*", "'a' AS shard", "2 AS target"), 3).collect()
    check(same, done, 3)
    assert all(r.target == 2 for r in done)
    lone = [(i, f"t{i}" * 1000) for i in range(5)]
    check(lone, assign_shards(spark.createDataFrame(lone, DOCS)).collect(), 8)


def test_no_python(spark):
    plan = assign_shards(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], DOCS))
    assert not any(x in plan._jdf.queryExecution().toString() for x in ("Python", "Pandas", "InArrow"))
