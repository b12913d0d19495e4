from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import bag, jaccard, near_classes, prose, variants

from pitchrank.llm import components as module
from pitchrank.llm import minhash
from pitchrank.llm.components import components
from pitchrank.llm.minhash import bag_minhash, near_duplicates

SCHEMA = "doc_id long, text string"


def edited(words, every, tag):
    return [f"{tag}{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


def test_classes_equal_brute_force(spark):
    base, other = prose(1, 300), prose(2, 120)
    rows = [(10, " ".join(base)), (4, " ".join(base)), (30, " ".join(edited(base, 60, "x"))),
            (31, " ".join(edited(base, 75, "y"))), (32, " ".join(edited(base, 12, "z"))),
            (40, " ".join(other)), (41, " ".join(other + other)), (42, " ".join(other[:110])), (50, "a b c"), (51, "a b c"),
            (52, "a b d"), (60, None), (61, None), (62, ""), (63, ""), (64, " "), (None, " ".join(base)), (4, "a b c")]
    rows += [(100 + k, " ".join(edited(base, 20 + k, f"e{k}_"))) for k in range(30)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    rows.remove((4, "a b c"))  # another text under an id: with its own kind, not with that id's
    expected = near_classes(rows)
    assert {(r.doc_id, r.text): r.class_id for r in got if r.text is not None and r.doc_id is not None} == {
        (4, "a b c"): 4, **{(i, t): expected[i] if t != "a b c" else 4 for i, t in rows if i is not None and t is not None}}
    assert all(r.class_id == r.doc_id for r in got if r.text is None or r.doc_id is None)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingle = rng.integers(0, 1 << 47, 400).astype(np.uint64)
    one, two = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    one[:80] = 0
    text = np.repeat([0, 1], 400)
    weight = np.concatenate([one, two])
    some = weight > 0
    slots = bag_minhash(text[some], np.tile(shingle, 2)[some], weight[some], 2, 8192)
    exact = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((slots[0] == slots[1]).mean() - exact) < 0.03


def test_empty_and_clashing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    done = near_duplicates(spark.createDataFrame([(1, "a", "u", 2)], SCHEMA + ", class_id string, band int")).collect()
    assert [(r.class_id, r.band) for r in done] == [(1, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (60, 60), (70, 71), (71, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40, 70: 70, 71: 70}


def test_few_links_take_few_tasks(spark, monkeypatch):
    written, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for key, value in zip(before, ("64", "false"), strict=True):
        spark.conf.set(key, value)
    try:
        links = [(i, i + 1) for i in range(300)]
        got = components(spark.createDataFrame(links, "a long, b long"), len(links)).collect()
        assert sorted((r.node, r.component) for r in got) == [(i, 0) for i in range(301)]
        assert written and max(len(t.inputFiles()) for t in written) <= spark.sparkContext.defaultParallelism
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_different_texts_under_one_id(spark):
    one, two = " ".join(prose(1, 40)), " ".join(prose(2, 40))
    rows = [(1, one), (1, two), (2, one), (3, two + " more"), (1, one)]
    got = {(r.doc_id, r.text): (r.class_id, r.class_key) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[(1, one)] == got[(2, one)] and got[(1, two)] == got[(3, two + " more")] != got[(1, one)]
    assert {v[0] for v in got.values()} == {1}


def test_recall_in_a_large_group_of_near_copies(spark):
    """Copies of one text with up to seven words changed, a third of them too far from all, in which nearly every bucket stays divided."""
    base = prose(5, 150)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 8)), replace=False):
            words[at] = f"v{rng.integers(0, 9)}"
        rows.append((int(i * 7 % 500), " ".join(words)))
    rows += [(1000 + i, " ".join(prose(i, 60))) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    want = near_classes(rows)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 200 and sum(got[i] == want[i] for i in linked) >= 0.95 * len(linked)
    assert all(want[got[i]] == want[i] for i in got)  # no false link
    assert {r.doc_id: r.class_id for r in near_duplicates(df, exact=True).collect()} == want


def test_no_link_is_left_out_of_a_large_bucket(spark):
    rows, want = variants(1500)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(set(want)) == 1159 and got == dict(enumerate(want))


def test_blocks_and_sketches_leave_nothing_out(spark, monkeypatch):
    """Buckets cut into many blocks; long texts whose counts go beyond a byte."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    base = prose(5, 60)
    long = [w for w in base for _ in range(400)]
    rows = [(i, " ".join(w if k % 60 != i else f"x{i}" for k, w in enumerate(base))) for i in range(60)]
    rows += [(100 + i, " ".join(long[:24000 - 1500 * i])) for i in range(6)]
    texts = spark.createDataFrame([(i, i, 7, t) for i, t in rows], "node long, component long, band long, body string")
    members = texts.select("node", "band")
    found = texts.select("node", "component")
    got = {(r.a, r.b) for r in minhash._rest(members, found, texts.select("node", "body"), 0.8, 5).collect()}
    bags = [(i, bag(t)) for i, t in rows]
    alike = {(i, j) for n, (j, c) in enumerate(bags) for i, b in bags[:n] if jaccard(b, c) >= 0.8}
    assert alike <= got and len(alike) > 100 and len(got) < len(bags) * (len(bags) - 1) // 2


def test_very_long_text(spark):
    words = prose(9, 60000)
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3000])), (3, " ".join(prose(10, 60000))), (4, "x" * 100000)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_recall_on_documents(spark):
    """Against all pairs of the shared table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = near_classes([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 50 and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(want[got[i]] == want[i] for i in got)


def test_alike_texts_that_share_no_band(spark, monkeypatch):
    """Pairs with 40 of 50 shingles in common, which one in some tens of thousands has in no band of its signatures."""
    rows = []
    for seed in (21062, 116447, 309348):
        words = prose(seed, 54, 100000)
        rows += [(len(rows), " ".join(words[:49])), (len(rows) + 1, " ".join(words[5:]))]
    df = spark.createDataFrame(rows, SCHEMA)
    signed = df.selectExpr("doc_id AS doc", "'' AS key", "text AS body").mapInArrow(
        minhash._signatures(5, minhash.BANDS, minhash.ROWS), "doc long, key string, bands array<long>")
    bands = {r.doc: set(r.bands) for r in signed.collect()}
    assert not any(bands[i] & bands[i + 1] for i in (0, 2, 4))
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == near_classes(rows) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
    monkeypatch.setattr(minhash, "MARK_BYTES", 0)  # marks that are too many to be broadcast
    assert got == {r.doc_id: r.class_id for r in near_duplicates(df).collect()}


def test_alike_texts_share_a_mark():
    """Whichever shingles are taken to be common, and with repetitions."""
    rng = np.random.default_rng(2)
    for trial in range(300):
        base = rng.integers(1, 60, 40).astype(np.uint64)
        other = base.copy()
        other[rng.choice(40, 4, replace=False)] = rng.integers(100, 200, 4)
        if trial % 2:
            other = other[:int(rng.integers(32, 40))]
        text, shingle, weight = minhash.counted(
            np.repeat([0, 1], [len(base), len(other)]), np.concatenate([base, other]) << np.uint64(16))
        names = np.sort(rng.choice(60, 20, replace=False))
        text, shingle, _ = minhash._marks(text, shingle, weight, 2, 0.8, names.astype(np.uint64), rng.integers(4, 999, 20))
        one, two = (set(shingle[text == n].tolist()) for n in (0, 1))
        bags = [Counter(base.tolist()), Counter(other.tolist())]
        assert jaccard(*bags) < 0.8 or one & two


def test_shared_bands_over_batches():
    bands = [1, 2, 2, 3, 4, 4, 4, 5, 6, 6]
    whole = pa.RecordBatch.from_pydict({"band": bands, "id": list(range(10))})
    for cut in range(1, 5):
        parts = [whole.slice(at, cut) for at in range(0, 10, cut)]
        assert [i for b in minhash._several(parts) for i in b.column("id").to_pylist()] == [1, 2, 4, 5, 6, 8, 9]
