from helpers import near_classes, prose, variants, words

import corpus_pipeline as C

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, root):
    leak = " ".join(prose(900, 30))
    passage = prose(901, 60)
    rows, labels = [], []
    for i in range(200):
        body = prose(i, 120)
        if i % 10 == 0:
            body[20:20] = ["Vile", "grubscum"] * 2
        rows.append([i, " ".join(body)])
        labels.append((i, 0 if i % 3 else 1, int(i % 10 == 0)))
    rows[11][1] = rows[7][1]                                    # a copy
    rows[12][1] = rows[8][1].replace(rows[8][1].split()[60], "changed", 1)  # a near copy
    rows[13][1] += " " + leak + " tail"                         # a leak
    for i in (14, 15):
        rows[i][1] += "\n" + " ".join(passage) + f"\nend{i}"        # a shared passage
    rows += [[300, None], [301, ""], [302, "short"], [17, rows[17][1]]]
    docs = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).coalesce(1).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return {i: t for i, t in rows}


def test_each_stage_does_its_work(spark, tmp_path):
    root = str(tmp_path)
    text = tables(spark, root)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = {}
    for name, stage in C.STAGES:
        done = stage(spark, docs, root)
        if name != C.STAGES[-1][0]:
            assert done.columns == docs.columns
        done.write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(kept[name]) == docs.count() or name == "toxicity"
    toxic = {i for i in range(200) if i % 10 == 0}
    assert set(kept["toxicity"]) == set(text) - toxic
    assert kept["toxicity"][300] is None and kept["toxicity"][301] == ""
    classes = near_classes([(i, t) for i, t in kept["toxicity"].items()])
    assert set(kept["minhash_near_dedup"]) == {i for i in kept["toxicity"] if classes.get(i, i) == i}
    after = kept["substring_dedup"]
    assert after[14] == text[14] and words(after[15]) == words(text[15])[:120] + ["end15"]
    assert all(after[i] == text[i] for i in after if i != 15)
    assert set(kept["benchmark_decontamination"]) == set(after) - {13}
    last = docs.collect()
    assert {r.doc_id for r in last} == set(kept["benchmark_decontamination"])
    assert all(r.round_trip and (r.ids is None) == (r.text is None) for r in last)
    assert sorted(r.doc_id for r in C.run(spark, root).collect()) == sorted(r.doc_id for r in last)


def test_ids_with_several_texts_and_extra_columns(spark, tmp_path):
    """Nothing is lost under a repeated id, and columns of the user's pass through all stages."""
    root = str(tmp_path)
    rows = [(1, "alpha beta gamma"), (1, "other words here now"), (1, "alpha beta gamma"), (2, "other words here now"),
            (3, None), (3, None), (None, "x y"), (None, "x y"), (4, "")]
    docs = spark.createDataFrame([(i, t, "de", "s", 1, "mine", 7) for i, t in rows],
                                 COLUMNS + ", class_id string, score long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    done = C.run(spark, root)
    assert done.columns[:7] == docs.columns
    got = sorted(((r.doc_id, r.text, r.class_id, r.score) for r in done.collect()), key=str)
    assert got == sorted(((i, t, "mine", 7) for i, t in [*rows[:2], *rows[4:]]), key=str)
    names = ("score", "evidence", "class_id", "class_key", "n_words", "kept", "removed", "hits", "ids", "n_tokens", "decoded")
    odd = spark.createDataFrame([(1, "a b c", *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    for name, function in C.STAGES:
        out = function(spark, odd, root).first().asDict()
        added = {"ids", "n_tokens"} if name == "sentencepiece" else set()
        assert {c: out[c] for c in names if c not in added} == {c: c for c in names if c not in added}
        assert all(out[c] != c for c in added)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_without_labels_no_document_is_toxic(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "c")], "doc_id long, text string")
    for name, labels in (("none", []), ("other", [(900, 0, 1)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = C.drop_toxic(spark, docs, f"{tmp_path}/{name}")
        assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_near_dedup_leaves_no_link_out(spark):
    rows, classes = variants(1500)
    kept = C.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").select("doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes))


def test_near_dedup_finds_copies_that_share_no_band(spark):
    words = prose(21062, 54, 100000)
    docs = spark.createDataFrame([(1, " ".join(words[:49])), (2, " ".join(words[5:]))], "doc_id long, text string")
    assert [r.doc_id for r in C.near_dedup(spark, docs, "").collect()] == [1]
