import re

import pyarrow as pa
from helpers import prose

from pitchrank.llm import decontam
from pitchrank.llm.decontam import find_items

WORDS = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    return sorted(((d, i, len(parts(t) & parts(x)), len(parts(x))) for d, t in docs for i, x in items
                   if parts(x) and len(parts(t) & parts(x)) >= 0.8 * len(parts(x))), key=str)


def test_equals_brute_force(spark, monkeypatch):
    items = [(i, " ".join(prose(100 + i, 12 + i % 40))) for i in range(60)]
    items += [(90, None), (91, ""), (92, "short one"), (93, "short one"), (94, "ünï cödé Wörter sind gut genug"), (None, "x y")]
    docs = [(k, " ".join(prose(k, 50 * k) + prose(100 + k, 12 + k % 40)[:-(k % 6) or None] + prose(k + 1, 30)))
            for k in range(1, 50)]
    docs += [(200, None), (201, ""), (202, "SHORT, one!"), (203, "x y"), (204, "Ünï"),
             (205, " ".join(prose(5, 20000)) + " " + items[3][1].upper()), (205, items[3][1]),
             (206, "ünï cödé WörteR sind--gut genug")]
    for size in (decontam.ITEM_BYTES, 2000):  # in one block and in several
        monkeypatch.setattr(decontam, "ITEM_BYTES", size)
        got = find_items(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
        assert len(got) == len(docs)
        assert sorted(((r.doc_id, *h) for r in got for h in r.hits), key=str) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "old", 3)], "doc_id long, text string, hits string, item_id int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.item_id, r.hits) for r in find_items(docs, none).collect()] == [(3, [])]
    assert find_items(docs.limit(0), none).count() == 0
    item = spark.createDataFrame([(8, "A, B")], "item_id long, text string")
    assert [tuple(r.hits[0]) for r in find_items(docs, item).collect()] == [(8, 1, 1)]


def test_items_of_few_shingles_are_always_found(spark):
    items = [(n, " ".join(f"item{n}x{k}" for k in range(n))) for n in range(5, 14)]
    docs = [(k, " ".join(prose(k, 60 + k % 70) + [items[k % 9][1]] + prose(k + 1, 40))) for k in range(1, 1801)]
    got = find_items(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all([h.item_id for h in r.hits] == [items[r.doc_id % 9][0]] for r in got)


def test_texts_without_an_items_shingle_get_no_signature(monkeypatch):
    items = pa.table({"id": [1, 2], "text": [" ".join(prose(n, 30)) for n in (1, 2)]})
    texts = [" ".join(prose(n, 200)) for n in range(100, 300)]
    texts[7] += " " + items["text"][1].as_py()
    sorted_texts, distinct = [], decontam._distinct
    monkeypatch.setattr(decontam, "_distinct", lambda h, t: sorted_texts.extend(set(t.tolist())) or distinct(h, t))
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "n_shared", "n_shingles")]))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.nulls(200, kind)], names=["text", "hits"])
    done = pa.Table.from_batches(decontam._search(decontam._signatures(items, 5), 0.8, 5, "text", "hits")([batch]))
    assert [len(h) for h in done["hits"].to_pylist()] == [int(n == 7) for n in range(200)]
    assert sorted_texts == [7]
