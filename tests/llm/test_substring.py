import pytest
from helpers import prose, without_repeats

from pitchrank.llm.substring import mark_repeats

SCHEMA = "doc_id long, text string"


def rows_of(spark, rows, **kw):
    done = mark_repeats(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted(((r.doc_id, r.text, r.n_words, r.kept) for r in done), key=str)


def shared_passages():
    passage, other = prose(1, 60), prose(2, 13)
    rows = [(7, " ".join(prose(3, 40) + passage + prose(4, 20))), (3, " ".join(passage)),
            (9, "\n".join(passage[5:]) + "\t" + " ".join(prose(5, 30))), (11, " ".join(other + prose(6, 5))),
            (12, " ".join(prose(7, 3) + other)), (13, " ".join(other[:12])), (14, "same " * 200), (15, "same " * 30),
            (16, " ".join(passage + passage)), (20, None), (21, ""), (22, " \n\t "), (23, "é ü " * 20), (24, "é ü " * 20),
            (3, " ".join(passage)), (None, " ".join(passage)), (25, " ".join(prose(8, 5000) + passage))]
    return rows


def test_equals_the_definition(spark):
    rows = shared_passages()
    assert rows_of(spark, rows) == sorted(without_repeats(rows), key=str)


@pytest.mark.parametrize("size", [3, 8])
def test_other_window_sizes(spark, size):
    rows = shared_passages()
    assert rows_of(spark, rows, size=size) == sorted(without_repeats(rows, size), key=str)


def test_layout_is_kept(spark):
    p = prose(1, 20)
    rows = [(1, " ".join(p)), (2, "start\n\n" + " ".join(p) + "\n end  here "), (3, "untouched \n text"), (4, None)]
    done = {r.doc_id: r for r in mark_repeats(spark.createDataFrame(rows, SCHEMA), keep_layout=True).collect()}
    assert done[2].kept == "start\n\nend  here "
    assert done[3].kept == "untouched \n text" and done[3].removed == []
    assert done[4].kept is None
    assert [tuple(r) for r in done[2].removed] == [(1, 20)]


def test_empty_table_and_clashing_columns(spark):
    assert mark_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame([(1, "a b", 5, "x", "y")], SCHEMA + ", n_words int, kept string, bucket string")
    done = mark_repeats(extra).collect()
    assert [(r.n_words, r.kept, r.bucket) for r in done] == [(2, "a b", "y")]
