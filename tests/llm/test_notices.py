import functools
import re

from helpers import prose

from pitchrank.llm import notices as N
from pitchrank.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def phrase_places(text):
    """(label, first, last) of every place of a phrase, word by word."""
    w = words(text)
    return sorted((p.label, i, i + len(p.text.split()) - 1) for p in N.PHRASES for i in range(len(w))
                  if w[i:i + len(p.text.split())] == p.text.split())


@functools.cache
def notice_places(text):
    """(label, text, edits) of every notice, matching the whole text without looking up pieces."""
    whole = "".join(f" {w}" for w in words(text)) + " "
    return sorted((n.label, m.group().strip(), sum(m.fuzzy_counts)) for n in N.NOTICES for m in n.pattern().finditer(whole))


def edits(a, b):
    """Edit distance by the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def spoil(text, seed, n):
    """``text`` with n characters replaced, left out or put in."""
    out = list(text)
    for k in range(n):
        at = (seed * 7919 + k * 104729) % len(out)
        kind = (seed + k) % 3
        out[at:at + (kind < 2)] = ["ß"] if kind == 0 else [] if kind == 1 else ["q"]
    return "".join(out)


TEXTS = [" ".join(prose(k, k % 9)) + " " + spoil(n.text.title() + n.tail, k, k % (n.edits + 3)) + ". " + " ".join(prose(k + 1, 4))
         for k, n in enumerate(N.NOTICES)] + [
    None, "", "...", "Released under the MIT License.", "UNDER THE MIT-license, under the mit license; under the mitt license",
    "cc by nc cc by nc CC-BY-NC 4.0", "apache license version 20", "Apache License, Version 2.0", "the mit license",
    "Licensed under the Apache License, Version 1.1", "licenced under the apache licence, version 2.0!",
    "permission is hereby granted", "under the terms of the GNU Lesser General Public License",
    "ünder thé mit license", "Licensed under the GNU\n\n  General Public\tLicense " * 40,
    " ".join(prose(3, 20)) + " released under the  MIT\nlicence " + " ".join(prose(4, 20)), "licensed" * 9,
    "under the mit license"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_equals_brute_force(spark):
    got = {r.doc_id: r for r in N.find_notices(docs(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        w = words(text)
        assert got[i].n_words == len(w) and got[i].text == text
        assert sorted((e.label, e.first_word, e.last_word) for e in got[i].found if e.phrase) == phrase_places(text)
        rest = [e for e in got[i].found if not e.phrase]
        assert sorted((e.label, e.edits) for e in rest) == sorted((a, c) for a, _, c in notice_places(text)), text
        for e in rest:
            span = " ".join(w[e.first_word:e.last_word + 1])
            assert 0 <= e.edits <= e.allowed and 0 <= e.first_word <= e.last_word < len(w)
            assert any(found in span for _, found, _ in notice_places(text))


def test_every_notice_within_its_bound_is_found(spark):
    """Spoiled notices are found exactly if their edit distance is within the bound, wherever the edits fall."""
    cases = [(n, spoil(n.text, seed, seed % (n.edits + 1)) + n.tail) for n in N.NOTICES for seed in range(24)]
    got = {r.doc_id: r for r in N.find_notices(docs(spark, [f"w1 {t} w2" for _, t in cases])).collect()}
    for i, (n, text) in enumerate(cases):
        assert edits(n.text + n.tail, text) <= n.edits
        assert n.label in {e.label for e in got[i].found}, text
    far = [spoil(" ".join(reversed(n.text.split())), 5, n.edits * 2) for n in N.NOTICES]
    assert all(not r.found for r in N.find_notices(docs(spark, far)).collect())


def test_very_long_texts(spark):
    """Whole texts are searched, at a cost that follows their length."""
    text = " ".join(prose(3, 50000)) + " released under the  MIT\nlicence " + " ".join(prose(4, 100000)) + " cc-by-nc"
    got = N.find_notices(docs(spark, [text, "licensed" * 90000, "licensed under the mut licence. " * 3000])).orderBy("doc_id").collect()
    assert [(e.label, e.first_word, e.last_word, e.edits) for e in got[0].found] == [
        ("mit", 50000, 50004, 1), ("cc-by-nc", 150005, 150007, 0)]
    assert got[1].found == [] and [e.first_word for e in got[2].found] == list(range(0, 15000, 5))


def test_query_columns(spark, tmp_path):
    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    done = queries.op11_license_scan(spark, str(tmp_path))
    assert done.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    for r in done.collect():
        places, text = phrase_places(TEXTS[r.doc_id]), TEXTS[r.doc_id]
        assert (r.n_words, r.n_base) == (len(words(text)), len(places))
        assert (r.first_word, r.last_word) == ((min(p[1] for p in places), max(p[1] for p in places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[0] for p in places}))
        assert r.labels == ",".join(sorted({p[0] for p in places} | {n[0] for n in notice_places(text)}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and (not places or r.score == 1)


def test_empty_table_other_notices_and_clashing_columns(spark):
    assert N.find_notices(docs(spark).limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "a b a b a", "old", 7)], "label long, text string, found string, n_words int")
    done = N.find_notices(odd, (N.Notice("x", "a b a"),), ()).first()
    assert done.label == 1 and done.n_words == 5
    assert [tuple(e) for e in done.found] == [("x", True, 0, 2, 0, 0), ("x", True, 2, 4, 0, 0)]
    assert N.find_notices(odd, (), ()).first().found == []
