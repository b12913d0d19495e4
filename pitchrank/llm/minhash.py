"""Near-duplicate documents by BagMinHash signatures of their word shingles.

A document is the bag of its shingles, and two documents are alike by weighted Jaccard
similarity: shared shingles counted with repetition, over all of either. Each shingle
``x`` has a Poisson process over weight and time; a document in which ``x`` occurs ``w``
times sees the points with a weight below ``w``, and its signature holds, for each of the
slots that points are dealt to, the time of the earliest point it sees. Two signatures
agree in a slot with a probability equal to the weighted Jaccard similarity.

The process is generated in levels: weights 0-1, 1-2, 2-4, 4-8 and so on have a process
each, at a rate equal to the level's width, and a point's exact weight is drawn only
within its level. So a shingle that occurs ``w`` times costs about ``log2(w)`` processes
and not ``w``. Points come in order of time, and a process stops once it is behind all
slots of its document, which leaves few points per shingle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pitchrank.llm.components import components, gathered
from pitchrank.llm.textbytes import (
    U, bounded, buffers, counted, find_words, give_back, mix, shingles, slices, word_hashes,
)
from pitchrank.operators.joins import lookup_join
from pitchrank.session import materialize

# At a similarity of 0.8 a pair shares no band with a probability of
# (1 - 0.8 ** 5) ** 26 = 3e-5.
BANDS, ROWS = 26, 5
CELLS = 256         # of a sketch
BLOCK = 4096        # members of a bucket that are compared with as many others in one go
TEXTS = 4096        # different texts that a task takes, besides one task for each core
SOME = 64           # one text of so many tells which shingles are common
COMMON = 1 << 17    # shingles that are known to be common, at most
MARK_BYTES = 8 << 20  # of shared marks that are broadcast
FEW_CELLS = 64      # of a sketch of texts that share a mark
SKETCH = "node long, total long, cells binary"


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id",
                    text_col: str = "text", bands: int = BANDS, rows: int = ROWS, exact: bool = True) -> DataFrame:
    """``docs`` with ``class_id``: the smallest id among the documents it is a near copy of.

    Documents are linked if their texts are equal, or if the weighted Jaccard similarity of
    their shingles of ``size`` words is ``threshold`` or more (a text of fewer words is one
    shingle; words are runs of anything but white space). Classes are the connected
    components of these links. Every link is verified exactly. Candidates are all pairs that
    share a signature band: none is left out, however large a bucket is, but those whose
    documents are in one class anyway. In a bucket that stays divided a document meets
    representatives of the other classes first and then all their members by sketches (see
    ``_classes``). Pairs that happen to share no band are found by their marks (see ``_marks``),
    which any two alike texts have in common, so no link is left to chance. Without ``exact``
    only the representatives are met.

    Texts without words are alike only if equal. A row with a null text or a null id is a
    class of its own, ``class_id`` being its id. ``class_key`` is the MD5 of the text that
    stands for the class, the one of the smallest id (of the smallest key, if an id has
    several texts); it tells classes apart where different texts share an id. Every row
    comes back once; columns named ``class_id`` and ``class_key`` are replaced.
    """
    docs = bounded(docs).drop("class_id", "class_key")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.md5(text_col).alias("key"),
                        F.col(text_col).alias("body")).where("doc IS NOT NULL AND body IS NOT NULL")
    # copies are folded first, so that a text counts once however often it occurs
    signed = keyed.mapInArrow(_signatures(size, bands, rows), "doc long, key string, bands array<long>")
    seen = Observation()
    texts = materialize(signed.groupBy("key").agg(
        F.min("doc").alias("doc"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"),
    ).observe(seen, F.count(F.lit(1)).alias("n")), "signatures")
    n = seen.get["n"]
    # a text is known by its smallest id, or by a hash if that is another text's too
    lead = texts.groupBy("doc").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    node = F.when(F.col("key") > F.col("lead"), F.xxhash64("doc", "key")).otherwise(F.col("doc"))
    texts = texts.join(_few(lead.select("doc", "lead"), n), "doc", "left").withColumn("node", node).drop("lead")
    texts = materialize(_few(texts, n), "texts")
    found = _classes(keyed, texts, n, threshold, size, exact)
    known = _few(texts.drop("bands").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), n)
    stands = known.groupBy("component").agg(F.min(F.struct("doc", "key")).alias("first"), F.count(F.lit(1)).alias("n"))
    # texts that are alone stand for themselves and are not looked up
    classes = known.join(stands, "component").where("copies > 1 OR n > 1").select(
        F.col("key").alias("_key"), F.col("first.doc").alias("_class"), F.col("first.key").alias("_stands"), "copies")
    own = F.when(F.col(id_col).isNotNull(), F.md5(text_col))
    done = lookup_join(docs.withColumn("_key", own), _few(classes, n), ["_key"], "copies")
    return done.select(*docs.columns, F.coalesce("_class", F.col(id_col).cast("long")).alias("class_id"),
                       F.coalesce("_stands", "_key").alias("class_key"))


def _few(df: DataFrame, n: int) -> DataFrame:
    """``df``, which has some rows for each of ``n`` texts, in partitions of a size that is worth a task."""
    return gathered(df, n, TEXTS)


# ---------------------------------------------------------------- signatures

def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body", 1 << 20):
            words = find_words(*buffers(part.column("body")))
            hashes, text = shingles(words, word_hashes(words), size)
            text, shingle, weight = counted(text, hashes)
            slots = bag_minhash(text, shingle, weight, part.num_rows, bands * rows)
            some = np.isin(np.arange(part.num_rows), text)
            folded = np.zeros((part.num_rows, bands), U)
            for k in range(rows):
                folded = mix(folded * U(0x9FB21C651E98DF25) + slots[:, k::rows].view(U))
            folded = mix(folded + np.arange(bands, dtype=U))
            at = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            values = pa.array(folded[some].reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("key"), pa.ListArray.from_arrays(pa.array(at), values)],
                names=["doc", "key", "bands"])

    return run


def bag_minhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures, ``n`` texts by ``m`` slots, of bags given as (text, shingle, weight)."""
    slots = np.full(n * m, np.inf)
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    owner, top = text[which], weight[which]
    seed = mix(shingle[which] * U(0xA0761D6478BD642F) + level.astype(U))
    time = np.zeros(len(which))
    latest = np.full(n, np.inf)
    count = 0
    while len(owner):
        count += 1
        draw = mix(seed + U(count * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time += -np.log(((draw >> U(11)).astype(float) + 0.5) * 2.0 ** -53) / width
        alive = time <= latest[owner]
        if not alive.all():
            owner, top, seed, time, low, width, draw = (
                x[alive] for x in (owner, top, seed, time, low, width, draw))
        place = mix(draw + U(0xE7037ED1A0B428DB))
        at = low + (((place >> U(32)) * width.astype(U)) >> U(32)).astype(np.int64)
        seen = at < top
        np.minimum.at(slots, owner[seen] * m + ((place & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)[seen],
                      time[seen])
        touched = np.unique(owner)
        latest[touched] = slots.reshape(n, m)[touched].max(axis=1)
    return slots.reshape(n, m)


# ---------------------------------------------------------------- links

def _classes(keyed: DataFrame, texts: DataFrame, n: int, threshold: float, size: int, exact: bool) -> DataFrame:
    """(node, component): the class of every text that is linked to another one; ``texts`` are ``n``.

    Each band's bucket is compared with its smallest member first, which settles the usual
    bucket of copies of one text at once. What is left are buckets whose members lie in
    different components, typically a large group of near copies of which some are a little
    too far from the others. Such a bucket is split further, by each band together with the
    next one its members have, and in every part each member is compared with two others:
    the most central one of the largest component and one of the smallest, if these are
    not its own. That is a bounded number of pairs for each member. Rounds follow until one
    brings no link; what remains unseen after that is compared only if ``exact``, and so are
    texts of different components that have marks in common.
    """
    members = texts.select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("node").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = materialize(_few(members.join(shared, "band"), n), "buckets")
    bodies = _bodies(_rows_of(members.select("node"), keyed, texts, n), n)

    tried = materialize(_few(members.where("node <> pivot").select(
        F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), n), "pairs")
    links = materialize(_verify(tried, bodies, n, threshold, size), "alike")
    found = materialize(_few(components(links, n), n), "components")
    n_links, new = links.count(), None
    while True:
        pairs = materialize(_few(_untried(_to_representatives(members, found, n), tried), n), "pairs")
        fresh = materialize(_verify(pairs, bodies, n, threshold, size), "alike")
        n_fresh = fresh.count()
        tried, n_links, new = tried.unionByName(pairs), n_links + n_fresh, fresh if n_fresh else None
        if not n_fresh or exact and n_fresh * 100 < n_links:
            break  # the rest finds what few links further rounds would bring
        found = materialize(_few(_joined(found, fresh, n), n), "components")
    if exact:
        rest = materialize(_few(_untried(_rest(members, found, bodies, threshold, size, n), tried), n), "pairs")
        fresh = materialize(_verify(rest, bodies, n, threshold, size), "alike")
        if not fresh.isEmpty():
            new = fresh if new is None else new.unionByName(fresh)
    if new is not None:
        found = materialize(_few(_joined(found, new, n), n), "components")
    if not exact:
        return found
    placed = materialize(_marked(keyed, texts, found, threshold, size, n), "divided")
    sketches = _rows_of(placed.select("node"), keyed, texts, n).select("node", "body").mapInArrow(
        _sketches(size, FEW_CELLS), SKETCH).dropDuplicates(["node"])
    met = _met(placed, _few(sketches, n), threshold, n).groupBy("a", "b").agg(
        F.sum("shared").alias("shared"), F.max("least").alias("least")).where("shared >= least").select("a", "b")
    pairs = materialize(_few(_untried(met, tried.unionByName(rest)), n), "pairs")
    if pairs.isEmpty():
        return found
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    links = materialize(_verify(pairs, _bodies(_rows_of(ends, keyed, texts, n), n), n, threshold, size), "alike")
    return found if links.isEmpty() else _joined(found, links, n)


def _rows_of(nodes: DataFrame, keyed: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Rows of ``keyed`` that hold the texts of ``nodes``."""
    wanted = nodes.distinct().join(texts.select("node", "doc", "key"), "node").select("doc", "key", "node", F.lit(1).alias("n"))
    return lookup_join(keyed, _few(wanted, n), ["doc", "key"], "n", "inner")


def _bodies(rows: DataFrame, n: int) -> DataFrame:
    return materialize(_few(rows.groupBy("node").agg(F.first("body").alias("body")), n), "bodies")


def _joined(found: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Components that ``found`` and further links make together."""
    return components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links), n)


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    return pairs.distinct().join(tried, ["a", "b"], "left_anti")


def _placed(members: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Members of the buckets that hold several components, with their component."""
    placed = _few(members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), n)
    divided = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return _few(placed.join(_few(divided.select("band"), n), "band"), n)


def _to_representatives(members: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of members of divided buckets and representatives of other components there.

    A member is the more central the larger its buckets are. Every member has its bands and
    the pairs of neighbours among them as keys, twice the number of bands at most.
    """
    held = _placed(members, found, n).groupBy("node", "component").agg(
        F.sort_array(F.collect_list("band")).alias("bands"), F.sum("n").alias("central"))  # as many as bands at most
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    held = _few(held, n).join(_few(sizes, n), "component", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    two = F.transform(F.slice("bands", F.lit(2), F.greatest(F.size("bands") - 1, F.lit(0))),
                      lambda b, i: F.xxhash64(F.get("bands", i), b))
    keys = materialize(_few(held.select(
        "node", "component", "central", "weight", F.explode(F.concat("bands", two)).alias("part")), n), "parts")
    ends = keys.groupBy("part").agg(
        F.max(F.struct("weight", "component", "central", "node")).alias("most"),
        F.min(F.struct("weight", "component", -F.col("central"), "node")).alias("least")
    ).where("most.component <> least.component").select(
        "part", F.col("most.component").alias("main"), F.array("most.node", "least.node").alias("ends"),
        F.array("most.component", "least.component").alias("of"))
    met = _few(keys.join(_few(ends, n), "part"), n).where("component <> main").select(
        "node", "component", F.explode(F.arrays_zip("ends", "of")).alias("end")).where("end.of <> component")
    return met.select(F.least("node", "end.ends").alias("a"), F.greatest("node", "end.ends").alias("b"))


def _marked(keyed: DataFrame, texts: DataFrame, found: DataFrame, threshold: float, size: int, n: int) -> DataFrame:
    """(band, node, component, weight) of the marks, here the bands, that texts of different components have.

    Most marks are those of one text; they are exchanged once and go no further.
    """
    rows = keyed.select(F.xxhash64("key").alias("id"), "body").mapInArrow(
        _all_marks(size, threshold, _common(keyed, size)), "band long, id long, weight int")
    shared = rows.repartition("band").sortWithinPartitions("band").mapInArrow(_several, rows.schema)
    known = texts.select(F.xxhash64("key").alias("id"), "node").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    each = materialize(shared.join(_few(known, n), "id").select("band", "node", "component", "weight"), "marks")
    divided = each.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"),
    ).where("low <> high").select("band", "n")
    return lookup_join(each, divided, ["band"], "n", "inner", MARK_BYTES).dropDuplicates(["band", "node"])


def _common(keyed: DataFrame, size: int) -> pa.Table:
    """(shingle, n) of shingles that several texts of a few have, the commonest if they are many.

    They only tell which shingles to put last in ``_marks``; whichever these are, no pair is lost.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body", 1 << 20):
            words = find_words(*buffers(part.column("body")))
            hashes, text = shingles(words, word_hashes(words), size)
            yield pa.RecordBatch.from_arrays([pa.array(counted(text, hashes)[1].view(np.int64))], names=["shingle"])

    some = keyed.select("body").where(F.pmod(F.xxhash64("body"), F.lit(SOME)) == 0)
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 3").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow().sort_by("shingle")


def _all_marks(size: int, threshold: float, common: pa.Table):
    """Marks of each text (id, body) with the number of times they occur; copies in a task count once."""
    names, counts = common.column("shingle").to_numpy().view(U), common.column("n").to_numpy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "body", 1 << 20):
            part = part.filter(pa.array([not (i in seen or seen.add(i)) for i in part.column("id").to_pylist()]))
            words = find_words(*buffers(part.column("body")))
            hashes, text = shingles(words, word_hashes(words), size)
            text, shingle, weight = _marks(*counted(text, hashes), part.num_rows, threshold, names, counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle.view(np.int64)), pa.array(part.column("id").to_numpy()[text]),
                 pa.array(weight.astype(np.int32))], names=["band", "id", "weight"])

    return run


def _marks(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, threshold: float,
           names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of each text in one order of all shingles, so many that alike texts share one of them.

    Of ``m`` shingles, counted with repetition, a text that is alike has ``threshold * m`` or more,
    so the first of these is among the first ``m - threshold * m + 1``. Bags come ordered by text
    and shingle. The common shingles ``names`` are put last, the commonest behind the others, so
    that few texts share a mark.
    """
    if len(names) and len(shingle):
        at = np.minimum(np.searchsorted(names, shingle), len(names) - 1)
        level = np.where(names[at] == shingle, np.log2(counts)[at].astype(np.int64), 0)
        if level.any():
            order = np.argsort(text * 64 + level, kind="stable")
            shingle, weight = shingle[order], weight[order]
    total = np.bincount(text, weight, n)
    most = (total - np.ceil(threshold * total - 1e-9) + 1).astype(np.int64)
    before = np.cumsum(weight) - weight - (np.cumsum(total) - total).astype(np.int64)[text]
    taken = before < most[text]
    return text[taken], shingle[taken], weight[taken]


def _several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are not alone in their band; they come sorted by it."""
    last, kept = None, False  # the row before, and whether it has been found to be one of several
    for batch in batches:
        if not batch.num_rows:
            continue
        both = batch if last is None else pa.concat_batches([last, batch])
        band = both.column("band").to_numpy()
        same = band[1:] == band[:-1]
        keep = np.concatenate([[kept], same]) | np.concatenate([same, [False]])
        last, kept = both.slice(both.num_rows - 1), bool(keep[-1])
        yield both.slice(0, both.num_rows - 1).filter(pa.array(keep[:-1]))
    if kept:
        yield last
    give_back()


def _rest(members: DataFrame, found: DataFrame, bodies: DataFrame, threshold: float, size: int, n: int = 0) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and may be alike, none of them left out.

    Every text has a sketch, the counts of its shingles in ``CELLS`` cells. Two texts differ in
    their cells by no more than in their shingles, so a pair whose cells differ too much, or whose
    sizes do, is not alike; the others are to be verified. The time still grows with the
    square of a bucket, but a bucket is dealt out in pairs of blocks of some
    ``BLOCK`` members, which are all that a task holds at a time.
    """
    placed = materialize(_placed(members, found, n).select("band", "node", "component", F.lit(1).alias("weight")), "divided")
    sketches = _few(bodies.join(_few(placed.select("node").distinct(), n), "node", "left_semi"), n).mapInArrow(
        _sketches(size), SKETCH)
    return _met(placed, sketches, threshold, n).select("a", "b").distinct()


def _met(placed: DataFrame, sketches: DataFrame, threshold: float, n: int) -> DataFrame:
    """Pairs (a, b) of different components in a band of ``placed`` that their sketches do not rule out, for each band.

    ``shared`` is how often both have the band, if that is a mark. Summed over the marks of an
    alike pair it comes to ``least`` or more: all they share but for what lies behind one text's marks.
    """
    blocks = placed.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = placed.join(_few(blocks, n), "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    copies = _few(_few(dealt, n).join(sketches, "node"), n).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = copies.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                          "block", "node", "component", "weight", "total", "cells")
    return tiles.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(
        _close(threshold), "a long, b long, shared long, least double")


def _sketches(size: int, n_cells: int = CELLS):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "body", 1 << 20):
            n = part.num_rows
            words = find_words(*buffers(part.column("body")))
            hashes, text = shingles(words, word_hashes(words), size)
            cell = text.astype(np.int64) * n_cells + (mix(hashes) % U(n_cells)).astype(np.int64)
            # counts beyond a byte are cut, which brings no two of them further apart
            counts = np.minimum(np.bincount(cell, minlength=n * n_cells), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                 pa.array([line.tobytes() for line in counts.reshape(n, n_cells)], pa.binary())],
                names=["node", "total", "cells"])

    return run


def _close(threshold: float):
    """Pairs of each tile (band, i, j) that sizes and sketches do not rule out; rows come sorted by tile."""
    def pairs(tile: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        i, j, block, node, component, weight, total, cells = tile
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        at_once = max(1, (1 << 16) // max(1, len(two)))
        for start in range(0, len(one), at_once):
            some = one[start:start + at_once]
            less, more = (f(total[some, None], total[two]) for f in (np.minimum, np.maximum))
            met = (component[some, None] != component[two]) & (less >= threshold * more - 1e-9)
            if i[0] == j[0]:
                met &= some[:, None] < two
            left, right = (x[y] for x, y in zip((some, two), np.nonzero(met), strict=True))
            for at in range(0, len(left), 1 << 13):
                a, b = left[at:at + (1 << 13)], right[at:at + (1 << 13)]
                apart = (np.maximum(cells[a], cells[b]) - np.minimum(cells[a], cells[b])).sum(1, dtype=np.int64)
                near = apart <= (1 - threshold) / (1 + threshold) * (total[a] + total[b]) + 1e-6
                a, b = a[near], b[near]
                if len(a):
                    shared, both, more = np.minimum(weight[a], weight[b]), total[a] + total[b], np.maximum(total[a], total[b])
                    least = threshold / (1 + threshold) * both - np.ceil(threshold * more) + 1 - 1e-6
                    a, b = node[a], node[b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shared.astype(np.int64)),
                         pa.array(least)], names=["a", "b", "shared", "least"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last tile so far, which the next batch may continue
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy() for k in range(8)]
            cells = batch.column(8).to_pylist()
            own.append(np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1))
            held = own if held is None else [np.concatenate(both) for both in zip(held, own, strict=True)]
            band, i, j = held[:3]
            cuts = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for low, high in zip([0, *cuts[:-1]], cuts, strict=False):
                yield from pairs([x[low:high] for x in held[1:]])
            if len(cuts):
                held = [x[cuts[-1]:] for x in held]
        if held is not None:
            yield from pairs(held[1:])
            held = None
        give_back()

    return run


def _verify(pairs: DataFrame, bodies: DataFrame, n: int, threshold: float, size: int) -> DataFrame:
    one = bodies.select(F.col("node").alias("a"), F.col("body").alias("left"))
    two = bodies.select(F.col("node").alias("b"), F.col("body").alias("right"))
    return _few(_few(pairs.join(one, "a"), n).join(two, "b"), n).select("a", "b", "left", "right").mapInArrow(
        _alike(threshold, size), "a long, b long")


def _alike(threshold: float, size: int):
    def bag(column, n: int):
        words = find_words(*buffers(column))
        hashes, text = shingles(words, word_hashes(words), size)
        text, shingle, count = counted(text, hashes)
        return (text.astype(U) << U(48)) | shingle, count, np.bincount(text, count, n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "left", 1 << 20):
            for piece in slices([part], "right", 1 << 20):
                n = piece.num_rows
                (left, times, total), (right, others, rest) = bag(piece.column("left"), n), bag(piece.column("right"), n)
                common, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
                shared = np.bincount((common >> U(48)).astype(np.int64), np.minimum(times[i], others[j]), n)
                yield piece.select(["a", "b"]).filter(pa.array(
                    (shared > 0) & (shared >= threshold * (total + rest - shared) - 1e-9)))

    return run
