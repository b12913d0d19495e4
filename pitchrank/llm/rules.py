"""Quality rules: a decision list learned from labelled statistics, as Spark conditions.

Every text gets a few counts. From labelled rows sequential covering learns an ordered
list of rules: a rule is grown by adding the threshold condition with the highest
information gain until it covers hardly any good text, then pruned on rows it was not
grown on by dropping its last conditions, and kept if it is precise there; the rows it
covers are set aside and the next one is grown from the rest. The list is short, can be
read (``describe``), and is applied as one chain of ``when`` conditions on the counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.llm.labels import pick_labels
from pitchrank.llm.textbytes import Words, bounded, buffers, find_words, slices, window_hashes, windows, word_hashes

MOST_ROWS = 20_000  # labelled rows learned from, at most
PRECISION = 0.7     # share of bad texts among those a rule covers, on the pruning rows
LEAST = 5           # bad texts a rule covers at least
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
          "n_digits", "n_marks", "n_different")
# Statistics that rules look at: a count over another one.
RATIOS = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "words_in_line": ("n_words", "n_lines"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"), "different": ("n_different", "n_words"), "lower": ("n_lower", "word_chars"),
}
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MARKS = np.isin(np.arange(256), list(b".,;:!?\"'()"))


def count_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text; a null text counts as empty.

    Words are runs of anything but white space. ``word_chars``: code points in words;
    ``n_symbols``: characters of ``#*$%&|<>``; ``n_lines``: lines with a word, and
    ``n_dup_lines`` those equal to an earlier one; ``n_repeat_words``: words in windows of
    three words that the text has twice or more; ``n_upper``, ``n_lower``, ``n_digits``:
    ASCII letters and digits; ``n_marks``: punctuation; ``n_different``: different words.
    One row comes back for each row; columns named like a count are replaced.
    """
    docs = bounded(docs).drop(*COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            counts = _counts(*buffers(part.column(text_col)))
            for name in COUNTS:
                part = part.append_column(name, pa.array(counts[name], pa.int64()))
            yield part

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in COUNTS]]))


def _counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    words = find_words(data, off)
    n = words.n
    text = words.text_of()
    size = int(off[-1])
    used = data[:size]

    def by_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[off[1:]] - total[off[:-1]]

    heads = np.concatenate([[0], np.cumsum((used & 0xC0) != 0x80, dtype=np.int64)])
    chars = heads[words.end] - heads[words.start]
    hashes = word_hashes(words)
    out = {"n_words": np.diff(words.first), "word_chars": np.bincount(text, chars, n).astype(np.int64),
           "n_symbols": by_text(SYMBOLS[used]), "n_upper": by_text((used >= 65) & (used <= 90)),
           "n_lower": by_text((used >= 97) & (used <= 122)), "n_digits": by_text((used >= 48) & (used <= 57)),
           "n_marks": by_text(MARKS[used])}
    first, _ = _firsts(text, hashes)
    out["n_different"] = np.bincount(text[first], minlength=n)

    # windows of three words that the text has more than once
    at, owner = windows(words, 3)
    lead, twin = _firsts(owner, window_hashes(hashes, at, 3))
    again = np.zeros(len(at), bool)
    again[~lead] = True
    again[twin[~lead]] = True
    cover = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 3, -1)
    out["n_repeat_words"] = np.bincount(text[np.cumsum(cover)[:-1] > 0], minlength=n)

    # lines
    start = np.zeros(size + 1, bool)
    start[off[:-1]] = True
    start[1:] |= used == 10
    begin = np.flatnonzero(start[:size])
    feeds = np.append(np.flatnonzero(used == 10), size)
    stop = np.minimum(feeds[np.searchsorted(feeds, begin)], off[np.searchsorted(off, begin, "right")])
    some = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop = begin[some], stop[some]
    lines = Words(data, begin, stop, np.searchsorted(begin, off))
    lead, _ = _firsts(lines.text_of(), word_hashes(lines))
    out["n_lines"] = np.diff(lines.first)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(lines.text_of()[lead], minlength=n)
    return out


def _firsts(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each entry is the first of its hash in its text, and the place of that first one."""
    order = np.lexsort((np.arange(len(text)), hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    first, twin = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    first[order[new]] = True
    twin[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else twin
    return first, twin


def ratios() -> dict[str, Column]:
    """The statistics as expressions on the counts; over nothing they are 0."""
    return {name: F.col(a).cast("double") if b is None else
            F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for name, (a, b) in RATIOS.items()}


# ---------------------------------------------------------------- learning

@dataclass
class Rule:
    """A text is bad if all conditions (statistic, above?, threshold) hold."""

    conditions: list[tuple[str, bool, float]]
    covered: int  # bad and good rows it covered when it was learned, those of earlier rules left out
    wrong: int

    def describe(self) -> str:
        return " and ".join(f"{n} {'>=' if up else '<='} {t:.6g}" for n, up, t in self.conditions)

    def column(self) -> Column:
        every = ratios()
        return reduce(lambda a, b: a & b, [every[n] >= t if up else every[n] <= t for n, up, t in self.conditions])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text",
          most_rows: int = MOST_ROWS) -> list[Rule]:
    """Rules for texts labelled 0, from ``docs`` (doc_id and text) with ``labels`` of 0 or 1.

    If more than ``most_rows`` documents are labelled, a hash of their ids picks about
    that many; the larger of several labels counts. Rows without a text, an id or a label
    teach nothing, and without both kinds there is no rule. Only statistics reach the
    driver.
    """
    picked = pick_labels(labels, label_col, most_rows).withColumnRenamed(label_col, "label")
    sample = docs.select("doc_id", F.col(text_col).alias("text")).where("text IS NOT NULL").join(
        F.broadcast(picked), "doc_id")
    table = count_texts(sample).select("label", *[c.alias(n) for n, c in ratios().items()]).toArrow()
    bad = table.column("label").to_numpy() == 0
    values = np.stack([table.column(n).to_numpy() for n in RATIOS], axis=1) if len(bad) else np.zeros((0, len(RATIOS)))
    order = np.lexsort((*values.T, bad))  # the same split whatever order the rows came in
    return cover(values[order], bad[order], list(RATIOS))


def cover(values: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """Sequential covering: every third row prunes, the others grow."""
    rules: list[Rule] = []
    pruning = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while (left & bad & ~pruning).sum() >= LEAST:
        grown = _grow(values[left & ~pruning], bad[left & ~pruning])
        if not grown:
            break
        best, worth = None, -np.inf
        for k in range(len(grown), 0, -1):
            hit = _holds(values[left & pruning], grown[:k])
            p = int((hit & bad[left & pruning]).sum())
            if hit.sum() and (value := (2 * p - hit.sum()) / hit.sum()) >= worth:
                best, worth = grown[:k], value
        if best is None or worth < 2 * PRECISION - 1:
            break
        hit = left & _holds(values, best)
        if (hit & bad).sum() < LEAST:
            break
        rules.append(Rule([(names[c], up, t) for c, up, t in best], int(hit.sum()), int((hit & ~bad).sum())))
        left &= ~hit
    return rules


def _holds(values: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    return reduce(lambda a, b: a & b, [values[:, c] >= t if up else values[:, c] <= t for c, up, t in conditions])


def _grow(values: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    conditions: list[tuple[int, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while (inside & ~bad).any():
        best, gain = None, 1e-9
        p0, n0 = (inside & bad).sum(), inside.sum()
        for c in range(values.shape[1]):
            order = np.argsort(values[inside, c], kind="stable")
            v, b = values[inside, c][order], bad[inside][order]
            edge = np.flatnonzero(v[1:] > v[:-1])  # thresholds lie halfway between two values
            middle = (v[edge] + v[edge + 1]) / 2
            below, n_below = np.cumsum(b)[edge], edge + 1
            for up, p, n in ((False, below, n_below), (True, p0 - below, n0 - n_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(p >= LEAST, p * (np.log2(p / n) - np.log2(p0 / n0)), -np.inf)
                if len(value) and value.max() > gain:
                    at = int(value.argmax())
                    best, gain = (c, up, float(middle[at])), value[at]
        if best is None:
            break
        conditions.append(best)
        inside &= _holds(values, [best])
    return conditions


def apply(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """``counted`` (see ``count_texts``) with ``rule``: the number, from 1, of the first rule that holds, else 0."""
    verdict = F.lit(0)
    for n, rule in reversed(list(enumerate(rules, 1))):
        verdict = F.when(rule.column(), F.lit(n)).otherwise(verdict)
    return counted.withColumn("rule", verdict)
