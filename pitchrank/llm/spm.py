"""SentencePiece encoding and decoding of whole columns, by a batched Viterbi search.

The model file gives the pieces and their scores; the search is done here. Texts are cut
into words (with the blanks before them), equal words of a batch are encoded once, and
words of equal length advance together: at each position the hashes of all substrings
that end there are probed in the sorted piece keys, and the best way to reach the
position is kept with a pointer back.

For a unigram model the best way is that of the highest sum of scores. A byte-pair model
does not maximise a sum; there a step from one piece to the next is allowed only if
merging the two pieces' characters by rank gives these two pieces again. A sequence in
which every neighbouring pair passes this test is exactly what merging the whole word
gives, and for every prefix there is one, so the same search with forbidden steps yields
the encoder's own result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitchrank.llm.textbytes import U, Words, bounded, buffers, give_back, mix, ranges, slices, word_hashes

BLANK = 0x2581
BASE = 0x9E3779B97F4A7C55


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model, by id, and their keys in sorted order."""

    pieces: list[str]           # as written in the model; empty for control pieces
    bytes_: dict[int, int]      # byte value -> id of its piece, where the model falls back to bytes
    unknown: int
    scores: np.ndarray
    rank_merges: bool           # byte-pair model
    keys: np.ndarray = field(default=None)
    ids: np.ndarray = field(default=None)
    longest: int = 0
    lone: np.ndarray = field(default=None)  # control characters (as bytes) that no piece holds; they stand alone
    near: np.ndarray = field(default=None)  # most substrings are no piece; this tells so at once
    trace: tuple = ()           # how each piece is merged from its characters, see _traces

    @classmethod
    def load(cls, path: str, rank_merges: bool = True) -> Vocabulary:
        """Reads the pieces of a model file; ``rank_merges`` for a byte-pair model, else unigram.

        The text is taken as it is (identity normalisation) with one blank put before it.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        pieces = ["" if s else p for p, s in zip(names, special, strict=True)]
        return cls(pieces, {int(names[i][3:5], 16): i for i in ids if model.is_byte(i)}, model.unk_id(),
                   np.array([model.get_score(i) for i in ids]), rank_merges)

    def __post_init__(self):
        known = [i for i, p in enumerate(self.pieces) if p]
        single = {c for p in self.pieces for c in p if self.rank_merges is False or len(p) == 1}
        for p in (self.pieces[i] for i in known):
            if "▁" in p.lstrip("▁") or self.rank_merges and any(c not in single for c in p):
                raise ValueError(f"piece {p!r} reaches over a blank or holds an unknown character")
        self.lone = np.zeros(256, bool)
        self.lone[[c for c in (*range(32), 127) if chr(c) not in single]] = True
        key = np.array([_key(np.array([[ord(c) for c in self.pieces[i]]], U)) for i in known], U)
        order = np.argsort(key)
        self.keys, self.ids = key[order], np.array(known, np.int32)[order]
        self.longest = max(len(p) for p in self.pieces)
        self.near = np.zeros(1 << 20, bool)
        self.near[(mix(self.keys) >> U(44)).astype(np.int64)] = True
        if self.rank_merges:
            self.trace = _traces(self)

    def probe(self, key: np.ndarray) -> np.ndarray:
        """Piece id of each substring key, -1 where there is none."""
        out = np.full(key.shape, -1, np.int64)
        maybe = np.nonzero(self.near[(mix(key) >> U(44)).astype(np.int64)])
        some = key[maybe]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == some, self.ids[at], -1)
        return out


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Keys of all beginnings of strings of equal length; the key of a substring follows from two of them."""
    out = np.zeros((codes.shape[1] + 1, codes.shape[0]), U)
    for i in range(codes.shape[1]):
        out[i + 1] = out[i] * U(BASE) + codes[:, i].astype(U) + U(1)
    return out


def _traces(v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Merges every piece's characters by rank and notes, before each merge, the two ends.

    Returns where each piece's notes begin, and of each note the score of the merge that
    comes next (-inf after the last one), the key of the last symbol, and the key and
    length of the first symbol.
    """
    sizes = np.array([len(p) for p in v.pieces])
    notes: list[tuple] = []
    for length in range(1, v.longest + 1):
        ids = np.flatnonzero(sizes == length)
        if not len(ids):
            continue
        codes = np.array([[ord(c) for c in v.pieces[i]] for i in ids])
        prefix = _prefixes(codes).T
        power = U(BASE) ** np.arange(length + 1, dtype=U)
        cut = np.ones((len(ids), length + 1), bool)  # places between symbols
        place, live, step = np.arange(length + 1), np.arange(len(ids)), 0
        while len(live):
            rows, mine = np.arange(len(live)), cut[live]
            end = mine[:, 1:].argmax(axis=1) + 1
            begin = length - 1 - mine[:, :-1][:, ::-1].argmax(axis=1)
            if length > 1:
                before = np.maximum.accumulate(np.where(mine, place, 0), axis=1)[:, :-2]
                after = np.minimum.accumulate(np.where(mine, place, length)[:, ::-1], axis=1)[:, ::-1][:, 2:]
                piece = v.probe(prefix[live][rows[:, None], after]
                                - prefix[live][rows[:, None], before] * power[after - before])
                score = np.where((piece >= 0) & mine[:, 1:-1], v.scores[piece], -np.inf)
            else:
                score = np.full((len(live), 1), -np.inf)
            at = score.argmax(axis=1)
            best = score[rows, at]
            notes.append((ids[live], np.full(len(live), step), best,
                          prefix[live, length] - prefix[live, begin] * power[length - begin], prefix[live, end], end))
            going = best > -np.inf
            live, at = live[going], at[going]
            cut[live, at + 1] = False
            step += 1
        if not (cut[:, 1:-1] == False).all():  # noqa: E712
            raise ValueError("a piece cannot be merged from its characters")
    piece, step, *rest = (np.concatenate(x) for x in zip(*notes, strict=True))
    order = np.lexsort((step, piece))
    return (np.searchsorted(piece[order], np.arange(len(sizes))), *[x[order] for x in rest])


def _key(codes: np.ndarray) -> U:
    h = U(0)
    with np.errstate(over="ignore"):
        for c in codes[0]:
            h = h * U(BASE) + c + U(1)
    return h


class Encoder:
    """Encodes batches of texts; keeps what it finds out about pairs of pieces."""

    CACHE = 1 << 20   # pairs of pieces kept
    WORDS = 1 << 19   # words kept
    LONG = 64         # characters of a word that is cut before it is searched
    NEW = 1 << 20     # bytes of words that are searched side by side

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.joints = None  # neighbouring characters within pieces, once a long word comes
        self.power = U(BASE) ** np.arange(1 << 8, dtype=U)
        self.pair_keys = np.full(self.CACHE, ~U(0), U)
        self.pair_fits = np.zeros(self.CACHE, bool)
        self._forget()

    def _forget(self):
        self.hash, self.check, self.where = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where those of each text begin."""
        data, off = buffers(column)
        size = np.diff(off)
        data = np.insert(data, off[:-1][size > 0], 0x20)  # one blank before each text that is not empty
        off = np.concatenate([[0], np.cumsum(size + (size > 0))])
        blank, lone = data[:off[-1]] == 0x20, self.v.lone[data[:off[-1]]]
        begins = lone | blank
        begins[1:] = (lone[1:] | lone[:-1]) | (blank[1:] & ~blank[:-1])
        begins[off[:-1][size > 0]] = True
        start = np.flatnonzero(begins)
        words = Words(data, start, np.append(start[1:], off[-1]).astype(np.int64), np.searchsorted(start, off))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
        hashes, check = word_hashes(words), _second(words)
        known, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
        odd = np.flatnonzero(check != check[lead][which])
        if len(odd):  # equal hashes of different words: these are encoded by themselves
            which[odd] = len(lead) + np.arange(len(odd))
        check = check[lead]
        del blank, lone, begins, start, hashes  # as long as all words
        if len(self.hash) > self.WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.hash, known), max(len(self.hash) - 1, 0))
        old = (self.hash[at] == known) & (self.check[at] == check) if len(self.hash) else np.zeros(len(lead), bool)
        ids, first = self._new_words(words, np.concatenate([lead[~old], odd]))
        base = len(self.first) - 1
        place = np.empty(len(lead) + len(odd), np.int64)
        place[:len(lead)][old] = self.where[at[old]]
        place[:len(lead)][~old] = base + np.arange((~old).sum())
        place[len(lead):] = base + (~old).sum() + np.arange(len(odd))
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.ids = np.concatenate([self.ids, ids])
        fresh = np.concatenate([self.hash, known[~old]])
        order = np.argsort(fresh, kind="stable")
        self.hash = fresh[order]
        self.check = np.concatenate([self.check, check[~old]])[order]
        self.where = np.concatenate([self.where, place[:len(lead)][~old]])[order]
        return _gather(self.ids, self.first, place[which], words.first)

    def _new_words(self, words: Words, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_words``, over parts of about ``NEW`` bytes, as a search takes many times its words' memory."""
        parts = [self._words(words, lead[a:b]) for a, b in _parts((words.end - words.start)[lead], self.NEW)]
        count = np.concatenate([np.zeros(1, np.int64), *[np.diff(first) for _, first in parts]])
        return np.concatenate([np.zeros(0, np.int32), *[ids for ids, _ in parts]]), np.cumsum(count)

    def _words(self, words: Words, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``lead`` end to end, and where each begins."""
        raw, _ = _gather(words.data, np.append(words.start, words.end[-1]), lead, np.arange(len(lead) + 1))
        length = words.end[lead] - words.start[lead]
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        head = (raw & 0xC0) != 0x80
        chars = np.add.reduceat(head, np.cumsum(length) - length).astype(np.int64)
        codes = np.where(codes == 0x20, BLANK, codes).astype(np.int64)
        begin = np.cumsum(chars) - chars
        begin, chars, held = self._cut(codes, begin, chars)
        steps, counts = [], np.zeros(len(begin), np.int64)
        order = np.argsort(chars, kind="stable")
        cuts = np.flatnonzero(np.diff(chars[order], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(chars[order[a]])
            most = max(1, (1 << 19) // n)  # words at a time, for bounded memory
            for c in range(a, b, most):
                group = order[c:min(c + most, b)]
                found, count = self._viterbi(codes[begin[group][:, None] + np.arange(n)])
                counts[group] = count
                steps.append(found)
        ids = np.concatenate(steps)
        where = np.empty(len(begin), np.int64)
        where[order] = np.cumsum(counts[order]) - counts[order]
        ids, first = self._fall_back(ids, where, counts)
        return ids, first[held]

    def _cut(self, codes: np.ndarray, begin: np.ndarray, chars: np.ndarray):
        """Parts of the words, their sizes, and the first part of each word; a word of up to ``LONG`` characters is one.

        Longer ones, such as text written without blanks, are cut wherever no piece holds the
        characters on both sides of the cut. No piece and no merge reaches over it, so the ids
        of the parts are those of the word, and the parts are searched side by side.
        """
        long = np.flatnonzero(chars > self.LONG)
        held = np.arange(len(begin) + 1)
        if not len(long):
            return begin, chars, held
        if self.joints is None:
            pairs = {ord(a) << 32 | ord(b) for p in self.v.pieces for a, b in zip(p, p[1:])}
            self.joints = np.array(sorted(pairs), np.int64)
        inside = np.zeros(len(codes), bool)
        inside[ranges(begin[long] + 1, chars[long] - 1)] = True
        at = np.flatnonzero(inside)
        joint = codes[at - 1] << 32 | codes[at]
        near = np.minimum(np.searchsorted(self.joints, joint), max(len(self.joints) - 1, 0))
        free = at[self.joints[near] != joint] if len(self.joints) else at
        every = np.union1d(begin, free)
        return every, np.diff(every, append=len(codes)), np.append(np.searchsorted(every, begin), len(every))

    def _fall_back(self, ids, where, counts):
        """Puts byte pieces in place of unknown characters, and the words in order."""
        flat, first = _gather_spans(ids, where, counts)
        size = len(self.v.pieces)
        strange = np.flatnonzero(flat >= size)
        if not len(strange):
            return flat.astype(np.int32), first
        parts = {int(c): [self.v.bytes_.get(b, self.v.unknown) for b in chr(c - size).encode()] if self.v.bytes_
                 else [self.v.unknown] for c in np.unique(flat[strange])}
        width = np.ones(len(flat), np.int64)
        width[strange] = [len(parts[int(c)]) for c in flat[strange]]
        out = np.repeat(flat, width)
        at = np.cumsum(width) - width
        for c, part in parts.items():
            here = at[flat == c]
            for k, piece in enumerate(part):
                out[here + k] = piece
        return out.astype(np.int32), np.append(at, len(out))[first]

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of equal length, end to end, and their number in each."""
        n, length = codes.shape
        size = len(self.v.pieces)
        prefix = _prefixes(codes)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.zeros((length + 1, n), np.int64)
        back = np.zeros((length + 1, n), np.int32)
        for i in range(1, length + 1):
            rows_left = np.arange(n)
            for step in range(min(i, self.v.longest), 0, -1):
                if self.v.rank_merges:  # only one step is allowed, so the longest that is ends the search
                    rows_left = rows_left[best[i, rows_left] == -np.inf]
                piece = self.v.probe(prefix[i, rows_left] - prefix[i - step, rows_left] * self.power[step])
                if step == 1:
                    piece = np.where(piece < 0, size + codes[rows_left, i - 1], piece)
                rows = rows_left[piece >= 0]
                if not len(rows):
                    continue
                piece = piece[piece >= 0]
                if self.v.rank_merges and step < i:
                    fits = self._fit(last[i - step, rows], piece)
                    rows, piece = rows[fits], piece[fits]
                total = best[i - step, rows] + self.v.scores[np.minimum(piece, size - 1)] - 1e3 * (piece >= size)
                better = total > best[i, rows]
                rows, piece = rows[better], piece[better]
                best[i, rows], last[i, rows], back[i, rows] = total[better], piece, step
        out = np.zeros((n, length), np.int64)
        count = np.zeros(n, np.int64)
        at, every = np.full(n, length), np.arange(n)
        while len(every):
            here = at[every]
            count[every] += 1
            out[every, length - count[every]] = last[here, every]
            at[every] = here - back[here, every]
            every = every[at[every] > 0]
        return out[np.arange(length) >= (length - count)[:, None]], count

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both pieces by rank gives the two pieces again."""
        size = len(self.v.pieces)
        key = left.astype(U) * U(1 << 22) + right.astype(U)
        slot = (mix(key) >> U(44)).astype(np.int64)
        missing = (self.pair_keys[slot] != key) & (left < size) & (right < size)
        fits = self.pair_fits[slot]
        fits[(left >= size) | (right >= size)] = True  # no piece holds an unknown character
        if missing.any():
            pairs, which = np.unique(key[missing], return_inverse=True)
            answer = self._merge((pairs >> U(22)).astype(np.int64), (pairs & U((1 << 22) - 1)).astype(np.int64))
            fits[missing] = answer[which]
            slot = (mix(pairs) >> U(44)).astype(np.int64)
            self.pair_keys[slot] = pairs  # a later pair of the same slot takes its place
            self.pair_fits[slot] = answer
            late = self.pair_keys[slot] != pairs
            self.pair_fits[slot[~late]] = answer[~late]
        return fits

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Plays the merges of both pieces in order of rank; False once one over the place between them is due.

        Of equal ranks the leftmost merge comes first.
        """
        first, score, last_key, first_key, first_size = self.v.trace
        fits = np.ones(len(left), bool)
        live, i, j = np.arange(len(left)), first[left], first[right]
        while len(live):
            piece = self.v.probe(last_key[i] * self.power[first_size[j]] + first_key[j])
            over = np.where(piece >= 0, self.v.scores[piece], -np.inf)
            mine, other = score[i], score[j]
            crossed = (over > mine) & (over >= other)
            fits[live[crossed]] = False
            going = ~crossed & (np.maximum(mine, other) > -np.inf)
            step = mine >= other
            live, i, j = live[going], (i + step)[going], (j + ~step)[going]
        return fits


def _second(words: Words) -> np.ndarray:
    """A hash of each word that has nothing in common with ``word_hashes``: a weighted sum of its bytes."""
    length = words.end - words.start
    weight = mix(np.arange(int(length.max()), dtype=U))
    out = np.empty(len(length), U)
    for a, b in _parts(length, 1 << 18):  # eight bytes for each byte, several times
        from_, to = words.start[a], words.end[b - 1]
        place = np.arange(from_, to) - np.repeat(words.start[a:b], length[a:b])
        out[a:b] = np.add.reduceat((words.data[from_:to].astype(U) + U(1)) * weight[place], words.start[a:b] - from_)
    return out


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Where neighbours whose sizes add up to about ``most`` begin and end; one at least is in each."""
    if len(sizes):
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1))
        yield from zip(cuts, np.append(cuts[1:], len(sizes)), strict=True)


def _gather_spans(values: np.ndarray, start: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(start - first[:-1], counts)
    at += np.arange(first[-1])
    return values[at], first


def _gather(values: np.ndarray, first: np.ndarray, which: np.ndarray, groups: np.ndarray):
    """The ranges ``which`` of ``values`` end to end, and where each group of them begins."""
    out, at = _gather_spans(values, first[which], first[which + 1] - first[which])
    return out, at[groups]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the piece ids of each text (null for a null text, none for an empty one).

    Whole texts of any length are encoded. A column named ``out`` is replaced; one row
    comes back for each row, other columns unchanged.
    """
    docs = bounded(docs).drop(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in slices(batches, text_col, 4 << 20):  # new words of many texts are searched together
            column = part.column(text_col)
            ids, first = encoder.encode(column)
            yield part.append_column(out, _lists(ids, first, column))
            del part, column, ids, first  # not held while the next texts come
        del encoder
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _lists(ids: np.ndarray, first: np.ndarray, like: pa.Array) -> pa.Array:
    values = pa.array(ids.astype(np.int32))
    if not like.null_count:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values, mask=like.is_null())


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the text that the ids stand for (null for null ids).

    Control pieces stand for nothing, the unknown piece and ids outside the model for U+2047,
    bytes that form no character for U+FFFD. The blank put before a text is taken off.
    """
    rows = bounded(rows).drop(out)
    table = [p.replace("▁", " ").encode() for p in vocabulary.pieces]
    for value, i in vocabulary.bytes_.items():
        table[i] = bytes([value])
    unknown = vocabulary.unknown
    table[unknown] = "⁇".encode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"".join(table), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 256)
                at += 256
                column = part.column(ids_col)
                lengths = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                flat = np.where(np.isnan(flat), -1, flat).astype(np.int64) if flat.dtype.kind == "f" else flat
                flat = np.where((flat < 0) | (flat >= len(table)), unknown, flat)
                text, first = _gather(raw, starts, flat, np.concatenate([[0], np.cumsum(lengths)]))
                whole = text.tobytes()
                texts = [None if null else whole[a + (whole[a:a + 1] == b" "):b].decode("utf-8", "replace")
                         for a, b, null in zip(first[:-1], first[1:], column.is_null().to_pylist(), strict=True)]
                yield part.append_column(out, pa.array(texts, pa.string()))
        give_back()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
