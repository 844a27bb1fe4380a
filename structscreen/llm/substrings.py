"""Substring dedup: passages that start in an earlier document, by sharded FM-indexes.

A window is ``WINDOW`` consecutive words.  A word goes if some window over it also starts in a
document with a smaller id; windows are judged on the input.

1. Every window has an anchor: its word ``GRAM``-gram of least hash.  Equal windows have equal
   anchors, so windows are sharded by anchor, and neighbouring windows of one anchor travel
   together as one segment.  First only (anchor, document) pairs are shuffled; anchors of a
   single document end there, which is most of the text.  Copies inside one block of documents
   are recognized in place, and one row per block and anchor goes on, so that an anchor of very
   many documents is no hot key.
2. Segments of the anchors left go to their shard.  A shard's segments are concatenated and
   compiled into an FM-index: suffix order, Burrows-Wheeler transform in a levelwise wavelet
   tree of packed bits with rank counts, and symbol counts.  Backward search over the wavelet
   tree yields the matching statistics of all windows at once; an interval that still holds
   another segment after ``WINDOW`` words is reported with the least document id in it.
3. Reports name the places of each segment, and each document drops the words covered.

An anchor with more documents than ``HOT`` (or a millionth of all pairs, if that is more) is not
kept together: its windows travel alone, sharded by their whole content, and their places meet
the reports in a join that adaptive execution can split.  At most a million anchors can be that
hot; this bounds the broadcast set of them.

Defined cases: null or empty texts have no words; a null id is neither smaller nor larger than
any, so its document stays whole and removes nothing; rows of equal id never remove each other's
words; equal rows get equal results; other columns are carried along.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscreen.llm.common import written

WINDOW = 13
GRAM = 5
HOT = 20_000
_REACH = WINDOW - GRAM + 1
_BLOCK_BYTES = 8 << 20
_INDEX_WORDS = 400_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PIECE, _LONG = 1 << 19, 1 << 12  # bytes hashed at once; longer words are hashed alone
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a few MB of text (or one document): (rows, texts as bytes)."""
    for batch in batches:
        texts = batch.column("body").cast(pa.large_binary()).to_pylist()
        start, size = 0, 0
        for row, text in enumerate(texts):
            size += len(text or b"")
            if size >= _BLOCK_BYTES or row + 1 == len(texts):
                yield batch.slice(start, row + 1 - start), [t or b"" for t in texts[start:row + 1]]
                start, size = row + 1, 0


def _powers(x: int) -> np.ndarray:
    found = np.full(_PIECE + _LONG + 1, x, dtype=np.uint64)
    found[0] = 1
    return np.cumprod(found)


_UP, _DOWN = _powers(0xD6E8FEB86659FD93), _powers(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word ``raw[begin:end]``: its bytes as digits, from sums over the text.

    Words of one hash only share a shard, where they are told apart by their bytes.
    """
    found, at = np.empty(len(begin), dtype=np.uint64), 0
    for stop in [*np.flatnonzero(end - begin > _LONG).tolist(), len(begin)]:
        while at < stop:
            to = min(stop, int(np.searchsorted(begin, begin[at] + _PIECE)))
            here, ends = begin[at:to] - begin[at], end[at:to] - begin[at]
            sums = np.zeros(ends[-1] + 1, dtype=np.uint64)
            np.cumsum((raw[begin[at]:end[to - 1]].astype(np.uint64) + np.uint64(1)) * _UP[:ends[-1]], out=sums[1:])
            found[at:to] = (sums[ends] - sums[here]) * _DOWN[here]
            at = to
        if at < len(begin):
            found[at] = xxhash.xxh3_64_intdigest(raw[begin[at]:end[at]].tobytes())
            at += 1
    return _mix(found)


class _Words:
    """The words of some texts, behind each other; ``first`` is the number of each text's first word."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        blank = np.concatenate(([True], _BLANK[self.raw]))
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        self.begin, self.end = edges[::2], edges[1::2]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.begin, starts)
        # every word with one blank behind it
        stay = ~(blank[1:] & blank[:-1])
        self.text = np.where(blank[1:], np.uint8(32), self.raw)[stay].tobytes()
        self.at = np.concatenate(([0], np.cumsum(self.end - self.begin + 1)))

    def __len__(self) -> int:
        return len(self.begin)

    def joined(self, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The words from each ``begin`` to before each ``end``, joined by one blank."""
        return [self.text[a:b] for a, b in zip(self.at[begin].tolist(), (self.at[end] - 1).tolist())]


def _anchors(texts: list[bytes]):
    """Words of all texts, and per window: start, row and anchor."""
    words = _Words(texts)
    empty = np.zeros(0, dtype=np.int64)
    if len(words) < WINDOW:
        return words, empty, empty, empty.view(np.uint64)
    each = _word_hashes(words.raw, words.begin, words.end)
    grams = np.zeros(len(words) - GRAM + 1, dtype=np.uint64)
    for k in range(GRAM):
        grams *= _FACTOR
        grams += each[k:len(words) - GRAM + 1 + k]
    grams = _mix(grams)
    least, width = grams, 1
    while width < _REACH:  # sliding minimum by doubling
        step = min(width, _REACH - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    starts = np.arange(len(words) - WINDOW + 1)
    row = np.repeat(np.arange(len(texts)), np.diff(words.first))
    inside = row[starts] == row[starts + WINDOW - 1]
    starts = starts[inside]
    return words, starts, row[starts], least[starts]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, body) -> (r, anchor, doc, n).

    Rows with ``n``: one per anchor of a block, its least document and the number of documents.
    Rows without: further places of anchors that the block itself holds twice, ready as they are
    and dealt by document.
    """
    for rows, texts in _blocks(batches):
        docs = rows.column("id").to_numpy(zero_copy_only=False)
        _, _, row, anchor = _anchors(texts)
        if not len(row):
            continue
        change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
        anchor, doc = anchor[change], docs[row[change]]
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
        anchor, doc = anchor[fresh].view(np.int64), doc[fresh]
        heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(anchor)])))
        several = np.repeat(sizes > 1, sizes)
        ready = int(several.sum())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((anchor[heads], _mix(doc[several].view(np.uint64)).view(np.int64)))),
            pa.array(np.concatenate((anchor[heads], anchor[several]))),
            pa.array(np.concatenate((doc[heads], doc[several]))),
            pa.array(np.concatenate((sizes, np.zeros(ready, dtype=np.int64))), mask=np.arange(len(heads) + ready) >= len(heads)),
        ], ["r", "anchor", "doc", "n"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``r`` -> (doc, anchor, n) of anchors that lie in two documents or more."""

    def settle(anchor, doc, n):
        heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.concatenate((heads, [len(anchor)])))
        total = np.repeat(np.add.reduceat(n, heads), sizes) if len(anchor) else n
        many = np.repeat(sizes > 1, sizes)
        return [anchor[many], doc[many], total[many]]

    held = [np.zeros(0, dtype=np.int64)] * 3
    for batch in batches:
        known = batch.column("n").is_null().to_numpy(zero_copy_only=False)
        anchor, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "doc"))
        n = batch.column("n").fill_null(0).to_numpy(zero_copy_only=False)
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(anchor[known]), pa.nulls(int(known.sum()), pa.int64())], ["doc", "anchor", "n"])
        held = [np.concatenate((h, c[~known])) for h, c in zip(held, (anchor, doc, n))]
        if len(held[0]):
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on in the next batch
            done, held = [h[:last] for h in held], [h[last:] for h in held]
            anchor, doc, n = settle(*done)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(anchor), pa.array(n)], ["doc", "anchor", "n"])
    anchor, doc, n = settle(*held)
    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(anchor), pa.array(n)], ["doc", "anchor", "n"])


_SEGMENTS = "route int, segment binary, least long, most long, places binary"
_PLACE = struct.Struct("<qqi")  # document id, hash of its text, first word of the segment
_PLACES = np.dtype([("doc", "<i8"), ("check", "<i8"), ("start", "<i4")])


def _signed(x: int, bits: int = 64) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def _digests(segment: bytes) -> tuple[int, int]:
    """128 bits that stand for a segment."""
    return _signed(xxhash.xxh64_intdigest(segment)), _signed(xxhash.xxh64_intdigest(segment, 1))


def _live(rows: pa.RecordBatch, texts: list[bytes], wanted: str):
    """Words and the windows whose anchor is in the list column ``wanted``."""
    words, starts, row, anchor = _anchors(texts)
    anchor = anchor.view(np.int64)
    live = np.isin(anchor, np.unique(rows.column(wanted).flatten().to_numpy(zero_copy_only=False)))
    return words, starts[live], row[live], anchor[live]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, body, live, hot) -> one row per different segment of a block, with all its places.

    A window of a hot anchor is a segment of its own and comes without places, but with its least
    and largest document.
    """
    for rows, texts in _blocks(batches):
        docs = rows.column("id").to_pylist()
        checks = [_signed(xxhash.xxh64_intdigest(t)) for t in texts]
        words, starts, row, anchor = _live(rows, texts, "live")
        if not len(starts):
            continue
        alone = np.isin(anchor, np.unique(rows.column("hot").flatten().to_numpy(zero_copy_only=False)))
        head = np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) | alone
        heads = np.flatnonzero(head)
        ends = np.concatenate((heads[1:], [len(starts)])) - 1
        found: dict[bytes, list] = {}
        segments, places = words.joined(starts[heads], starts[ends] + WINDOW), starts[heads] - words.first[row[heads]]
        for segment, a, r, key, single in zip(segments, places.tolist(), row[heads].tolist(), anchor[heads].tolist(), alone[heads].tolist()):
            at = found.get(segment)
            if at is None:
                route = _signed((_digests(segment)[0] if single else key) & 0xFFFFFFFF, 32)
                at = found[segment] = [route, docs[r], docs[r], None] if single else [route, None, None, b""]
            if single:
                at[1], at[2] = min(at[1], docs[r]), max(at[2], docs[r])
            else:
                at[3] += _PLACE.pack(docs[r], checks[r], a)
        lists = list(found.values())
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in lists], pa.int32()), pa.array(list(found), pa.binary()), pa.array([x[1] for x in lists], pa.int64()),
            pa.array([x[2] for x in lists], pa.int64()), pa.array([x[3] for x in lists], pa.binary()),
        ], ["route", "segment", "least", "most", "places"])


def _hot_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, body, hot) -> (one, two, d, check, start) of every window with a hot anchor."""
    for rows, texts in _blocks(batches):
        docs, checks = rows.column("id").to_pylist(), [_signed(xxhash.xxh64_intdigest(t)) for t in texts]
        words, starts, row, _ = _live(rows, texts, "hot")
        digests = [_digests(s) for s in words.joined(starts, starts + WINDOW)]
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in digests], pa.int64()), pa.array([x[1] for x in digests], pa.int64()), pa.array([docs[r] for r in row.tolist()], pa.int64()),
            pa.array([checks[r] for r in row.tolist()], pa.int64()), pa.array(starts - words.first[row], pa.int32()),
        ], ["one", "two", "d", "check", "start"])


_BELOW = np.array([(1 << k) - 1 for k in range(64)], dtype=np.uint64)


class WaveletTree:
    """Levelwise wavelet tree of a symbol array: packed bits and rank counts per level."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        current, n = symbols.astype(np.int32), len(symbols)
        for level in range(self.levels - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            packed = np.zeros(8 * (n // 64 + 1), dtype=np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            packed = packed.view("<u8")
            self.bits.append(packed)
            self.ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            current = np.concatenate((current[~bit], current[bit]))
        # where each symbol's run starts on the last level
        starts = np.zeros(alphabet, dtype=np.int32)
        kinds, at = np.unique(current, return_index=True)
        order = np.argsort(at)
        starts[kinds[order]] = at[order]
        self.starts = starts

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``place``, for arrays of both."""
        for k in range(self.levels):
            word = place >> 6
            ones = self.ranks[k][word] + np.bitwise_count(self.bits[k][word] & _BELOW[place & 63])
            up = (symbol & (1 << (self.levels - 1 - k))) != 0
            place = np.where(up, ones + self.zeros[k], place - ones)
        return place - self.starts[symbol]


class FMIndex:
    """FM-index over word sequences, each closed by a mark of its own.

    ``sequences`` must be different symbol lists with values from 1; marks sort before words and
    among each other by sequence, so suffix order and last-to-first mapping agree everywhere.
    """

    def __init__(self, text: np.ndarray, alphabet: int):
        n, marks = len(text), text == 0
        self.text, count = text, int(marks.sum())
        rank = np.where(marks, np.cumsum(marks) - 1, text + count)
        step = 1
        while True:
            after = np.full(n, -1, dtype=np.int64)
            after[: n - step] = rank[step:]
            key = rank * (n + alphabet + 2) + after + 1
            order = np.argsort(key)
            sorted_key = key[order]
            fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            step *= 2
        self.order = order
        self.symbols = text.astype(np.int32)
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet)))).astype(np.int32)
        self.tree = WaveletTree(text[order - 1], alphabet)

    def search(self, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the ``length`` words up to each place in ``ends``.

        Returns (which, low, high): the searches whose interval still held two suffixes or more
        at full length.  The others match nothing but themselves.
        """
        which = np.arange(len(ends))
        symbol = self.symbols[ends]
        low, high = self.counts[symbol], self.counts[symbol + 1]
        for back in range(1, length):
            more = high - low > 1
            which, low, high = which[more], low[more], high[more]
            if not len(which):
                break
            symbol = self.symbols[ends[which] - back]
            both = np.tile(self.counts[symbol], 2) + self.tree.rank(np.tile(symbol, 2), np.concatenate((low, high)))
            low, high = both[: len(which)], both[len(which):]
        more = high - low > 1
        return which[more], low[more], high[more]


class _Numbers(dict):
    """word -> number from 1 in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) + 1
        return found


def _first_documents(segments: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window of all segments, in order: the least document id among the segments that hold
    it; and where the windows of each segment begin (one entry more than segments)."""
    numbers = _Numbers()
    words = b" ".join(segments).split(b" ")
    lengths = np.fromiter((x.count(b" ") + 1 for x in segments), dtype=np.int64, count=len(segments))
    spelled = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    closes = np.cumsum(lengths + 1) - 1
    text = np.zeros(len(words) + len(segments), dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[closes] = False
    text[inside] = spelled
    index = FMIndex(text, len(numbers) + 1)
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    opens = closes - lengths
    windows = lengths - WINDOW + 1
    base = np.concatenate(([0], np.cumsum(windows)))
    ends = np.arange(base[-1]) + np.repeat(opens - base[:-1] + WINDOW - 1, windows)
    first = np.repeat(least, windows)
    which, low, high = index.search(ends, WINDOW)
    if len(which):
        kinds, back = np.unique(low, return_inverse=True)
        tops = np.empty(len(kinds), dtype=np.int64)
        tops[back] = high
        by_suffix = np.concatenate((least[owner[index.order]], [0]))
        cuts = np.stack((kinds, tops), axis=1).ravel()
        first[which] = np.minimum.reduceat(by_suffix, cuts)[::2][back]
    return first, base


def _hits_of(places: list[bytes], of: list[int], first: np.ndarray, base: np.ndarray) -> list[pa.Array]:
    """(d, check, windows): the windows of each place that start in an earlier document.

    ``places[k]`` are packed places of segment ``of[k]``.
    """
    at = np.frombuffer(b"".join(places), dtype=_PLACES)
    segment = np.repeat(np.array(of, dtype=np.int64), [len(x) // _PLACES.itemsize for x in places])
    number = (base[1:] - base[:-1])[segment]
    row = np.repeat(np.arange(len(at)), number)
    step = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    hit = first[base[segment[row]] + step] < at["doc"][row]
    row, step = row[hit], step[hit]
    doc, check, window = at["doc"][row], at["check"][row], at["start"][row] + step.astype(np.int32)
    order = np.lexsort((check, doc))
    doc, check, window = doc[order], check[order], window[order]
    heads = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (check[1:] != check[:-1])))) if len(doc) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.concatenate((heads, [len(doc)])), pa.int32())
    return [pa.array(doc[heads]), pa.array(check[heads]), pa.ListArray.from_arrays(offsets, pa.array(window, pa.int32()))]


_FOUND = "d long, check long, windows array<int>, one long, two long, first long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SEGMENTS`` sorted by route -> ``_FOUND``.

    Whole routes are gathered to about ``_INDEX_WORDS`` words; each such shard gets an index.
    A row is either a document (d, check) with windows that start in an earlier document, or a
    window (one, two) of a hot anchor with the first document that it starts in.
    """
    held: dict[bytes, list] = {}
    size, last = 0, None

    def report():
        segments, values = list(held), list(held.values())
        least, most = (np.array([v[k] or 0 for v in values], dtype=np.int64) for k in (0, 1))
        placed = np.array([v[2] is not None for v in values])
        if placed.any():  # the others know theirs
            held_in = np.frombuffer(b"".join(v[2] for v in values if v[2] is not None), dtype=_PLACES)["doc"]
            sizes = np.array([len(v[2]) // _PLACES.itemsize for v in values if v[2] is not None])
            least[placed] = np.minimum.reduceat(held_in, np.cumsum(sizes) - sizes)
            most[placed] = np.maximum.reduceat(held_in, np.cumsum(sizes) - sizes)
        first, base = _first_documents(segments, least)
        earlier = np.minimum.reduceat(first, base[:-1]) < most
        found = np.flatnonzero(earlier).tolist()
        hot = [(*_digests(segments[k]), int(first[base[k]])) for k in found if values[k][2] is None]
        of = [k for k in found if values[k][2] is not None]
        hits = _hits_of([values[k][2] for k in of], of, first, base)
        n, m = len(hits[0]), len(hot)
        none = [pa.nulls(m, x.type) for x in hits]
        return pa.RecordBatch.from_arrays([
            *[pa.concat_arrays([x, y]) for x, y in zip(hits, none)],
            *[pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([h[k] for h in hot], pa.int64())]) for k in range(3)],
        ], ["d", "check", "windows", "one", "two", "first"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("route", "segment", "least", "most", "places")]
        for route, segment, least, most, places in zip(*columns):
            if size > _INDEX_WORDS and route != last:
                yield report()
                held, size = {}, 0
            last = route
            at = held.get(segment)
            if at is None:
                held[segment] = [least, most, places]
                size += segment.count(b" ") + 2
            elif places is None:
                at[0], at[1] = min(at[0], least), max(at[1], most)
            else:
                at[2] += places
    if held:
        yield report()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``body`` and ``found`` (check, windows) -> the same with n_words, n_removed, kept_text in place of found."""
    for batch in batches:
        at = batch.schema.get_field_index("found")
        others = [k for k in range(batch.num_columns) if k != at]
        found = batch.column(at).to_pylist()
        n_words, n_removed, kept = [], [], []
        for text, marks in zip(batch.column("body").cast(pa.large_binary()).to_pylist(), found):
            words = (text or b"").split()
            n_words.append(len(words))
            gone = 0
            if marks:
                check, stay = _signed(xxhash.xxh64_intdigest(text)), np.ones(len(words), dtype=bool)
                for mark in marks:
                    if mark["check"] == check:
                        for start in mark["windows"]:
                            stay[start:start + WINDOW] = False
                gone = len(words) - int(stay.sum())
                words = [w for w, s in zip(words, stay.tolist()) if s] if gone else words
            n_removed.append(gone)
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(k) for k in others] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            [batch.schema.names[k] for k in others] + ["n_words", "n_removed", "kept_text"],
        )


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space)."""
    carried = [c for c in df.columns if c not in (id_col, text_col, "n_words", "n_removed", "kept_text")]
    renamed = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carried)])
    docs = renamed.where("id IS NOT NULL")  # both joins below read the same exchange of it
    pairs = docs.select("id", "body").mapInArrow(_pairs, "r long, anchor long, doc long, n long")
    shared = written(pairs.repartition("r").sortWithinPartitions("r").mapInArrow(_shared, "doc long, anchor long, n long"), release=True)
    total = shared.count()
    hot = shared.where(F.col("n") > max(HOT, total // 1_000_000)).select(F.col("anchor").alias("h")).distinct()  # a million at most
    marked = shared.join(F.broadcast(hot), F.col("anchor") == F.col("h"), "left")
    per_doc = marked.groupBy(F.col("doc").alias("d")).agg(F.collect_set("anchor").alias("live"), F.collect_set("h").alias("hot"))
    segments = docs.join(per_doc, F.col("id") == F.col("d")).select("id", "body", "live", "hot").mapInArrow(_segments, _SEGMENTS)
    # no more documents than HOT stand behind a row with places; the others meet in a join that can be split
    indexed = written(segments.repartition("route").sortWithinPartitions("route").mapInArrow(_index, _FOUND), release=True)
    hits = indexed.where("d IS NOT NULL").select("d", "check", "windows")
    reports = indexed.where("one IS NOT NULL").select(F.col("one").alias("o"), F.col("two").alias("t"), "first")
    hot_of = marked.where("h IS NOT NULL").groupBy(F.col("doc").alias("d")).agg(F.collect_set("h").alias("hot"))
    places = docs.join(hot_of, F.col("id") == F.col("d")).select("id", "body", "hot").mapInArrow(_hot_places, "one long, two long, d long, check long, start int")
    hot_hits = places.join(reports, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t"))).where("first < d")
    found = hits.unionAll(hot_hits.select("d", "check", F.array("start").alias("windows")))
    by_doc = found.groupBy("d").agg(F.collect_list(F.struct("check", "windows")).alias("found"))
    joined = docs.join(by_doc, F.col("id") == F.col("d"), "left").drop("d")
    nameless = renamed.where("id IS NULL").withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema]
    out = joined.unionByName(nameless).mapInArrow(_cut, ", ".join([*schema, "n_words long", "n_removed long", "kept_text string"]))
    return out.select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("body").alias(text_col),
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carried)], "n_words", "n_removed", "kept_text",
    )
