"""Phrase mining: word sequences that occur together more often than their parts suggest.

1. Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and into words at blanks and
   tabs.  Texts of one language are laid end to end into chunks, which number their words and are written once.
   Pieces are never cut, so no phrase is lost.
2. Word counts are summed across chunks.  Words below the least count become marks.  Chunks of a language are put
   together to shards of about ``SHARD_WORDS`` words, and each shard is compiled into two FM-indexes over word
   numbers, of the text and of the reversed text; suffixes are ordered to the depth of the longest phrase.  The indexes are
   written in buckets of shards, and so are the phrases that a shard holds of a level: no later step moves them.
3. Level by level, every phrase alive is extended to both sides: its interval of the one BWT holds
   the words before it, its interval of the other those behind it.  A longer phrase is reported
   where the two meet, that is, if both the phrase without its first and that without its last
   word are alive; the extensions keep the two intervals in step.  Counts are summed across shards, those
   below the least count die, and the next level starts from the intervals of those alive.

A phrase is known by the numbers of its prefix and suffix, so counting moves two longs and a count per phrase and some shards.
They are dealt by prefix to parts and travel packed, as do texts and indexes: columns byte by byte, compressed.  The phrases
alive are sent to the tasks if they are at most ``SENT_ROWS`` rows of ``SENT_BYTES`` bytes; else they are joined by exchange.

Defined cases: a null text is empty; a null language counts as ``und``, with rows of that name;
rows repeated count again; no other column is read; an empty table has no phrase.  Only a single
piece longer than a shard makes a shard larger than planned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structscreen.llm.common import shared_dir, written

SHARD_WORDS = 800_000
SENT_ROWS, SENT_BYTES = 500_000, 32 << 20
_CHUNK_WORDS, _OPEN_WORDS = 200_000, 600_000  # of one chunk; of all chunks that a task has begun
_SLICE = 1 << 22
_ROW = 1 << 16  # phrases in a row of a level's table
_SUMMED = 1 << 21  # phrases that are summed at once
_PART_SHARDS = 4  # shards to a part of the phrases that are summed
_SEPARATORS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte: all first bytes, all second bytes and so on, compressed."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    n, kinds = int.from_bytes(data[:8], "little"), [np.dtype(k) for k in kinds]
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * sum(k.itemsize for k in kinds)), dtype=np.uint8)
    starts = np.cumsum([0, *(n * k.itemsize for k in kinds)])
    return [np.ascontiguousarray(planes[a:b].reshape(k.itemsize, n).T).view(k).reshape(n) for k, a, b in zip(kinds, starts, starts[1:])]


class _Chunk(dict):
    """Word numbers from 1, in order of appearance (0: a mark), and the text so far."""

    def __init__(self):
        super().__init__({b".": 0})
        self.parts, self.size = [np.zeros(1, dtype=np.int32)], 0

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found

    def add(self, piece: bytes) -> int:
        words = piece.replace(b".", b" . ").split()
        self.parts.append(np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words)))
        self.size += len(words)
        return len(words)


_CHUNKS = "chunk long, lang string, n_words long, words array<binary>, counts array<long>, text binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, body) -> one row per chunk."""
    task, made = TaskContext.get().partitionId(), 0
    begun: dict[str, _Chunk] = {}

    def close(lang: str) -> pa.RecordBatch:
        nonlocal made
        chunk = begun.pop(lang)
        text = np.concatenate(chunk.parts)
        counts = np.bincount(text, minlength=len(chunk))[1:]
        made += 1
        row = {"chunk": (task << 32) + made, "lang": lang, "n_words": int(counts.sum()), "words": list(chunk)[1:], "counts": counts, "text": _packed(text)}
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            text = (text.as_py() or b"").lower().translate(_SEPARATORS)
            start = 0
            while start < len(text):
                end = text.find(b".", start + _SLICE) + 1 or len(text)
                chunk = begun.setdefault(lang, _Chunk())
                chunk.add(text[start:end] + b".")
                start = end
                if chunk.size >= _CHUNK_WORDS:
                    yield close(lang)
                elif sum(s.size for s in begun.values()) >= _OPEN_WORDS:
                    yield close(max(begun, key=lambda k: begun[k].size))
    for lang in list(begun):
        yield close(lang)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a circular text ordered by the ``depth`` symbols from there, by prefix doubling."""
    rank, width = text.astype(np.int64), 1
    order = np.zeros(0, dtype=np.int64)
    while width < depth:
        step = min(width, depth - width)
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(len(text), dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        width += step
    return order


class Bwt:
    """Burrows-Wheeler transform of a word text with its last-to-first mapping.

    ``last_to_first[i]`` is ``counts[c] + rank(c, i)`` for the symbol c in place i: where a backward step
    from the first c of an interval begins.
    """

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        self.last_to_first = np.empty(len(symbols), dtype=np.int32)
        self.last_to_first[np.argsort(symbols, kind="stable")] = np.arange(len(symbols), dtype=np.int32)

    @staticmethod
    def of(text: np.ndarray, depth: int) -> np.ndarray:
        return text[suffix_order(text, depth) - 1].astype(np.int32)

    def steps(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols in disjoint intervals: (owner, symbol, number, smaller ones in the interval, low after a backward step)."""
        starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(owner)) + np.repeat(low - starts, size)
        key = owner * (int(self.symbols.max(initial=0)) + 1) + self.symbols[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        number = np.diff(np.concatenate((heads, [len(key)])))
        first = order[heads]
        owner, place = owner[first], place[first]
        return owner, self.symbols[place], number, heads - starts[owner], self.last_to_first[place]


def extensions(forward: Bwt, backward: Bwt, low: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases one word longer than the given ones whose prefix and suffix are among them.

    ``low`` and ``back`` are where the intervals of ``size`` begin in the index of the text and of the
    reversed text.  Returns (prefix, suffix, count, low, back), prefix and suffix by place.
    """
    suffix, word, count, _, left_low = forward.steps(low, size)
    suffix, count, left_low = suffix[word > 0], count[word > 0], left_low[word > 0]
    prefix, word, _, before, right_back = backward.steps(back, size)
    # behind a phrase its suffixes are ordered by the next word
    prefix, right_low, right_back = prefix[word > 0], (low[prefix] + before)[word > 0], right_back[word > 0]
    meet, one, two = np.intersect1d(left_low, right_low, assume_unique=True, return_indices=True)
    return prefix[two], suffix[one], count[one], meet, right_back[two]


def _living(text: np.ndarray) -> np.ndarray:
    """The text without words alone between marks and with single marks."""
    here = text > 0
    text = np.where(here & (np.roll(here, 1) | np.roll(here, -1)), text, 0)
    return text[(text > 0) | (np.roll(text, 1) > 0)]


def _relabel(batches: Iterator[pa.RecordBatch], known: dict[str, dict[bytes, int]] | None) -> Iterator[pa.RecordBatch]:
    """(shard, lang, text, words or alive) -> (shard, grams, text): number ``k`` from 1 of a text is word ``grams[k - 1]``.

    ``known`` has the frequent words of each language, or the rows bring theirs in ``alive`` (number, gram).
    """
    for batch in batches:
        for row in range(batch.num_rows):
            text, = _unpacked(batch.column("text")[row].as_py(), np.int32)
            if known is None:
                listed = batch.column("alive")[row].values
                number, gram = (listed.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            else:
                of = known.get(batch.column("lang")[row].as_py(), {})
                found = [(k + 1, of[w]) for k, w in enumerate(batch.column("words")[row].as_py()) if w in of]
                number, gram = np.array(found, dtype=np.int64).reshape(-1, 2).T
            often = np.argsort(-np.bincount(text, minlength=int(number.max(initial=0)) + 1)[number], kind="stable")
            number, gram = number[often], gram[often]  # small numbers for frequent words pack better
            table = np.zeros(int(max(text.max(initial=0), number.max(initial=0))) + 1, dtype=np.int32)
            table[number] = np.arange(1, len(number) + 1)
            text = _living(table[text])
            if len(text):
                yield pa.RecordBatch.from_arrays([
                    batch.column("shard").slice(row, 1), pa.array([_packed(gram)], pa.binary()), pa.array([_packed(text)], pa.binary()),
                ], ["shard", "grams", "text"])


_RELABELLED = "shard string, grams binary, text binary"
_INDEX = "shard string, grams binary, forward binary, backward binary"


def _compile(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Chunks (shard, grams, text) of whole shards -> one index row per shard."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            grams, text = (_unpacked(batch.column(c)[row].as_py(), k)[0] for c, k in (("grams", np.int64), ("text", np.int32)))
            held.setdefault(batch.column("shard")[row].as_py(), []).append((grams, text))
    for shard in list(held):
        chunks = held.pop(shard)
        grams, place = np.unique(np.concatenate([g for g, _ in chunks]), return_inverse=True)
        starts = np.cumsum([0, *(len(g) for g, _ in chunks)])
        text = np.concatenate([np.concatenate(([0], place[a:b] + 1)).astype(np.int32)[t] for (_, t), a, b in zip(chunks, starts, starts[1:])])
        often = np.argsort(-np.bincount(text, minlength=len(grams) + 1)[1:], kind="stable")
        grams, number = grams[often], np.zeros(len(grams) + 1, dtype=np.int32)
        number[often + 1] = np.arange(1, len(grams) + 1)
        text = number[text]
        yield pa.RecordBatch.from_arrays([
            pa.array([shard]), *(pa.array([_packed(c)], pa.binary()) for c in (grams, Bwt.of(text, depth), Bwt.of(text[::-1], depth))),
        ], ["shard", "grams", "forward", "backward"])


_LIVING = "shard string, found binary"
_PARTS = {"prefix": np.int64, "suffix": np.int64, "n": np.int32, "low": np.int32, "back": np.int32}  # of ``found``, packed


class _Alive:
    """Phrases alive by (prefix, suffix), for look-ups by the array."""

    def __init__(self, rows: pa.Table):
        prefix, suffix, self.gram = (rows.column(c).to_numpy() for c in ("prefix", "suffix", "gram"))
        self.prefixes, one = np.unique(prefix, return_inverse=True)
        self.suffixes, two = np.unique(suffix, return_inverse=True)
        key = one * len(self.suffixes) + two
        order = np.argsort(key)
        self.key, self.gram = key[order], self.gram[order]

    def find(self, prefix: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, gram) of the pairs that are alive."""

        def at(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            return place, known[place] == asked

        if not len(self.key):
            return np.zeros(0, dtype=np.int64), self.gram
        one, fits = at(self.prefixes, prefix)
        two, too = at(self.suffixes, suffix)
        place, there = at(self.key, one * len(self.suffixes) + two)
        which = np.flatnonzero(fits & too & there)
        return which, self.gram[place[which]]


def _summed(prefix: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts of equal (prefix, suffix) added up, in order of both."""
    prefixes, one = np.unique(prefix, return_inverse=True)
    suffixes, two = np.unique(suffix, return_inverse=True)
    key = one * len(suffixes) + two
    order = np.argsort(key)
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(n[order], heads) if len(key) else n
    one, two = np.divmod(key[heads], max(1, len(suffixes)))
    return prefixes[one], suffixes[two], total


_COUNTED = (np.int64, np.int64, np.int64)  # prefix, suffix and count, packed


def _counted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """``_LIVING`` rows -> (part, counts): phrases of some shards, dealt by prefix."""
    held, size = [], 0

    def dealt() -> pa.RecordBatch:
        prefix, suffix, n = _summed(*(np.concatenate(c) for c in zip(*held)))
        part = (prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        numbers, heads = np.unique(part[order], return_index=True)
        packed = [_packed(prefix[at], suffix[at], n[at]) for at in np.split(order, heads[1:])]
        return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), pa.array(packed, pa.binary())], ["part", "counts"])

    for batch in batches:
        for found in batch.column("found").to_pylist():
            prefix, suffix, n = _unpacked(found, *_PARTS.values())[:3]
            held.append((prefix, suffix, n.astype(np.int64)))
            size += len(n)
            if size >= _SUMMED:
                yield dealt()
                held, size = [], 0
    if size:
        yield dealt()


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_counted`` sorted by part -> (prefix, suffix, f) of phrases with at least ``least`` occurrences."""
    held, size, last, due = [], 0, None, _SUMMED

    def report() -> pa.RecordBatch:
        prefix, suffix, f = _summed(*(np.concatenate(c) for c in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(c[f >= least]) for c in (prefix, suffix, f)], ["prefix", "suffix", "f"])

    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            if part != last and held:
                yield report()
                held, size, due = [], 0, _SUMMED
            last = part
            held.append(_unpacked(counts, *_COUNTED))
            size += len(held[-1][0])
            if size >= due:  # what is left of them may be as much again before they are summed anew
                held = [_summed(*(np.concatenate(c) for c in zip(*held)))]
                size = len(held[0][0])
                due = 2 * size + _SUMMED // 2
    if held:
        yield report()


_EACH = "shard string, prefix long, suffix long, n int, low int, back int"


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_LIVING`` rows -> a row per phrase."""
    for batch in batches:
        for shard, found in zip(batch.column("shard").to_pylist(), batch.column("found").to_pylist()):
            columns = _unpacked(found, *_PARTS.values())
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(columns[0]), pa.string()), *map(pa.array, columns)], ["shard", *_PARTS])


def _remain(rows: list[bytes], known: _Alive) -> list[np.ndarray]:
    """(gram, low, back, n) of the packed phrases that ``known`` has."""
    kept = []
    for found in rows:
        prefix, suffix, n, low, back = _unpacked(found, *_PARTS.values())
        which, gram = known.find(prefix, suffix)
        kept.append((gram, *(c[which].astype(np.int64) for c in (low, back, n))))
    return [np.concatenate(c) for c in zip(*kept)]


def _extend(batches: Iterator[pa.RecordBatch], known: _Alive | None = None) -> Iterator[pa.RecordBatch]:
    """Index rows -> ``_LIVING``: the phrases of each shard that are one word longer than those alive.

    On the first level these are all words; later those of the shard's rows ``found`` that ``known`` has, or those in
    the list ``alive`` (gram, low, back, n).
    """
    for batch in batches:
        for row in range(batch.num_rows):
            forward, backward = (Bwt(*_unpacked(batch.column(c)[row].as_py(), np.int32)) for c in ("forward", "backward"))
            if "grams" in batch.schema.names:
                gram, = _unpacked(batch.column("grams")[row].as_py(), np.int64)
                counts = np.bincount(forward.symbols, minlength=len(gram) + 1)
                size = counts[1:]
                low = back = np.cumsum(counts)[:-1]
            elif known is not None:
                gram, low, back, size = _remain(batch.column("found")[row].as_py(), known)
            else:
                alive = batch.column("alive")[row].values
                gram, low, back, size = (alive.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("gram", "low", "back", "n"))
            order = np.argsort(low)
            gram, low, back, size = gram[order], low[order], back[order], size[order]
            prefix, suffix, count, low, back = extensions(forward, backward, low, back, size)
            found = [c.astype(k) for c, k in zip((gram[prefix], gram[suffix], count, low, back), _PARTS.values())]
            for start in range(0, len(count), _ROW):
                rows = pa.array([_packed(*(v[start:start + _ROW] for v in found))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(row, 1), rows], ["shard", "found"])


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``df`` as a table of the shared folder in buckets of shards: joins by shard leave it where it is.

    Also its plain files, of which a task reads several.
    """
    spark, name, path = df.sparkSession, f"phrases_{uuid.uuid4().hex}", shared_dir(df.sparkSession)
    df.write.bucketBy(buckets, "shard").option("path", path).format("parquet").saveAsTable(name)
    found = spark.table(name)
    found.schema  # noqa: B018 - resolved, so the name can go; its files stay
    spark.sql(f"DROP TABLE {name}")
    return found, spark.read.schema(df.schema).parquet(path)


def _few(df: DataFrame, text: str | None = None) -> pa.Table | None:
    """The rows of a written table if they are few enough to be sent to every task."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text) if text else F.lit(0)).alias("bytes")).first()
    return df.toArrow() if size["n"] <= SENT_ROWS and (size["bytes"] or 0) <= SENT_BYTES else None


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, share: int = 100) -> DataFrame:
    """Phrases of 2 to ``longest`` words with at least ``least`` occurrences in their language.

    Columns: lang, phrase, words, a (occurrences), l and r (those of the two parts at the cut), cut (words before it), n (words
    of the language), score (``floor(1000 * a * n / (l * r))`` at the cut of the lowest score, of ties the first), extended
    (occurrences of the most frequent phrase that is one word longer, null if none is alive).  A phrase is dropped if ``100 *
    extended >= share * a``: a longer one stands for it.
    """
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("body"))
    chunks = written(docs.mapInArrow(_chunks, _CHUNKS), compression="zstd")
    sizes = written(chunks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    words = chunks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    alive = written(frequent.select(
        F.monotonically_increasing_id().alias("gram"), "lang", F.col("word").cast("string").alias("phrase"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"),
    ))
    spellings = alive.select("gram", "lang", F.col("phrase").cast("binary").alias("word"))
    # a shard is some chunks of one language that follow each other; only their sizes are ordered
    so_far = F.sum("n_words").over(Window.partitionBy("lang").orderBy("chunk"))
    groups = written(chunks.select(F.col("chunk").alias("of"), F.concat("lang", F.lit(":"), F.floor((so_far - 1) / SHARD_WORDS).cast("string")).alias("shard")))
    buckets = max(1, groups.select("shard").distinct().count())
    groups = F.broadcast(groups) if _few(groups, "shard") is not None else groups
    dealt = chunks.join(groups, F.col("chunk") == F.col("of")).select("chunk", "shard", "lang", "words", "text")
    few = _few(spellings, "word")
    if few is not None:
        known: dict[str, dict[bytes, int]] = {}
        for lang, word, gram in zip(*(few.column(c).to_pylist() for c in ("lang", "word", "gram"))):
            known.setdefault(lang, {})[word] = gram
        relabelled = dealt.drop("chunk").mapInArrow(lambda b: _relabel(b, known), _RELABELLED)
    else:
        at = dealt.select("chunk", F.col("lang").alias("of"), F.posexplode("words").alias("place", "w"))
        listed = at.join(spellings, (F.col("of") == F.col("lang")) & (F.col("w") == F.col("word"))).groupBy("chunk").agg(F.collect_list(F.struct(F.col("place") + 1, "gram")).alias("alive"))
        relabelled = dealt.drop("words").join(listed, "chunk").select("shard", "lang", "text", "alive").mapInArrow(lambda b: _relabel(b, None), _RELABELLED)
    gathered = relabelled.repartition(buckets, "shard")
    index, _ = _bucketed(gathered.mapInArrow(lambda b: _compile(b, longest), _INDEX), buckets)
    levels, states, known = [], index, None
    parts = max(1, buckets // _PART_SHARDS)
    for size in range(2, longest + 1):
        if size > 2:
            few = _few(alive.select("prefix", "suffix", "gram"))
            if few is not None:
                known = _Alive(few)
                listed = found.groupBy("shard").agg(F.collect_list("found").alias("found"))
            else:
                known = None
                remain = files.mapInArrow(_each, _EACH).join(alive.select("prefix", "suffix", "gram"), ["prefix", "suffix"])
                listed = remain.groupBy("shard").agg(F.collect_list(F.struct("gram", "low", "back", "n")).alias("alive"))
            states = index.drop("grams").join(listed, "shard")
        found, files = _bucketed(states.mapInArrow(lambda b, k=known: _extend(b, k), _LIVING), buckets)
        counted = files.mapInArrow(lambda b: _counted(b, parts), "part long, counts binary")
        sums = counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda b: _frequent(b, least), "prefix long, suffix long, f long")
        first = alive.select(F.col("gram").alias("prefix"), "lang", F.col("phrase").alias("start"), "heads")
        second = alive.select(F.col("gram").alias("suffix"), F.substring_index("phrase", " ", -1).alias("end"), "tails")
        alive = written(sums.join(first, "prefix").join(second, "suffix").select(
            F.monotonically_increasing_id().alias("gram"), "prefix", "suffix", "lang", F.concat("start", F.lit(" "), "end").alias("phrase"), "f",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
        ))
        levels.append(alive)
    kept = None
    for k, (level, longer) in enumerate(zip(levels, [*levels[1:], None])):
        level = level.withColumn("words", F.lit(k + 2))
        if longer is None:
            rows = level.withColumn("extended", F.lit(None).cast("long"))
        else:
            most = longer.select(F.explode(F.array("prefix", "suffix")).alias("gram"), "f").groupBy("gram").agg(F.max("f").alias("extended"))
            rows = level.join(most, "gram", "left").where(F.expr(f"extended IS NULL OR cast(100 AS decimal(3)) * extended < cast({share} AS decimal(3)) * f"))
        rows = rows.select("lang", "phrase", "words", "f", "heads", "tails", "extended")
        kept = rows if kept is None else kept.unionAll(rows)
    whole = "(cast(1000 AS decimal(4)) * cast(f AS decimal(19)) * cast(n AS decimal(19)))"
    cuts = F.expr(f"""array_min(transform(sequence(1, words - 1), k -> struct(
        {whole} div (cast(heads[k - 1] AS decimal(19)) * cast(tails[words - k - 1] AS decimal(19))) AS score, k AS cut, heads[k - 1] AS l, tails[words - k - 1] AS r)))""")
    return kept.join(sizes, "lang").withColumn("c", cuts).select("lang", "phrase", "words", F.col("f").alias("a"), "c.l", "c.r", "c.cut", "n", "c.score", "extended")


def ranked(found: DataFrame, first: int) -> DataFrame:
    """The ``first`` phrases of each language: score, then occurrences, both descending, then the phrase by its UTF-8 bytes."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).withColumn("rank", F.col("rank").cast("long"))
