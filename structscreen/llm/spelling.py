"""Spelling variants: words one edit apart, by PartEnum signatures of their letter multisets.

1. Runs of letters are counted per task and summed; in every 31st pair of document and run, by checksum, one
   letter is deleted, so that a corpus without misspellings has some.
2. A word is a binary vector with one dimension per letter and its how-manyeth occurrence.  Replacing a letter
   moves two dimensions, an insertion or deletion one.  For a Hamming distance of k PartEnum deals the
   dimensions to ``n1 * n2`` blocks and signs, per first-level group, every choice of all but
   ``ceil((k + 1) / n1) - 1`` of its ``n2`` blocks: vectors within k agree on a signature.
3. An edit also leaves the front or the back half of a word as it is, so a signature is joined with a half and a
   length: words of one length under k = 2, a word and one longer by a letter under k = 1.  Words meet by
   an equi-join of these keys and are verified by their edit distance.
4. A key of more than ``HOT`` words is refined by the words' deletions: words one edit apart
   share one, and few words can.  No pair is lost and no group of any size is paired with itself.

The form of a word is its most frequent near word if that is ``FACTOR`` times as frequent; the root follows the
forms to the last.  As counts rise by ``FACTOR`` on the way, the number of doubling rounds is small.

Defined cases: a null or empty text has no runs; under a null id nothing is deleted; repeated rows count again; other columns
are not read; an empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structscreen.llm.common import written

LETTERS, EVERY, MIN_CHARS, MIN_COUNT, FACTOR = "A-Za-zÀ-ÿ", 31, 7, 2, 10
REPLACED = (2, 1, 4)  # k, n1, n2
LONGER = (1, 1, 3)
HOT = 256
_HELD_WORDS = 300_000
_SLICE = 1 << 22


def _slices(text: str) -> Iterator[str]:
    """Parts of a few million characters that cut no run of letters."""
    gap, start = re.compile(f"[^{LETTERS}]"), 0
    while start < len(text):
        cut = gap.search(text, start + _SLICE)
        end = cut.end() if cut else len(text)
        yield text[start:end] if start or cut else text
        start = end


def _count(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """(id, body) -> (word, n): counts of what a task has read, given out when they have grown large."""
    run = re.compile(f"[{LETTERS}]{{{min_chars},}}")
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return rows

    for batch in batches:
        for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            seed = None if doc is None else zlib.crc32(f"{doc}:".encode())
            for part in _slices((body.as_py() or b"").lower().decode("utf-8", "replace")):
                for word, n in Counter(run.findall(part)).items():
                    if seed is not None:
                        check = zlib.crc32(word.encode(), seed)
                        if check % EVERY == 0:
                            gone = check % len(word)
                            word = word[:gone] + word[gone + 1:]
                            if len(word) < min_chars:
                                continue
                    held[word] += n
            if len(held) > _HELD_WORDS:
                yield out()
    yield out()


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with the deletions, of at least ``min_chars`` code points and ``min_count`` occurrences."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    counts = docs.mapInArrow(lambda b: _count(b, min_chars), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(words: list[str], k: int, n1: int, n2: int) -> np.ndarray:
    """(words, signatures) PartEnum signatures of the letter multisets, each a hash of the dimensions it covers.

    Two words of Hamming distance k at most agree in some column.
    """
    letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    order = np.lexsort((letters, owner))
    letters, owner = letters[order], owner[order]
    place = np.arange(len(letters))
    fresh = np.ones(len(letters), dtype=bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
    dimension = _mix(_mix(letters.astype(np.uint64)) + nth.astype(np.uint64))
    block = (_mix(dimension) % np.uint64(n1 * n2)).astype(np.int64)
    covered = np.zeros((len(words), n1 * n2), dtype=np.uint64)
    np.add.at(covered, (owner, block), dimension)
    inner = -(-(k + 1) // n1) - 1
    return np.stack([covered[:, [i * n2 + b for b in chosen]].sum(axis=1) for i in range(n1) for chosen in combinations(range(n2), n2 - inner)], axis=1)


def _halves(words: list[str], length: list[int], tag: int) -> np.ndarray:
    """(words, 2) hashes of the front and back half of a word taken as one of ``length`` letters."""
    seed = xxhash.xxh64_intdigest
    found = []
    for word, n in zip(words, length):
        half = n // 2
        found.append((seed(f"{n} {word[:half]}".encode(), 2 * tag), seed(f"{n} {word[len(word) - n + half:]}".encode(), 2 * tag + 1)))
    return np.array(found, dtype=np.uint64).reshape(-1, 2)


def _columns() -> tuple[int, int]:
    counts = [signatures(["a"], *s).shape[1] for s in (REPLACED, LONGER)]
    return 2 * counts[0], 2 * counts[1]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (word, n, keys): first the keys among words of one length, then as the shorter, then as the longer one."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        parts = []
        for scheme, tag, less in ((REPLACED, 0, 0), (LONGER, 1, 0), (LONGER, 1, 1)):
            signs = signatures(words, *scheme) + np.arange(signatures(["a"], *scheme).shape[1], dtype=np.uint64)
            halves = _halves(words, [len(w) - less for w in words], tag)
            parts.append(_mix(_mix(signs)[:, :, None] + halves[:, None, :]).reshape(len(words), -1))
        keys = np.concatenate(parts, axis=1).view(np.int64)
        offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], ["word", "n", "keys"])


def near_words(words: DataFrame) -> DataFrame:
    """(one, one_n, two, two_n): every pair of words that differ by one inserted, deleted or replaced code point, once."""
    same, apart = _columns()
    role = F.when(F.col("k") < same, 0).when(F.col("k") < same + apart, 1).otherwise(2)
    rows = words.select("word", "n").mapInArrow(_keys, "word string, n long, keys array<long>").select("word", "n", F.posexplode("keys").alias("k", "key")).select("key", "word", "n", role.alias("role"))
    crowded = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HOT).select(F.col("key").alias("hot")))
    marked = rows.join(crowded, F.col("key") == F.col("hot"), "left")
    shorter = F.expr("transform(sequence(1, char_length(word)), i -> concat(substr(word, 1, i - 1), substr(word, i + 1)))")
    told = F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(None).cast("string"))).when(F.col("role") == 1, F.array("word")).otherwise(F.array_distinct(shorter)))
    dealt = marked.select("key", "role", "word", "n", told.alias("left_over")).select(F.when(F.col("left_over").isNull(), F.col("key")).otherwise(F.xxhash64("key", "left_over")).alias("key"), "role", "word", "n")
    one = dealt.where("role < 2").select("key", F.col("word").alias("one"), F.col("n").alias("one_n"), F.col("role").alias("one_role"))
    two = dealt.where("role <> 1").select(F.col("key").alias("k"), F.col("word").alias("two"), F.col("n").alias("two_n"), F.col("role").alias("two_role"))
    met = (F.col("key") == F.col("k")) & F.expr("CASE WHEN one_role = 0 THEN two_role = 0 AND one < two ELSE two_role = 2 END")
    return one.join(two, met).where(F.levenshtein("one", "two", 1) == 1).select("one", "one_n", "two", "two_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far in every round."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        now = written(now.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n) -> (word, n, n_near, form, form_n, root); words must be different.

    ``form`` is the near word of largest n (of ties the smallest) if that is at least ``factor`` times the word's own, else null.
    """
    words = written(words.select("word", "n"))
    pairs = written(near_words(words))
    both = pairs.unionAll(pairs.select("two", "two_n", "one", "one_n")).toDF("word", "n", "near", "near_n")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rest"), "near")).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.rest")).alias("form_n"))
    fits = F.col("form_n") >= factor * F.col("n")
    told = written(known.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    roots = _roots(told.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return told.join(roots, F.col("word") == F.col("w"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
