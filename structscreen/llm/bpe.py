"""BPE encoding and decoding by a tokenization automaton.

Compilation starts with the automaton of one state that reads any byte as an arc back to itself
and adds one merge gadget per merge (u, v), in rank order: the state that u-arcs lead to splits;
the new copy, which takes the u-arcs over, has no v-arc any more, and every state with a u-arc
gains a uv-arc to where the v-arc led.  All arcs of one label lead to one state, so a gadget adds
one state and one missing arc, and the automaton stays deterministic.  A token sequence is what
BPE yields for its string exactly if the automaton can read it.

The arcs are not spelled out (states times tokens).  The table keeps, per state, the arcs taken
away and when; an arc uv is there if the u-arc was when the gadget made it and it was not taken
away later.  ``Automaton.step`` answers from these tables and remembers the answer.

Every string has exactly one path.  Encoding follows it by table look-ups: from the state reached,
take the arc with the longest label that comes next; where no arc goes on, the place is closed and
the walk steps back.  Each prefix has one path too, so no place is entered twice and the walk is
linear in the word.  Decoding emits the labels' bytes.

Words come from the tokenizer's own pre-split pattern, special tokens are cut out before.  Each
task keeps a bounded memory of words already encoded.

Defined cases: null and empty texts have no tokens and decode to the empty text; ids outside the
vocabulary raise; equal rows get equal results; other columns are carried along.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pre-split of the vocabulary at hand (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers that the vocabulary's pre-split does not know as such (fixed values): code
#: points assigned after Unicode 16, which newer pattern libraries count as letters or numbers.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
REMEMBERED, REMEMBERED_CHARS = 200_000, 128  # words that a worker keeps, and the longest kept
_STEPS = 500_000
_TAKEN = 300_000
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def load_vocabulary(path: str) -> dict:
    """Merges, ids and special tokens of a tokenizer file: ``{"vocab", "merges", "special"}``, labels as bytes."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
    return {
        "vocab": {raw(t): k for t, k in data["model"]["vocab"].items() if t not in special},
        "merges": [(raw(a), raw(b)) for a, b in pairs],
        "special": special,
    }


class Automaton:
    """Deterministic tokenization automaton, compiled merge by merge."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        #: per token: where its arcs lead, the token before the last merge's right part, when it was made
        self.target = {bytes([b]): 0 for b in range(256)}
        self.left: dict[bytes, bytes | None] = {t: None for t in self.target}
        self.made = {t: -1 for t in self.target}
        #: per state: the state it was split from, and the arc it lost with that
        self.origin: list[int] = [-1]
        self.lost: list[tuple[bytes, int]] = [(b"", _NEVER)]
        self._taken: dict[int, dict[bytes, int]] = {}
        self._held = 0
        self._steps: dict[int, bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, u, v)
        # transition tables over token numbers, and the labels as a tree of bytes
        self.tokens = list(self.target)
        self._number = {t: k for k, t in enumerate(self.tokens)}
        self._to = [self.target[t] for t in self.tokens]
        self._length = [len(t) for t in self.tokens]
        self._tree: dict[int, int] = {}
        self._ends: list[int] = [-1]
        for token in self.tokens:
            node = 0
            for byte in token:
                key = node << 8 | byte
                following = self._tree.get(key)
                if following is None:
                    following = self._tree[key] = len(self._ends)
                    self._ends.append(-1)
                node = following
            self._ends[node] = self._number[token]

    def _gadget(self, rank: int, u: bytes, v: bytes) -> None:
        state = self.target.get(u)
        if state is None or v not in self.target or not self._has(state, v, self._chain(state)):
            return  # u is never followed by v: the merge cannot happen
        token = u + v
        if token in self.target:
            raise ValueError(f"two merges make {token!r}")
        self.target[token] = self.target[v]
        self.left[token], self.made[token] = u, rank
        self.origin.append(state)
        self.lost.append((v, rank))
        self.target[u] = len(self.origin) - 1
        if u == v:  # the copy took over u's own arcs before uu led anywhere else
            self.target[token] = state

    def taken(self, state: int) -> dict[bytes, int]:
        """Arcs missing at a state, with the time they went: its own loss and those of all it was split from."""
        found = self._taken.get(state)
        if found is None:
            found = self._chain(state)
            self._held += len(found)
            if self._held > _TAKEN:
                self._taken.clear()
                self._held = len(found)
            self._taken[state] = found
        return found

    def _chain(self, state: int) -> dict[bytes, int]:
        found: dict[bytes, int] = {}
        while state > 0:
            token, when = self.lost[state]
            found[token] = when
            state = self.origin[state]
        return found

    def _has(self, state: int, token: bytes, gone: dict[bytes, int]) -> bool:
        later = _NEVER
        while True:
            when = gone.get(token)
            if when is not None and when <= later:
                return False
            before = self.left[token]
            if before is None:
                return True
            later, token = self.made[token], before

    def step(self, state: int, number: int) -> bool:
        """Is there an arc with this token at this state?"""
        if len(self._steps) > _STEPS:
            self._steps.clear()
        found = self._steps[state << 20 | number] = self._has(state, self.tokens[number], self.taken(state))
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels (token numbers) of the one path that reads ``word``."""
        n, place, state = len(word), 0, 0
        path: list[int] = []
        trail: list[tuple[int, int, list[int]]] = []
        closed = bytearray(n + 1)  # places from which no path goes on
        tree, ends, steps, to, length = self._tree.get, self._ends, self._steps, self._to, self._length
        while place < n:
            node, at, open_arcs = 0, place, []
            while at < n:
                node = tree(node << 8 | word[at])
                if node is None:
                    break
                at += 1
                if ends[node] >= 0:
                    open_arcs.append(ends[node])
            while True:
                while open_arcs:
                    token = open_arcs.pop()
                    if not closed[place + length[token]]:
                        there = steps.get(state << 20 | token)
                        if self.step(state, token) if there is None else there:
                            break
                else:
                    closed[place] = 1
                    path.pop()
                    place, state, open_arcs = trail.pop()
                    continue
                trail.append((place, state, open_arcs))
                path.append(token)
                place, state = place + length[token], to[token]
                break
        return path


def _is_latin(text: str) -> bool:
    """No code point above 255 (found out at the speed of a copy)."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    """Automaton, pre-split and ids together."""

    def __init__(self, vocabulary: dict):
        self.automaton = Automaton(vocabulary["merges"])
        self.ids = {t: k for t, k in vocabulary["vocab"].items()}
        self.special = {t: k for t, k in vocabulary["special"].items()}
        self.labels = {k: t for t, k in self.ids.items()} | {k: t.encode() for t, k in self.special.items()}
        self._packed = [self.ids[t].to_bytes(4, "little") for t in self.automaton.tokens]
        newer = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
        exact = PATTERN.replace("[^\\s\\p{L}\\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{newer}])").replace(" ?\\p{L}+", f" ?(?:(?![{newer}])\\p{{L}})+")
        self._newer = regex.compile(f"[{newer}]").search
        self._split_old = regex.compile(PATTERN).findall
        self._split_new = regex.compile(exact.replace(" ?\\p{N}+", f" ?(?:(?![{newer}])\\p{{N}})+")).findall
        names = sorted(self.special, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else (lambda text: [text])
        outer = self

        class Memory(dict):
            def __missing__(self, word: str) -> bytes:
                found = b"".join(map(outer._packed.__getitem__, outer.automaton.encode(word.encode("utf-8"))))
                if len(word) <= REMEMBERED_CHARS:
                    if len(self) > REMEMBERED:
                        self.clear()
                    self[word] = found
                return found

        self._memory = Memory()

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for part in self._cut(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                split = self._split_old if _is_latin(part) or not self._newer(part) else self._split_new
                out += map(self._memory.__getitem__, split(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text that the labels of the ids spell."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The compiled codec of a vocabulary file, once per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(load_vocabulary(path))
    return _CODECS[path]


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of each text, packed as little-endian unsigned 32-bit integers.

    ``path`` is a vocabulary file that every executor has (part of an installed package, or shipped).
    """
    @F.pandas_udf("binary")
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in texts:
            yield pd.Series([own.encode(t) for t in batch], dtype=object)

    return df.withColumn(out, pack(F.col(text_col).cast("string")))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of packed token ids (null: empty)."""
    @F.pandas_udf("string")
    def spell(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in packed:
            yield pd.Series([own.decode(p) if p else "" for p in batch], dtype=object)

    return df.withColumn(out, spell(F.col(ids_col)))


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids``, ``n_tokens`` and ``decoded``; columns of these names are replaced.

    Both directions in one pass, so that a task holds one compiled automaton.
    """
    @F.pandas_udf("ids binary, decoded string")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in texts:
            ids = [own.encode(t) for t in batch]
            yield pd.DataFrame({"ids": ids, "decoded": [own.decode(i) for i in ids]}, dtype=object)

    kept = [c for c in df.columns if c not in ("ids", "n_tokens", "decoded")]
    return df.withColumn("_both", both(F.col(text_col).cast("string"))).select(
        *kept, F.col("_both.ids").alias("ids"), (F.octet_length("_both.ids") / 4).cast("long").alias("n_tokens"), F.col("_both.decoded").alias("decoded")
    )
