"""Sequence, code and identifier expressions."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structscreen import constants as k


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(d.items())])


# ---------------------------------------------------------------- alphabet / tokens
def vocabulary() -> list[str]:
    """Symbols in index order: leading specials, residues, padding names, trailing."""
    symbols = list(k.LEADING_TOKENS) + list(k.RESIDUE_TOKENS)
    missing = -len(symbols) % k.VOCAB_MULTIPLE
    return symbols + [f"<null_{i + 1}>" for i in range(missing)] + list(k.TRAILING_TOKENS)


def split_symbols(text: Column) -> Column:
    """Known angle-bracket symbols stay whole, every other visible character is one symbol."""
    return F.regexp_extract_all(text, F.lit(f"({_symbol_pattern()})"), F.lit(1))


def _symbol_pattern() -> str:
    return "|".join([*[re.escape(t) for t in vocabulary() if len(t) > 1], r"\S"])


def token_ids(
    text: Column, *, truncate: int | None = None, bos=True, eos=True, on_unknown="error"
) -> Column:
    """Vocabulary indices of a sequence; truncation happens before BOS/EOS are added.

    Sequences run to tens of thousands of symbols, so the lookup works on whole Arrow
    batches with a byte table; texts with bracketed symbols are split first.
    """
    index = {s: i for i, s in enumerate(vocabulary())}
    unknown = index["<unk>"]
    table = np.full(256, -1, dtype=np.int32)
    for symbol, i in index.items():
        if len(symbol) == 1:
            table[ord(symbol)] = i
    blank = np.zeros(256, dtype=bool)
    blank[[ord(c) for c in " \t\n\r\f\v"]] = True
    pattern = re.compile(_symbol_pattern())
    head = np.array([index["<cls>"]] if bos else [], dtype=np.int32)
    tail = np.array([index["<eos>"]] if eos else [], dtype=np.int32)

    def encode(sequence: str) -> np.ndarray:
        if "<" not in sequence and sequence.isascii():
            raw = np.frombuffer(sequence.encode(), dtype=np.uint8)
            ids = table[raw[~blank[raw]]]
        else:
            ids = np.array([index.get(s, -1) for s in pattern.findall(sequence)], dtype=np.int32)
        if (ids < 0).any():
            if on_unknown != "unk":
                raise ValueError("symbol outside the vocabulary")
            ids = np.where(ids < 0, unknown, ids).astype(np.int32)
        return np.concatenate([head, ids[:truncate], tail])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode_batch(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else encode(t) for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.int32()))

    return encode_batch(text)


def pad_ids(ids: Column, width: Column) -> Column:
    pad = vocabulary().index("<pad>")
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def strip_insertions(seq: Column) -> Column:
    """Drop lower-case insertions and the '.' and '*' fillers of an alignment row."""
    return F.regexp_replace(seq, r"[a-z.*]", "")


def msa_view(seq: Column, keep_gaps=True, keep_insertions=True, to_upper=False) -> Column:
    if not keep_gaps:
        seq = F.regexp_replace(seq, "-", "")
    if not keep_insertions:
        seq = F.regexp_replace(seq, "[a-z]", "")
    return F.upper(seq) if to_upper else seq


# ---------------------------------------------------------------- residue codes
def one_letter(resname: Column, unknown: str = "dash", extra: bool = True) -> Column:
    """Three-letter to one-letter code; unknown is 'dash', 'error' or 'null'."""
    table = {**k.THREE_TO_ONE, **(k.THREE_TO_ONE_EXTRA if extra else {})}
    code = F.try_element_at(literal_map(table), resname)
    if unknown == "dash":
        return F.coalesce(code, F.lit("-"))
    if unknown == "error":
        return F.coalesce(code, F.raise_error(F.concat(F.lit("unknown residue "), resname)).cast("string"))
    return code


def vocab_index(value: Column, vocab: list[str]) -> Column:
    """Position in the vocabulary; anything absent gets the last position."""
    words = F.array(*[F.lit(w) for w in vocab])
    found = F.array_position(words, F.coalesce(value, F.lit(""))).cast("int")
    return F.when(found == 0, F.lit(len(vocab) - 1)).otherwise(found - 1)


def atom_codes(resname: Column, element: Column, atom_name: Column) -> Column:
    """(residue, atomic number, two-letter class, full name) codes of an atom."""
    symbol = F.when(element == "CD", F.lit("C")).otherwise(F.upper(element))
    number = F.try_element_at(literal_map(k.ATOMIC_NUMBER), symbol)
    return F.struct(
        vocab_index(resname, k.RESIDUE_VOCAB).alias("residue"),
        F.coalesce(number - 1, F.lit(k.MAX_ATOMIC_NUMBER)).alias("element"),
        vocab_index(F.substring(F.concat(atom_name, F.lit("*")), 1, 2), k.ATOM_CLASS_VOCAB).alias("atom_class"),
        vocab_index(atom_name, k.ATOM_NAME_VOCAB).alias("atom_name"),
    )


def one_hot(value: Column, categories) -> Column:
    return F.array(*[F.when(value == c, 1).otherwise(0) for c in categories])


# ---------------------------------------------------------------- ids and annotations
def residue_uid(chain: Column, resid: Column, insertion: Column) -> Column:
    return F.concat_ws("_", chain, resid.cast("string"), insertion)


def atom_uid(atom_name: Column, altloc: Column) -> Column:
    return F.concat_ws("_", atom_name, altloc)


def longest_fragment(smiles: Column) -> Column:
    """Longest dot-separated part, the first of equals; '' for missing input."""
    parts = F.split(F.coalesce(smiles, F.lit("")), r"\.")
    return F.aggregate(
        parts, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best)
    )


def fold_class(text: Column) -> Column:
    return F.regexp_extract(text, r"Gene3D; ([.\d]*);", 1)


def enzyme_class(text: Column) -> Column:
    return F.regexp_extract(text, r"EC=([.\d-]*)", 1)


# ---------------------------------------------------------------- reproducible draws
DRAW_MODULUS = 2147483647
DRAW_FACTOR = 1103515245


def draw(seed: int, *keys: Column) -> Column:
    """Pseudo-random long in [0, 2^31-1) from integer keys; the same on any engine."""
    h = F.lit(seed % DRAW_MODULUS).cast("long")
    for key in keys:
        h = F.pmod(h * F.lit(DRAW_FACTOR) + F.pmod(key.cast("long"), F.lit(DRAW_MODULUS)), F.lit(DRAW_MODULUS))
    return h
