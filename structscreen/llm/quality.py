"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row ``(name, measure, least, most)``.  ``measures`` holds the expression of
each measure (lengths, symbol, stop-word and line ratios); ``compile_rules`` turns the table
into Boolean columns of the same projection.  Only DataFrame functions are used; a row is
judged where it lies, so there is no shuffle and nothing that grows with the table.

The stop-word rule is open for languages that the list does not cover, if a language column is named; a null language is judged.

Defined cases: a null or empty text has no words and fails the base rule; ratios over zero
words or lines are 0; a measure never is null, so a rule never is null; equal rows get equal
verdicts; other columns are carried along, and the working columns have a prefix of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structscreen.llm.common import WORD_BREAKS, word_array

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages at hand (fixed values, lower case).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are",
    "or", "his", "from", "at", "which", "but", "have", "an", "had", "they",
    "der", "die", "das", "und", "ist", "von", "zu", "den", "mit", "sich", "des", "auf", "für", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "de", "et", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "plus", "au",
    "el", "los", "las", "y", "que", "del", "se", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o",
)

#: Languages of the list above.
STOP_LANGUAGES = ("en", "de", "fr", "es")

#: (rule, measure, least allowed, most allowed); None leaves a side open.
RULES = (
    ("mean_word_length", "mean_word_chars", 1.5, 25.0),
    ("symbols_per_word", "symbol_ratio", None, 0.20),
    ("shouts_per_word", "shout_ratio", None, 0.30),
    ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.50),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it as often as ``body`` likes.

    Inside a lambda an outer expression is evaluated per element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words lying in 3-word windows that the array holds twice or more (every word once).

    First pass: 33 bits of each window's hash and its position in one long; sorted, equal
    hashes are neighbours, and windows without such a neighbour are single.  Second pass: only
    the windows left are compared by their words.  Positions in order then give the covered
    length.  n log n in the text, inside the row.
    """
    def packed(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 31).bitwiseOR(i.cast("long")),
        )

    def alike(s):
        top = lambda x: F.shiftright(x, 31)
        return F.filter(s, lambda x, i: (top(x) == top(F.get(s, i + 1))) | (top(x) == top(F.get(s, i - 1))))

    def named(w, s):
        place = lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        return F.transform(s, lambda x: F.struct(
            F.concat_ws(" ", F.get(w, place(x)), F.get(w, place(x) + 1), F.get(w, place(x) + 2)).alias("k"), place(x).alias("p")))

    def repeated(s):
        return F.transform(
            F.filter(s, lambda x, i: F.coalesce((x["k"] == F.get(s, i - 1)["k"]) | (x["k"] == F.get(s, i + 1)["k"]), x["k"] == F.get(s, i - 1)["k"], x["k"] == F.get(s, i + 1)["k"])),
            lambda x: x["p"],
        )

    def covered(p):
        steps = F.zip_with(F.slice(p, 2, F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda n, x: n + x))

    def exact(w, s):
        return F.when(F.size(s) == 0, F.lit(0)).otherwise(
            _bind(F.sort_array(named(w, s)), lambda k: _bind(F.sort_array(repeated(k)), covered)))

    found = _bind(words, lambda w: _bind(F.sort_array(packed(w)), lambda s: _bind(alike(s), lambda t: exact(w, t))))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(found).cast("long")


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts that the rules need, with the prefix ``_q_``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.char_length(F.translate(line, WORD_BREAKS, "")) > 0)
    with_arrays = df.withColumns({"_q_words": word_array(F.col(text_col).cast("string")), "_q_lines": lines})
    words = F.col("_q_words")
    return with_arrays.withColumns({
        "_q_n_words": F.size(words).cast("long"),
        "_q_word_chars": F.char_length(F.translate(text, WORD_BREAKS, "")).cast("long"),
        "_q_n_symbols": _count(text, SYMBOLS).cast("long"),
        "_q_n_shouts": _count(text, "!").cast("long"),
        "_q_n_lines": F.size("_q_lines").cast("long"),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_n_stop": F.size(F.filter(word_array(F.lower(text)), lambda w: w.isin(*STOP_WORDS))).cast("long"),
        "_q_n_repeat_words": repeated_words(words),
    }).drop("_q_words", "_q_lines")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def measures() -> dict[str, Column]:
    return {
        "mean_word_chars": _ratio("_q_word_chars", "_q_n_words"),
        "symbol_ratio": _ratio("_q_n_symbols", "_q_n_words"),
        "shout_ratio": _ratio("_q_n_shouts", "_q_n_words"),
        "stop_ratio": _ratio("_q_n_stop", "_q_n_words"),
        "dup_line_ratio": _ratio("_q_n_dup_lines", "_q_n_lines"),
    }


def compile_rules(rules=RULES, lang_col: str | None = None) -> dict[str, Column]:
    """Rule name -> Boolean column (true: the row fails)."""
    covered = F.lower(F.col(lang_col).cast("string")).isin(*STOP_LANGUAGES) if lang_col else None
    known, out = measures(), {}
    for name, measure, least, most in rules:
        fails = [known[measure] < least] if least is not None else []
        fails += [known[measure] > most] if most is not None else []
        out[name] = reduce(lambda a, b: a | b, fails, F.lit(False))
        if measure == "stop_ratio" and covered is not None:
            out[name] = out[name] & F.coalesce(covered, F.lit(True))
    return out


def judge(df: DataFrame, text_col: str = "text", rules=RULES, lang_col: str | None = None) -> DataFrame:
    """``df`` with ``n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept failed_rules``.

    ``failed_rules`` names the rules of the table that the row fails.  Columns of ``df`` with
    one of these names are replaced.
    """
    compiled = compile_rules(rules, lang_col)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))
    failed = F.filter(F.array(*[F.when(fails, F.lit(name)) for name, fails in compiled.items()]), lambda x: x.isNotNull())
    taken = {*added, "base_failed", "kept", "failed_rules"}
    return counts(df, text_col).select(
        *[F.col(c) for c in df.columns if c not in taken], *[F.col("_q_" + c).alias(c) for c in added],
        base.alias("base_failed"), failed.alias("failed_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(df: DataFrame, text_col: str = "text", rules=RULES, lang_col: str | None = None) -> DataFrame:
    """Rows that pass, with the columns of ``df``."""
    base = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n_words"))
    bad = reduce(lambda a, b: a | b, compile_rules(rules, lang_col).values(), base)
    return counts(df, text_col).where(~bad).select(*[F.col(c) for c in df.columns])
