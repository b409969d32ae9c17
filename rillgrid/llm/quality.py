"""Quality rules: a table of thresholds that becomes one projection.

Each rule names a measure of the text and the least and greatest value that passes.  Measures are
built-in expressions; the table is compiled into them and one boolean per text, without user
functions and without a shuffle.

Repeated three-word windows are found in the row: each window's hash is packed with its position
into one number, the numbers are sorted, and neighbours with equal hashes are confirmed on the words.

Edge cases: a null or empty text has no words, fails the base rules, and has 0 in all counts.
A null bound of a rule does not bind.  Ratios of a text without words are 0.  Rows are judged one by
one, so repeated rows give repeated results; existing columns of the same names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgrid.llm.common import SPACE, free, let, words_of

SYMBOLS = "#*$%&|<>"
BULLET, ELLIPSIS, LETTER = r"^ *[-*•]", r"(\.\.\.|…) *\z", r"\p{L}"
BLANKS = " \t\n\x0b\f\r"
# frequent function words of the languages of the corpus
STOP_WORDS = (
    "a", "and", "are", "as", "be", "by", "for", "have", "in", "is", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "avec", "dans", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "als", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "con", "de", "del", "el", "los", "no", "para", "por", "se", "su", "una", "y",
)

# measure, least, greatest: what a document of running text keeps to
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_length", 2, 15),
    ("symbol_word_ratio", None, 0.3),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
    ("alpha_word_ratio", 0.6, None),
    ("stop_word_ratio", 0.01, None),
)


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more."""

    def counted(w: Column) -> Column:
        n = F.size(w)
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        packed = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")),
            )
        )

        def covered(s: Column) -> Column:
            def place(x: Column) -> Column:
                return x.bitwiseAND(mask).cast("int")

            def same(x: Column, y: Column) -> Column:
                words_alike = let(place(x), lambda i: let(place(y), lambda j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))))
                return F.coalesce((x.bitwiseXOR(y) <= mask) & (x.bitwiseXOR(y) >= 0) & words_alike, F.lit(False))

            found = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(place(x), place(x) + 1, place(x) + 2)))))

        return F.when(n < 4, F.lit(0)).otherwise(let(packed, covered))

    return let(words, counted)


def measures(text: Column, words: Column, lines: Column, repeated: Column) -> dict[str, Column]:
    """The measures of a text, by its words, its lines with a word, and how many words are repeated."""
    body = F.coalesce(text, F.lit(""))
    per_word = F.when(F.size(words) > 0, F.size(words))
    per_line = F.when(F.size(lines) > 0, F.size(lines))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    word_chars = F.length(F.translate(body, BLANKS, ""))
    n_symbols = F.length(body) - F.length(F.translate(body, SYMBOLS, ""))
    return {
        "n_words": F.size(words),
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated,
        "mean_word_length": part(word_chars, per_word),
        "symbol_word_ratio": part(n_symbols, per_word),
        "dup_line_ratio": part(F.size(lines) - F.size(F.array_distinct(lines)), per_line),
        "repeat_word_ratio": part(repeated, per_word),
        "bullet_line_ratio": part(F.size(F.filter(lines, lambda x: x.rlike(BULLET))), per_line),
        "ellipsis_line_ratio": part(F.size(F.filter(lines, lambda x: x.rlike(ELLIPSIS))), per_line),
        "alpha_word_ratio": part(F.size(F.filter(words, lambda x: x.rlike(LETTER))), per_word),
        "stop_word_ratio": part(F.size(F.filter(words, lambda x: F.lower(F.translate(x, ",.;:!?", "")).isin(*STOP_WORDS))), per_word),
    }


def judged(docs: DataFrame, rules: tuple[tuple[str, float | None, float | None], ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``failed``, the names of the rules that a text does not meet."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    has_word = f"[^{SPACE}]"
    w, l, r = free(docs, "words_", "lines_", "repeated_")
    split = docs.withColumns({w: words_of(F.col(f"`{text}`")), l: F.filter(F.split(body, "\n"), lambda x: x.rlike(has_word))})
    found = measures(F.col(f"`{text}`"), F.col(w), F.col(l), F.col(r))
    known = split.withColumn(r, repeat_words(F.col(w))).withColumns(found)
    tests = []
    for name, least, greatest in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(name) < F.lit(float(least)))
        if greatest is not None:
            bad = bad | (F.col(name) > F.lit(float(greatest)))
        tests.append(F.when(bad, F.lit(name)))
    return known.withColumn("failed", F.array_compact(F.array(*tests))).drop(w, l, r)
