"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every statistic is an expression over one row, so the operator needs no shuffle at any size: a
scan, a projection, the output. Words are runs of `[^\\x20\\x09-\\x0D]`.

Repeated three-word windows are found by sorting: each window becomes one long, its hash above its
position, and `sort_array` on a non-null array of longs is a primitive sort. Equal windows then
stand side by side; their words are compared, so equal hashes of unequal windows do not count.

Defined cases: a null or empty text has no words, and so fails the base rule on length; repeated
rows each get a row; a null doc_id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Common function words of the languages in the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "with", "be", "on", "by",
    "this", "are", "as", "at", "from", "or", "an",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "dans",
    "qui", "par", "sur", "au",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist",
    "im", "dem", "nicht", "ein", "eine", "als",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "es", "lo",
)

SYMBOLS = "#*$%&|<>"

#: The white-space characters besides the plain blank.
OTHER_SPACES = "\t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """Rejects a row where `value` is outside [low, high]; either bound may be absent."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: The method's own rules; each value is an SQL expression over the statistics below.
RULES = (
    Rule("mean_word_length", "mean_word_length", low=2.0, high=12.0),
    Rule("symbol_ratio", "symbol_ratio", high=0.10),
    Rule("stop_word_ratio", "stop_word_ratio", low=0.01),
    Rule("dup_line_ratio", "dup_line_ratio", high=0.50),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body) -> Column:
    """Evaluates value once and gives it to body as a lambda variable, so nothing is recomputed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str, put: str = "") -> Column:
    """text with each of these characters replaced; byte-wise, which is far cheaper than a pattern."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(put)), characters, text)


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that stands twice or more in the text."""
    big = lambda x: F.lit(x).cast("bigint")

    def same_window(w: Column, i: Column, j: Column) -> Column:
        return reduce(lambda x, y: x & y, (F.get(w, i + k) == F.get(w, j + k) for k in range(3)))

    def covered(starts: Column) -> Column:
        """Words covered by windows at these ascending starts."""
        return F.aggregate(
            starts,
            F.struct(big(-3).alias("last"), big(0).alias("n")),
            lambda acc, s: F.struct(s.cast("bigint").alias("last"), (acc["n"] + F.least(big(3), s.cast("bigint") - acc["last"])).alias("n")),
        )["n"]

    def count(w: Column) -> Column:
        n = F.size(w)
        # As many low bits as positions need; the rest of the 64 bits hold the window's hash.
        mask_of = F.call_function("shiftleft", big(1), F.length(F.bin(n.cast("bigint")))) - big(1)

        def with_mask(mask: Column) -> Column:
            keys = F.transform(
                F.slice(w, 1, n - 2),
                lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2))
                .bitwiseOR(mask)
                .bitwiseXOR(mask)
                .bitwiseOR(i.cast("bigint")),
            )

            def twin(a: Column, b: Column) -> Column:
                both = F.call_function("shiftleft", a.bitwiseAND(mask), F.lit(32)).bitwiseOR(b.bitwiseAND(mask))
                return F.when(a.bitwiseOR(mask) == b.bitwiseOR(mask), both)

            def starts(pair: Column) -> Column:
                a = F.call_function("shiftright", pair, F.lit(32)).cast("int")
                b = pair.bitwiseAND(big(0xFFFFFFFF)).cast("int")
                return F.when(same_window(w, a, b), F.array(a, b)).otherwise(F.array().cast("array<int>"))

            def with_sorted(s: Column) -> Column:
                twins = F.array_compact(F.zip_with(s, F.slice(s, 2, n), twin))
                return covered(F.sort_array(F.array_distinct(F.flatten(F.transform(twins, starts)))))

            return let(F.sort_array(keys), with_sorted)

        return F.when(n < 4, big(0)).otherwise(let(mask_of, with_mask))

    return let(words, count)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the statistics that the rules refer to; one row for each row of docs."""
    base = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = base.select("doc_id", "_text", without(F.col("_text"), OTHER_SPACES, " ").alias("_blank"))
    base = base.select(
        "doc_id",
        F.length("_text").alias("_chars"),
        F.length(without(F.col("_blank"), " ")).cast("bigint").alias("word_chars"),
        F.length(without(F.col("_text"), SYMBOLS)).alias("_plain"),
        F.array_remove(F.split("_blank", " "), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    stop = [form for word in STOP_WORDS for form in (word, word.capitalize())]
    n_stop = F.size(F.filter("_words", lambda w: w.isin(*dict.fromkeys(stop))))
    stats = base.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        "word_chars",
        (F.col("_chars") - F.col("_plain")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        n_stop.cast("bigint").alias("n_stop_words"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return stats.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, as one array expression."""

    def broken(rule: Rule) -> Column:
        value = F.expr(rule.value)
        tests = [value < rule.low] if rule.low is not None else []
        tests += [value > rule.high] if rule.high is not None else []
        return F.when(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(rule.name))

    return F.array_compact(F.array(*(broken(r) for r in rules)))


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    text: str = "text",
) -> DataFrame:
    """The statistics of each document, whether it fails the base rules, and the verdict `kept`."""
    stats = statistics(docs, text)
    base_failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent
    )
    return stats.select("*", base_failed.alias("base_failed"), compile_rules(rules).alias("_broken")).select(
        "*",
        ((~F.col("base_failed")) & (F.size("_broken") == 0)).alias("kept"),
        F.array_join("_broken", ",").alias("broken_rules"),
    ).drop("_broken")
