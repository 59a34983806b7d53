"""Quality rules: counts of a text and a threshold table, as one Spark projection without user functions.

A word is a run of characters other than space and the controls 9 to 13.  Repeated eight-word windows are found by
hashing every window of the row and sorting the hashes, only in rows where some hash occurs twice; two windows count as
equal if two independent hashes are.  Nothing is exploded, joined or shuffled: a text of any length is one row.

An expression used inside a lambda is handed to it as the one element of an array (``_let``): the optimizer would
otherwise copy it into the lambda and work it out again for every element.

Cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows get equal results; null ids
pass through; columns other than doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"\x20\x09-\x0D"
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Frequent function words of the four languages of the corpus, in natural order.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "at", "this", "by",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "est", "pour", "dans", "par", "pas", "sur",
    "der", "die", "das", "den", "dem", "und", "zu", "ein", "eine", "mit", "von", "ist", "nicht", "sich", "auf", "für",
    "el", "los", "las", "y", "se", "del", "con", "no", "al", "por", "para", "una",
)


@dataclass(frozen=True)
class Rule:
    """``least <= numerator / denominator <= most``; a ratio over zero is zero."""

    name: str
    numerator: str
    denominator: str
    least: float = float("-inf")
    most: float = float("inf")


#: The method's verdict: every ratio within its bounds.
THRESHOLDS = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols to words", "n_symbols", "n_words", most=0.5),
    Rule("stop words to words", "n_stop_words", "n_words", 0.02),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("words equal to the one before", "n_same_as_last", "n_words", most=0.2),
    Rule("shouted words to words", "n_shouted", "n_words", most=0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _repeated(rows: Column) -> Column:
    """Words covered by windows that occur twice or more; ``rows`` are sorted (hash, hash, position) of all windows."""
    def equal(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (a["g"] == b["g"])

    def marked(s: Column) -> Column:
        last = F.size(s) - 1
        return F.filter(s, lambda x, i: F.when(i > 0, equal(F.get(s, i - 1), x)).otherwise(False)
                        | F.when(i < last, equal(F.get(s, i + 1), x)).otherwise(False))

    def covered(at: Column) -> Column:
        """Each window adds what the next one does not start within."""
        following = F.concat(F.slice(at, 2, F.size(at)), F.array(F.element_at(at, -1) + WINDOW_WORDS))
        gaps = F.zip_with(at, following, lambda a, b: F.least(b - a, F.lit(WINDOW_WORDS)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    positions = F.sort_array(F.transform(_let(rows, marked), lambda x: x["at"]))
    return _let(positions, lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(F.lit(0).cast("long")))


def counts(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, the counts of the text and ``base_failed``; each helper column is one projection."""
    first = documents.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    words = first.select(
        *keep, "_text",
        F.filter(F.split("_text", f"[{SPACE}]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("_lines"),
    )
    n = F.size("_words")
    hashed = words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))

    def window(hash_of: Callable[..., Column], i: Column) -> Column:
        """The hash of the window from place ``i``; single elements are read, a slice would copy the whole array."""
        return hash_of(*[F.get("_hashes", i + k) for k in range(WINDOW_WORDS)])

    windows = hashed.withColumn("_windows", F.when(n > WINDOW_WORDS, F.transform(
        F.sequence(F.lit(0), n - WINDOW_WORDS), lambda i: window(F.xxhash64, i),
    )).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    keyed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(
        h.alias("h"), window(F.hash, i).alias("g"), i.cast("long").alias("at"))))
    low = F.transform("_words", lambda w: F.lower(w))
    counted = windows.select(
        *keep,
        # an expression that is not deterministic keeps filters above this projection: pushed below it, they would
        # work out the counts anew for every use
        F.when(F.monotonically_increasing_id() >= 0, n.cast("long")).alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(twice, _repeated(keyed)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter(low, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(F.zip_with("_words", F.slice("_words", 2, n), lambda a, b: a == b), lambda same: same)).cast(
            "long").alias("n_same_as_last"),
        F.size(F.filter("_words", lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))).cast(
            "long").alias("n_shouted"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def verdict(thresholds: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over the counts."""
    passed = F.lit(True)
    for rule in thresholds:
        ratio = F.when(F.col(rule.denominator) > 0, F.col(rule.numerator) / F.col(rule.denominator)).otherwise(0.0)
        if rule.least > float("-inf"):
            passed = passed & (ratio >= rule.least)
        if rule.most < float("inf"):
            passed = passed & (ratio <= rule.most)
    return passed


def judged(documents: DataFrame, thresholds: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Every row's doc_id, counts, ``base_failed`` and ``kept``."""
    return counts(documents, ["doc_id"]).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def kept(documents: DataFrame, thresholds: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of ``documents`` that pass, all columns as they were; they travel under numbers, so no name can clash."""
    numbered = [f"_column_{i}" for i in range(len(documents.columns))]
    renamed = documents.toDF(*numbered)
    text = numbered[documents.columns.index("text")]
    passed = counts(renamed, numbered, text).where(~F.col("base_failed") & verdict(thresholds))
    return passed.select(*numbered).toDF(*documents.columns)
