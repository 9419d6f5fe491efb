"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldrollup.llm.common import let, text_or_empty, without_spaces, words

SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages.
STOP_WORDS = tuple(
    "the of and to in a is that it for on was with as be by this are at from or an "
    "der die und das den von zu mit des ist ein im auf für "
    "le la les de et en un une que est pour dans du "
    "el los las y por con para del una se".split()
)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` is outside [low, high]; it holds from ``min_words`` words on."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The method's verdict. Measures are ratios over the base counts, see ``measures``.
RULES = (
    Rule("length", "n_words", low=10, high=10_000_000),
    Rule("word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("stop_words", "stop_ratio", low=0.06, min_words=50),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows that the text holds twice or more, the first occurrence included.

    Windows are told apart by a 64-bit hash. It is sorted first; only a text in which two
    are equal goes on to the places. O(n log n) for any text, without a shuffle.
    """
    places = F.when(F.size(w) >= window, F.sequence(F.lit(0), F.size(w) - window)).otherwise(F.array().cast("array<int>"))
    hashed = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)])

    def any_equal(h: Column) -> Column:
        return F.exists(F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))

    def covered(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        at = F.sort_array(F.transform(hit, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    pairs = F.transform(places, lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))
    full = let(F.sort_array(pairs), covered)
    return F.when(let(F.sort_array(F.transform(places, hashed)), any_equal), full).otherwise(F.lit(0))


def duplicate_lines(text: Column) -> Column:
    """(lines with a word, those of them that equal an earlier one)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: without_spaces(x) != "")
    return let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup")))


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One boolean expression: true if every rule holds."""
    kept = F.lit(True)
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (F.col(r.measure) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.measure) <= r.high)
        kept = kept & ((F.col("n_words") < r.min_words) | ok)
    return kept


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each input row: counts, ratios, ``base_failed`` and the verdict ``kept``.

    No shuffle and no user function: a scan and two projections. Null and empty texts have
    no words and fail the base rule; a null id stays null; repeated rows are judged each;
    an empty table gives an empty result; further columns aren't looked at.
    """
    text = text_or_empty(text_col)
    plain = F.translate(F.lower(text), ".,;:", "")
    base = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat"))).alias("w"),
        F.char_length(without_spaces(text)).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        duplicate_lines(text).alias("l"),
        F.size(F.filter(words(plain), lambda x: x.isin(*STOP_WORDS))).alias("n_stop"),
    )
    over = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = F.col("w.n_words")
    counted = base.select(
        "doc_id", n.cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        F.col("l.n_dup").cast("bigint").alias("n_dup_lines"), F.col("w.n_repeat").cast("bigint").alias("n_repeat_words"),
        over(F.col("word_chars"), n).alias("mean_word_chars"), over(F.col("n_symbols"), n).alias("symbol_ratio"),
        over(F.col("n_stop"), n).alias("stop_ratio"), over(F.col("l.n_dup"), F.col("l.n_lines")).alias("dup_line_ratio"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
