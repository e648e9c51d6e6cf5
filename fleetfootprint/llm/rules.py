"""Quality rules: a table of thresholds compiled into one projection over ratios of a text.

Only built-in functions, one pass per row, no shuffle. Repeated windows are found by sorting the 64-bit hashes of a
text's three-word windows, so work per text is n log n and memory is bounded by the text itself.

Defined cases: a null or empty text has no words, all counts are 0 and the base rule fails; rows that repeat are
judged each by itself; an empty table gives an empty result; other columns are neither read nor kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50

# Frequent short words of the languages the pipeline takes.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on", "be", "by", "this",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "im", "auf", "ein", "eine",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "est", "que", "qui", "dans", "pour", "par",
    "el", "los", "las", "y", "por", "con", "una", "no", "para", "del", "se",
)


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` has to lie within [low, high]; columns are those of ``measures``."""

    name: str
    numerator: str
    denominator: str
    low: float = float("-inf")
    high: float = float("inf")


RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.4),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
    Rule("capitals", "n_capitals", "word_chars", high=0.4),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts the rules are made of."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    return hashed.withColumn("n_repeat_words", repeated_words(hashed["codes"])).drop("codes")


def repeated_words(codes: Column) -> Column:
    """Positions that lie in a window of three codes found twice or more."""
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 2), F.slice(codes, F.lit(2), F.size(codes) - 2), lambda a, b: F.struct(a, b))
    windows = F.zip_with(pairs, F.slice(codes, F.lit(3), F.size(codes) - 2), lambda two, third: F.xxhash64(two, third))
    placed = F.array_sort(F.transform(windows, lambda code, at: F.struct(code.alias("code"), at.alias("at"))))
    none = F.array().cast("array<int>")

    def both(rows: Column) -> Column:
        near = F.zip_with(
            F.slice(rows, F.lit(1), F.size(rows) - 1),
            F.slice(rows, F.lit(2), F.size(rows) - 1),
            lambda a, b: F.when(a["code"] == b["code"], F.array(a["at"], b["at"])).otherwise(none),
        )
        return F.array_sort(F.array_distinct(F.flatten(near)))

    def covered(starts: Column) -> Column:
        steps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    # binding by a one-element array keeps each sorted array from being built again for every use of it
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    found = bind(placed, lambda rows: bind(both(rows), covered))
    return F.when(F.size(codes) < 4, F.lit(0).cast("long")).otherwise(found)


def verdict(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule holds; a ratio without a denominator fails."""
    kept = F.lit(True)
    for rule in rules:
        ratio = F.try_divide(measured[rule.numerator].cast("double"), measured[rule.denominator].cast("double"))
        kept = kept & F.coalesce(ratio.between(rule.low, rule.high), F.lit(False))
    return kept


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    measured = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(measured, rules))
