"""Quality rules as a ledger: every rule is evaluated once, its verdict is one bit.

``measured`` counts what the rules need, ``ledger`` adds the failure bits, ``applied`` judges the bits
by a versioned policy, and ``ablation`` tells from the bits alone what each rule of a policy costs.
Policies can change without reading a text again. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm.common import table

SPACES = " \t\n\x0b\f\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: (name, bit, failing condition); bits are never reused, so stored ledgers stay valid.
RULES = [
    ("few_words", 0, "n_words < 50"),
    ("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    ("symbols", 2, "3 * n_symbols > n_words"),
    ("repeated_lines", 3, "10 * n_dup_lines > 6 * n_lines"),
    ("long_words", 4, "word_chars > 15 * n_words"),
    ("short_words", 5, "word_chars < 2 * n_words"),
    ("one_line", 6, "n_words > 2000 and n_lines = 1"),
]
BITS = {name: 1 << bit for name, bit, _ in RULES}
BASE = BITS["few_words"] | BITS["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """The rules that count in one version: a document is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[name] for name in set(self.rules))


POLICIES = [
    Policy("base", ("few_words", "repeated_words")),
    Policy("v1", ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "short_words")),
]


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(words: Column) -> Column:
    """A 64-bit hash for each three words in a row."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda word, at: F.xxhash64(word, F.get(words, at + 1), F.get(words, at + 2)),
    )


def _covered(windows: Column) -> Column:
    """Words covered by windows that occur more than once, each word counted once."""

    def places(ordered: Column) -> Column:
        kept = F.filter(
            ordered,
            lambda x, at: (F.get(ordered, at - 1)["h"] == x["h"]) | (F.get(ordered, at + 1)["h"] == x["h"]),
        )
        return F.array_sort(F.transform(kept, lambda x: x["at"]))

    ordered = F.array_sort(F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    total = F.aggregate(
        _once(ordered, places),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("words")),
        lambda state, at: F.struct(
            at.alias("last"), (state["words"] + F.least(F.lit(3), at - state["last"]).cast("long")).alias("words")
        ),
        lambda state: state["words"],
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(total)


def measured(documents: DataFrame) -> DataFrame:
    """``documents`` with the counts the rules need, of whole texts; a null text has no words.

    Columns of these names in the input are replaced. Windows of three words are told apart by a
    64-bit hash within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    counts = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[{SYMBOLS}]")),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _covered(F.col("__windows")),
    }
    prepared = (
        documents.drop(*counts)
        .withColumn("__words", words)
        .withColumn("__lines", lines)
        .withColumn("__windows", _windows(F.col("__words")))
    )
    # As rows of a generator: a filter on a verdict would else be moved below the counts, and count again.
    row = F.struct(*(value.cast("long").alias(name) for name, value in counts.items()))
    return prepared.select("*", F.inline(F.array(row))).drop("__words", "__lines", "__windows")


def ledger(measurements: DataFrame, into: str = "failures") -> DataFrame:
    """Add the failure bits: bit n is set if rule n failed. Every rule is evaluated once."""
    bits = F.lit(0).cast("long")
    for _, bit, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measurements.withColumn(into, bits)


def applied(ledger_: DataFrame, policy: Policy, into: str = "kept", bits: str = "failures") -> DataFrame:
    """Judge stored bits by a policy."""
    return ledger_.withColumn(into, F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablation(ledger_: DataFrame, policy: Policy, bits: str = "failures") -> DataFrame:
    """For every rule of a policy: how many documents fail it, fail it alone, and are kept without it.

    Documents are first counted by their bits, at most 2^rules rows; the rest follows from these.
    """
    counts = ledger_.groupBy(F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")).alias("mask")).agg(
        F.count("*").alias("n")
    )
    rules = F.explode(
        F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name in sorted(set(policy.rules))))
    )
    each = counts.select("mask", "n", rules.alias("r"))
    failed = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("mask") == F.col("r.bit")
    passed = F.col("mask") == 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")

    return each.groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(
        total(failed).alias("n_failed"),
        total(alone).alias("n_failed_alone"),
        total(passed | alone).alias("n_kept_without"),
        F.bit_or(F.when(failed, F.col("mask")).otherwise(F.lit(0).cast("long"))).alias("failed_with"),
    )


CURRENT = POLICIES[-1]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger(measured(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return applied(found, CURRENT).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0).alias("base_failed"),
        "kept", "failures",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    names = docs.columns
    held = docs.select(F.struct(*names).alias("__row"), "text")
    kept = applied(ledger(measured(held)), CURRENT).where("kept")
    return kept.select("__row.*")
