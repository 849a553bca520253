"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit, policies are masks.

The ledger row of a text holds its measurements and a bit per rule that it fails. A policy is a set of
rules; it rejects a text if the bits have one of its rules. Other policies and ablations are bitwise
work over the ledger and never look at the texts again. Built-in functions only.

A null or empty text has no words and fails ``few_words``. Ratios of texts without words are zero.
Repeated rows get equal ledger rows; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import unused

WINDOW = 8
# White space between words, and the symbols counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is a condition over the measurements."""

    name: str
    fails: Callable[[], Column]


# Ratios are compared as whole numbers, so no rounding decides. The place of a rule is its bit.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: F.col("n_words") < 20),
    Rule("repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("capitals", lambda: 100 * F.col("n_capitals") > 40 * F.col("word_chars")),
)


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        place = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << place[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(r.name for r in RULES))


def bound_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered_by_repeats(words: Column) -> Column:
    """Words in windows that occur twice or more in the text."""
    count = F.size(words)

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def starts(ordered: Column) -> Column:
            same_as_next = F.transform(
                F.slice(ordered, 1, F.size(ordered) - 1),
                lambda x, k: F.when(x["w"] == F.get(ordered, k + 1)["w"], F.array(x["i"], F.get(ordered, k + 1)["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(same_as_next, lambda p: p.isNotNull()))))

        def length(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda total, g: total + g)

        return bound_once(bound_once(order, starts), length)

    def counted(windows: Column) -> Column:
        # Most texts have no repeat, which a set of the windows tells at once.
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))

    windows = F.transform(F.sequence(F.lit(1), count - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(count > WINDOW, bound_once(windows, counted)).otherwise(0)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements of each whole text; columns with their names are replaced."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # A set of one-character matches, so that no word is a regular expression's business.
    blank = f"[{SPACE}]+"

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _covered_by_repeats(words).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    words = F.filter(F.split(whole, blank), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda line: F.translate(line, SPACE, "") != "")
    letters = F.translate(whole, SPACE, "")
    by_word, by_line = unused(df, "_words"), unused(df, "_lines")
    measured = {
        by_word: bound_once(words, of_words),
        by_line: bound_once(lines, of_lines),
        "word_chars": F.char_length(letters).cast("long"),
        "n_symbols": (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_capitals": (F.char_length(whole) - F.char_length(F.regexp_replace(whole, r"\p{Lu}", ""))).cast("long"),
    }
    out = df.withColumns(measured)
    return out.withColumns({
        "n_words": F.col(f"{by_word}.n_words"), "n_repeat_words": F.col(f"{by_word}.n_repeat_words"),
        "n_lines": F.col(f"{by_line}.n_lines"), "n_dup_lines": F.col(f"{by_line}.n_dup_lines"),
    }).drop(by_word, by_line)


def ledger(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with measurements and ``failed_bits``, bit i being set if rule i fails."""
    measured = measure(df, text)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << i)).otherwise(0).cast("long"))
    return measured.withColumn("failed_bits", bits)


def rejects(policy: Policy, rules: Sequence[Rule] = RULES, bits: str = "failed_bits") -> Column:
    """Whether a policy rejects a ledger row."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules))) != 0


def ablations(ledger_rows: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and rule: texts that fail it, that only it rejects, and kept with and without it.

    The ledger is counted by bit set first, at most 2^rules rows, whatever its size.
    """
    counts = ledger_rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(r.name).alias("rule"),
                               F.lit(p.mask(rules)).cast("long").alias("mask"), F.lit(1 << i).cast("long").alias("bit"))
                      for p in policies for i, r in enumerate(rules) if r.name in p.rules])
    each = counts.select("failed_bits", "n", F.explode(cases).alias("c")).select("failed_bits", "n", "c.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(
        total(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0).alias("fails"),
        total(hit == F.col("bit")).alias("rejected_by_it_alone"),
        total(hit == 0).alias("kept"),
        total((hit == 0) | (hit == F.col("bit"))).alias("kept_without_it"),
    )
