"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule, so a policy (a version and the rules it enforces) is a
mask over stored bits: a new policy needs no look at the texts. The ledger is a written table, and
policies and ablations read it alone. Ablations,
that is what each rule removes alone or together with others, are counted from
the bit patterns, of which there are at most 2 to the number of rules.

Null texts count as empty. Rows are independent: repeated rows and repeated or
null ids give one ledger row each, an empty table an empty ledger. Other columns
of the input are not carried, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, let, texts, words

WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
MORE_MEASURES = ["n_distinct_words", "n_digits", "n_bullet_lines", "n_open_lines"]


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` holds over the measurements."""

    bit: int
    name: str
    fails: str


# Bits are never reused: a rule that changes gets a new one.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "short_words", "word_chars < 2 * n_words"),
    Rule(4, "long_words", "word_chars > 20 * n_words"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)
EXTENDED = (
    *RULES,
    Rule(6, "few_distinct_words", "100 * n_distinct_words < 15 * n_words"),
    Rule(7, "digits", "100 * n_digits > 25 * word_chars"),
    Rule(8, "bullets", "100 * n_bullet_lines > 80 * n_lines"),
    Rule(9, "open_lines", "100 * n_open_lines > 30 * n_lines"),
    Rule(10, "long_lines", "word_chars > 8000 * n_lines"),
    Rule(11, "very_long", "n_words > 100000"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: Sequence[str]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        by_name = {r.name: r.bit for r in (*rules, *EXTENDED)}
        return sum(1 << by_name[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", tuple(r.name for r in RULES))
V2 = Policy("v2", ("few_words", "repeated_windows", "symbols", "few_distinct_words", "digits", "bullets", "open_lines", "long_lines"))
POLICIES = (BASE, V1, V2)


def _repeat_words(word_list: Column) -> Column:
    """Words in windows that occur twice or more, the first ones included. The
    windows are sorted with their places, so equal ones are neighbours."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(
            F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("p")))
        )

        def places(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, i: (x["w"] == F.get(s, i + 1)["w"]) | (x["w"] == F.get(s, i - 1)["w"]),
            )
            spread = F.transform(again, lambda x: F.array(*[x["p"] + k for k in range(WINDOW)]))
            return F.size(F.array_distinct(F.flatten(spread)))

        distinct = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(distinct, 0).otherwise(let(ordered, places))

    def windows_of(w: Column) -> Column:
        joined = F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, WINDOW)]),
        )
        return let(joined, covered)

    return let(word_list, windows_of)


def measure(df: DataFrame) -> DataFrame:
    """doc_id and the measurements, from whole texts."""
    base = texts(df).select("doc_id", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    bullets = F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))
    open_lines = F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))
    return base.select(
        "doc_id",
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct_words"),
        F.regexp_count("text", F.lit("[0-9]")).cast("bigint").alias("n_digits"),
        F.size(bullets).cast("bigint").alias("n_bullet_lines"),
        F.size(open_lines).cast("bigint").alias("n_open_lines"),
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        repeated.cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("bigint").alias("n_repeat_words"),
    )


def ledger(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and ``fail_bits`` of every document, to be stored by :func:`store`."""
    bits = F.lit(0).cast("bigint")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(df).withColumn("fail_bits", bits)


def store(df: DataFrame, rules: Sequence[Rule] = RULES, path: str | None = None) -> DataFrame:
    """The ledger of ``df``, written once (below ``path`` or the shared folder) and read back."""
    rows = ledger(df, rules)
    if path is None:
        return cut(rows, "quality-ledger")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def failed(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """True where a stored row fails the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) != 0


def apply_policy(stored: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with the policy's version and verdict."""
    return stored.withColumn("policy", F.lit(policy.version)).withColumn("kept", ~failed(policy, rules))


def ablation(stored: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (and
    would stay without it), and what the policy keeps with and without it.
    One pass counts bit patterns; the rest is arithmetic on those."""
    patterns = stored.groupBy(
        F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")).alias("bits")
    ).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.name in policy.rules]
    table = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in chosen])
    rows = patterns.select("bits", "n", F.inline(table))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("bigint")

    return rows.groupBy("rule").agg(
        count(has).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("bits") == 0).alias("n_kept"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
