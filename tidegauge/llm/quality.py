"""Quality rules as a ledger of bits.

Each rule is evaluated once per document; its measurement and its failure bit are kept. A policy is a version name and a
set of rules: a document passes it if none of its failure bits is in the policy's mask. Policies and ablations read only
the ledger, never the text. All of it is DataFrame expressions.

Defined results: a null text counts as empty; an empty text has no words and fails `min_words`; repeated rows are judged
one by one; other columns of the input are not read, so clashing names do no harm; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES_RE

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`fails` is true for a document that breaks the rule; its place in RULES is its bit."""

    name: str
    fails: Column | str


#: Order is the order of bits; new rules go to the end, so stored ledgers stay readable.
RULES: dict[str, str] = {
    "min_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
#: Versioned policies: the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("min_words", "repeated_words"),
    "v1": ("min_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
}


def mask_of(rules: tuple[str, ...] | list[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long), from the whole text."""
    t = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    t = t.select(
        id_col,
        F.filter(F.split("_t", SPACES_RE), lambda x: x != "").alias("_w"),
        F.length(F.regexp_replace("_t", SPACES_RE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    # Windows of three words as (hash, position), equal hashes side by side after the sort.
    t = t.select(
        id_col, "word_chars", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))).alias("_s"),
    )
    t = t.select(
        *[c for c in t.columns if c != "_s"],
        F.sort_array(F.transform(F.filter("_s", lambda e, k: (F.get("_s", k - 1)["h"] == e["h"]) | (F.coalesce(F.get("_s", k + 1)["h"] == e["h"], F.lit(False)))), lambda e: e["i"])).alias("_p"),
    )
    # Each repeated window covers three words, less what the next one covers again.
    covered = F.aggregate(F.transform("_p", lambda x, k: F.coalesce(F.least(F.lit(3), F.get("_p", k + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x)
    return t.select(id_col, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and fail_bits (long): bit k is set if rule k of RULES fails."""
    bits = [F.when(F.expr(f), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, f in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measurements(docs, id_col, text_col).withColumn("fail_bits", total)


def verdict(fail_bits: Column | str, policy: str) -> Column:
    """True if no failure counts under the policy."""
    c = F.col(fail_bits) if isinstance(fail_bits, str) else fail_bits
    return c.bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that pass once it is left out.

    The ledger is first reduced to counts per bit pattern, of which there are at most 2 ** len(RULES).
    """
    mask = mask_of(POLICIES[policy])
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit")) for r in POLICIES[policy]])
    x = patterns.select("b", "n", F.explode(rules).alias("r")).select("b", "n", "r.rule", "r.bit")
    left = F.col("b").bitwiseAND(F.bitwise_not("bit"))
    return x.groupBy("rule").agg(
        F.sum(F.when(F.col("b").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("b") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(left == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
