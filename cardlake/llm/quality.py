"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one bit per failed rule; policies
are versioned sets of rules, applied to the stored bits, so that a new policy or an ablation reads no text.

Words are runs of anything but white space. Null and empty texts have no words; all measurements are then zero and
the document fails the rule for short texts. Rows that repeat are measured one by one; extra columns are not read.
Measurements cover whole texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.llm.common import WORD, text_of

SYMBOLS = r"[#*$%&|<>]"
# Positions that fit beside 43 bits of a window's hash in one long.
PACKED_WORDS = 2**21


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds over the measurements; ``bit`` never changes once a ledger is written."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("short", 0, "n_words < 50"),
    Rule("repeated", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("capitals", 4, "100 * n_capital_words > 30 * n_words"),
    Rule("exclamations", 5, "100 * n_exclamations > 30 * n_words"),
    Rule("long_words", 6, "n_words >= 50 and word_chars > 20 * n_words"),
    Rule("unbroken", 7, "longest_word > 1000"),
)
BASE = ("short", "repeated")
POLICIES = {
    "base": BASE,
    "v1": BASE + ("symbols", "repeated_lines", "capitals", "exclamations"),
    "v2": BASE + ("symbols", "repeated_lines", "capitals", "exclamations", "long_words", "unbroken"),
}
CURRENT = "v1"


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _repeat_positions() -> str:
    """SQL for the sorted positions of the 3-word windows that occur twice or more in ``words``.

    One sort of longs, each 43 bits of a window's hash beside its position, finds candidates; only these are compared
    by the whole hash. Texts with more words than fit into a position are compared by the whole hash at once.
    """
    hashed = "transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"
    packed = f"sort_array(transform({hashed}, (h, i) -> (h & ~{PACKED_WORDS - 1}L) | i))"

    def neighbours(rows: str, same: str) -> str:
        return (
            f"transform({rows}, s -> filter(s, (x, i) -> (i > 0 and {same.format('s[i - 1]')})"
            f" or (i < size(s) - 1 and {same.format('s[i + 1]')})))[0]"
        )

    same_bits = f"(x & ~{PACKED_WORDS - 1}L) = ({{}} & ~{PACKED_WORDS - 1}L)"
    candidates = f"transform({neighbours(f'array({packed})', same_bits)}, x -> cast(x & {PACKED_WORDS - 1}L as int))"
    positions = f"case when size(words) < {PACKED_WORDS} then {candidates} else sequence(0, size(words) - 3) end"
    exact = f"sort_array(transform({positions}, i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) as h, i as i)))"
    return f"sort_array(transform({neighbours(f'array({exact})', 'x.h = {}.h')}, x -> x.i))"


def _covered(positions: str) -> str:
    """Words under windows of three that begin at these sorted positions."""
    return f"aggregate({positions}, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and all measurements of every row."""
    rows = docs.select("doc_id", text_of("text").alias("text"))
    rows = rows.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
    )
    capital = lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"case when size(words) < 4 then 0L else {_covered(_repeat_positions())} end").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", capital)).cast("long").alias("n_capital_words"),
        "n_exclamations",
        F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).cast("long").alias("longest_word"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failed``, one bit per rule."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", bits)


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0


def verdicts(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with base_failed and kept under a policy."""
    return rows.withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that stay when it is left out.

    The ledger is first counted per mask: at most one row for each set of failed rules goes on.
    """
    active = mask(policy)
    sets = rows.groupBy(F.col("failed").bitwiseAND(F.lit(active)).alias("failed")).agg(F.count(F.lit(1)).alias("docs"))
    named = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if active >> r.bit & 1)))
    each = sets.select("failed", "docs", named.alias("r")).select("failed", "docs", "r.rule", "r.bit")
    count = lambda condition: F.sum(F.when(condition, F.col("docs")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("failed") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("failed").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
