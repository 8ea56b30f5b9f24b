"""Mixing sources to target weights: temperature, and budgeted block permutations.

A source's share of all tokens, raised to an exponent between 0 and 1 and normalised, is its weight; the exponent is
found by bisection. The lower it is, the flatter the mixture, and the more often small sources repeat. A limit of
repetitions asks for the smallest exponent that keeps to it, a target entropy (in nats) for the largest exponent that
reaches it. Exponents are multiples of 2^-20, and each step of the search is one aggregation over the sources.

A weight becomes a quota of tokens: whole passes over the source and a part of one more. Every pass is a new
permutation: of the source's blocks, and of the documents inside each block. Prefix sums over a source's blocks, and
over each block's documents, give every document its place, so that no task holds more than a block of any source,
however large. The part of a pass passes over documents that are longer than all of it, and takes the others in that
order while they fit whole.

Tokens are words unless the caller names a column. A null text has none. Rows without a source form a source of their
own. A source without any token has no weight and is read once. Rows that repeat are placed one by one; extra columns are carried by :func:`mixed` and not read by :func:`schedule`.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlake.llm.common import WORD, stored, text_of

# Documents of a block, on average.
BLOCK_DOCS = 1000
STEPS = 2**20
# Exponents that one aggregation tries.
TRIED = 32
SEED = "mix"


def words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def sizes(rows: DataFrame) -> DataFrame:
    """Documents and tokens of every source, null included."""
    return stored(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), "sources")


def _blocks() -> Column:
    return F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)).cast("long").alias("blocks")


def sources(every: DataFrame) -> DataFrame:
    """Per source with tokens: its documents and tokens, its share of the tokens, and its number of blocks."""
    each = every.filter("tokens > 0")
    total = each.agg(F.sum("tokens")).first()[0] or 0
    return each.select(
        "source", "docs", "tokens", (F.col("tokens") / F.lit(float(total or 1))).alias("share"), _blocks(), F.lit(total).cast("long").alias("total"),
    )


def _meets(each: DataFrame, steps: list[int], ratio: float | None, repetitions: float | None, entropy: float | None) -> list[bool]:
    """Whether the weights under each exponent keep to the limit, or reach the entropy."""
    powers = [F.pow("share", F.lit(k / STEPS)) for k in steps]
    sums = each.agg(
        F.min("share"), F.max("share"), *(F.sum(p) for p in powers), *(F.sum(p * F.log("share")) for p in powers)
    ).first()
    low, high, sums = sums[0], sums[1], sums[2:]
    found = []
    for k, z, e in zip(steps, sums[: len(steps)], sums[len(steps) :]):
        exponent = k / STEPS
        if repetitions is not None:
            most = (high / low) ** (1 - exponent) if ratio is None else ratio * low ** (exponent - 1) / z
            found.append(most <= repetitions)
        else:
            found.append(log(z) - exponent * e / z >= entropy)
    return found


def exponent(each: DataFrame, ratio: float | None = 1.0, repetitions: float | None = None, entropy: float | None = None) -> float:
    """The exponent, 1 where nothing better keeps to the limit; 0 where every exponent keeps to it.

    ``ratio`` is the budget over all tokens; None is the budget that reads every source at least once.
    """
    if (repetitions is None) == (entropy is None):
        raise ValueError("either a limit of repetitions or a target entropy")
    if each.isEmpty():
        return 1.0
    # Below the sought exponent the limit is broken, from it on it holds; the entropy is reached up to the exponent.
    rising = repetitions is not None
    low, high = 0, STEPS
    at_ends = _meets(each, [low, high], ratio, repetitions, entropy)
    if rising and at_ends[0] or not rising and not at_ends[0]:
        return 0.0
    if rising and not at_ends[1] or not rising and at_ends[1]:
        return 1.0
    while high - low > 1:
        step = max(1, (high - low) // TRIED)
        tried = list(range(low + step, high, step))
        meets = _meets(each, tried, ratio, repetitions, entropy)
        turned = [k for k, ok in zip(tried, meets) if ok == rising]
        first = turned[0] if turned else high
        low, high = max([low, *(k for k in tried if k < first)]), first
    return (high if rising else low) / STEPS


def quotas(each: DataFrame, power: float, ratio: float | None = 1.0) -> DataFrame:
    """Per source: its weight, its quota of tokens, the whole passes over it and the tokens of the last, partial one."""
    raised = each.withColumn("raised", F.pow("share", F.lit(power)))
    row = raised.agg(F.sum("raised"), F.max(F.col("share") / F.col("raised"))).first()
    z, least = row[0] or 1.0, row[1] or 1.0
    # So many tokens in all; the source that is repeated least is then read once.
    scale = F.lit(float(ratio)) if ratio is not None else F.lit(float(least * z))
    weighed = raised.withColumn("weight", F.col("raised") / F.lit(z))
    quota = F.floor(F.col("weight") * scale * F.col("total")).cast("long")
    if ratio is None:
        quota = F.greatest(quota, "tokens")
    return weighed.withColumn("quota", quota).select(
        "source", "docs", "tokens", "blocks", "weight", "quota",
        F.floor(F.col("quota") / F.col("tokens")).cast("long").alias("passes"), (F.col("quota") % F.col("tokens")).alias("rest"),
    )


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def _key() -> Column:
    """The source as text that is never null, so that joins and windows share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def _in_blocks(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the plan of their source and their block: the first bits of a hash of the id, by the source's blocks."""
    planned = plan.select(_key().alias("key"), "blocks", "tokens", "quota", "passes", "rest")
    hashed = F.conv(F.substring(_order(F.col("doc_id"), F.col("n_tokens")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("key", _key()).join(planned, "key").withColumn("block", hashed % F.col("blocks"))


def _block_starts(blocks: DataFrame) -> DataFrame:
    """Per source, pass and block: tokens of the blocks before it in the pass's permutation of blocks."""
    before = Window.partitionBy("key", "pass").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    ordered = blocks.withColumn("block_order", _order(F.col("pass"), F.col("source"), F.col("block")))
    return ordered.select("key", "pass", "block", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("block_start"))


def _counted() -> Column:
    """Tokens of a row in its pass: none in the partial pass if the row is longer than all of it."""
    return F.when((F.col("pass") < F.col("passes")) | (F.col("n_tokens") <= F.col("rest")), F.col("n_tokens")).otherwise(0)


def _fits() -> Column:
    """Whether a row is taken by the partial pass."""
    return (F.col("n_tokens") <= F.col("rest")) & (F.col("start_token") + F.col("n_tokens") <= F.col("rest"))


def _placed(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of a pass with ``start_token``, the tokens of their source that come before them in the pass."""
    joined = rows.join(starts, ["key", "pass", "block"]).withColumn("counted", _counted()).withColumn("row_order", _order(F.col("pass"), F.col("doc_id")))
    before = (
        Window.partitionBy("key", "pass", "block").orderBy("row_order", "doc_id", "n_tokens")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = F.coalesce(F.sum("counted").over(before), F.lit(0))
    return joined.withColumn("start_token", F.col("block_start") + within)


def plan(rows: DataFrame, ratio: float | None, repetitions: float | None, entropy: float | None) -> DataFrame:
    """The quotas of all sources; one without tokens has a single pass."""
    every = sizes(rows)
    each = sources(every)
    weighed = quotas(each, exponent(each, ratio, repetitions, entropy), ratio)
    long = lambda n: F.lit(n).cast("long")
    wordless = every.filter("tokens = 0").select(
        "source", "docs", "tokens", _blocks(), F.lit(0.0).alias("weight"), long(0).alias("quota"), long(1).alias("passes"), long(0).alias("rest")
    )
    return stored(weighed.unionByName(wordless), "quotas")


def realised(scheduled: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source its target weight, and its share of the tokens that a schedule reads."""
    read = scheduled.groupBy(_key().alias("key")).agg(F.sum("n_tokens").alias("read"))
    total = F.sum("read").over(Window.partitionBy(F.lit(1)))
    # One row a source.
    return planned.withColumn("key", _key()).join(read, "key", "left").select(
        "source", "weight", (F.coalesce("read", F.lit(0)) / F.greatest(total, F.lit(1))).alias("read_share")
    )


def schedule(
    docs: DataFrame, ratio: float | None = 1.0, repetitions: float | None = 2.0, entropy: float | None = None
) -> DataFrame:
    """One row per document and pass: doc_id, source, pass, block, n_tokens, start_token and ``place``.

    ``place``, from 0 to 1, is the part of its source's quota that comes before the document. Sorted by it, all
    sources advance together, each at its weight.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long"), "source", words().alias("n_tokens")), "mixing-rows")
    planned = plan(rows, ratio, repetitions, entropy)
    blocked = _in_blocks(rows, planned)
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)))
    fitting = F.sum(F.when(F.col("n_tokens") <= F.col("rest"), F.col("n_tokens")).otherwise(0))
    blocks = blocked.groupBy("key", "source", "block", "passes", "rest").agg(F.sum("n_tokens").alias("all_tokens"), fitting.alias("fitting"))
    blocks = blocks.filter("passes > 0 or rest > 0").select("*", passes.alias("pass"))
    starts = _block_starts(blocks.withColumn("block_tokens", F.when(F.col("pass") < F.col("passes"), F.col("all_tokens")).otherwise(F.col("fitting"))))
    placed = _placed(blocked.filter("passes > 0 or rest > 0").select("*", passes.alias("pass")), starts)
    taken = placed.filter((F.col("pass") < F.col("passes")) | _fits())
    place = (F.col("pass") * F.col("tokens") + F.col("start_token")) / F.greatest("quota", F.lit(1))
    return taken.select(
        "doc_id", "source", "pass", "block", "n_tokens", "start_token", place.alias("place")
    )


def mixed(docs: DataFrame, ratio: float | None = None, repetitions: float = 2.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mixture reads it.

    Only the last, partial pass needs its order; the rows are shuffled once, by source and block.
    """
    columns = docs.columns
    narrow = docs.select("source", words().alias("n_tokens"))
    planned = plan(narrow, ratio, repetitions, None)
    carried = docs.select(
        F.struct(*columns).alias("__llm_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), words().alias("n_tokens")
    )
    narrow_blocks = _in_blocks(docs.select("doc_id", "source", words().alias("n_tokens")), planned)
    last = narrow_blocks.withColumn("pass", F.col("passes")).groupBy("key", "source", "block", "pass").agg(F.sum(_counted()).alias("block_tokens"))
    placed = _placed(_in_blocks(carried, planned).withColumn("pass", F.col("passes")), _block_starts(last))
    partial = F.when(_fits() & (F.col("rest") > 0), 1).otherwise(0)
    times = (F.col("passes") + partial).cast("int")
    return placed.filter(times > 0).select("__llm_row", F.explode(F.sequence(F.lit(1), times)).alias("__llm_pass")).select(
        *(F.col("__llm_row").getField(c).alias(c) for c in columns)
    )
