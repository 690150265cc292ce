"""Mixing sources to target weights.

Words are summed per source; each source's target is its weight's share of the
budget, held at ``most`` times its size, and what a held source cannot take is
shared among the others by weight until none is above (water filling).  The
repetition rate of a source is target / size.  A document is emitted
floor(rate) times, and once more if a uniform number hashed from its id and the
seed falls below the fraction, so that reruns agree.

Water filling needs no loop: sources sorted by size / weight are held from the
smallest up, so that running sums over the table of sources give the level.
That table has one short row a source; documents are never gathered by source.

Nulls and edge cases: null text has size 0.  Null is a source like any other and
comes last.  A source without words has target 0 and is emitted as its rate of
0 says.  Documents without an id draw by their text.  Rows of one id, and equal rows without one, share a draw.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import column, durable, fresh, small, word_count

#: Sources up to this many are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) hashed from the seed and an id, or the text where the id is null: 52 bits of MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``target`` of rows ``source``, ``size``.

    Sources take the weights in turn, in the order of their code points, null
    last.  The budget is a share of all sizes and must not be over ``most``.
    """
    if budget > most:
        raise ValueError("the sources cannot fill the budget")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = totals.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumn("total", F.sum("source_size").over(everyone) * budget)
    filled = filled.withColumn("held", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    filled = filled.withColumn("open_w", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # The level if all before this source are held and this one and those after it are not.
    filled = filled.withColumn("level", (F.col("total") - F.col("held")) / F.col("open_w"))
    filled = filled.withColumn("free", F.col("cap") >= F.col("level") * F.col("w"))
    # The first free source sets the level of all that are free; levels only fall after it.
    filled = filled.withColumn("shared", F.max(F.when(F.col("free"), F.col("level"))).over(everyone))
    target = F.when(F.col("shared").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("shared") * F.col("w")))
    return filled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 6, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` of each document."""
    sized = durable(docs.select(column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), word_count(column(text_col)).alias("size"), uniform(seed, column(id_col), column(text_col)).alias("draw")))
    targets = small(source_targets(sized, weights, budget, most).select(F.col("source").alias("s"), "source_size", "target"), BROADCAST_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (F.col("draw") < rate - whole).cast("long")
    joined = sized.join(targets, sized.source.eqNullSafe(targets.s))
    return joined.select("doc_id", "source", "size", "source_size", "target", (whole + extra).alias("copies"))


def emit(docs: DataFrame, seed: int = 6, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the rate comes by source, so that texts aren't shuffled."""
    name, key, rate = (fresh(x, docs.columns) for x in ("copies", "s", "rate"))
    source, text = options.get("source_col", "source"), options.get("text_col", "text")
    sizes = docs.select(column(source).cast("string").alias("source"), word_count(column(text)).alias("size"))
    targets = source_targets(sizes, *[options[k] for k in ("weights", "budget", "most") if k in options])
    targets = small(targets.select(F.col("source").alias(key), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate)), BROADCAST_SOURCES)
    joined = docs.join(targets, column(source).cast("string").eqNullSafe(F.col(key)))
    draw = uniform(seed, column(id_col), column(text)) < F.col(rate) - F.floor(rate)
    times = (F.floor(rate) + draw.cast("long")).cast("int")
    kept = joined.withColumn(name, times).where(F.col(name) > 0)
    return kept.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).select(*[column(c) for c in docs.columns])
