"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight schedule over training time 0..1.  The integral of the
schedule, scaled to the source's target, is its cumulative token demand; every
document copy sits at a cumulative token count of its source, and the inverse of
the demand at that count is its training position.  Documents are then
range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dense_rank, n_words, order_key, running_total

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: For each weight, knots (time, rate) of its piecewise linear schedule; rates are scaled to a mean of 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, rank, source_size, target): ``share`` of all words dealt by weight, at most ``repeats`` times a source.

    Each pass caps the sources whose share exceeds their limit and deals the excess
    to the others by weight; a pass is one aggregate over the source table, of which
    two scalars reach the driver.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = dense_rank(sources, "source", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeats)))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > F.col("most")
        n, held, open_weight = ranked.agg(
            F.sum(full.cast("int")), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - (held or 0.0)) / open_weight
    return ranked.withColumn("target", F.least("most", F.col("weight") * F.lit(level))).drop("weight", "most")


def training_position(demand, rank, schedules=SCHEDULES) -> F.Column:
    """Time in 0..1 at which a source with this rank has asked for the share ``demand`` (0..1) of its target.

    Inverts the integral of the piecewise linear rate: within a segment that starts at
    (t, rate a) with slope k, the time after t at which a further amount u is asked for
    is 2u / (a + sqrt(a*a + 2*k*u)).
    """
    chosen = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
        whole, done, time = sum(areas), 0.0, F.lit(1.0)
        parts = []
        for (t0, a), (t1, b), area in zip(knots, knots[1:], areas, strict=False):
            u = demand * whole - done
            root = F.lit(a) + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * (b - a) / (t1 - t0) * u))
            parts.append((done + area, t0 + F.when(root > 0, 2 * u / root).otherwise(0.0)))
            done += area
        for most, at in reversed(parts):
            time = F.when(demand * whole <= most, at).otherwise(time)
        chosen = F.when(rank % len(schedules) == i, time).otherwise(chosen)
    return chosen


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2, schedules=SCHEDULES) -> DataFrame:
    """Deal documents to training positions: (doc_id, text_key, size, source_size, target, copies, taken, positions).

    One row for each input row.  ``copies`` is how often the mix takes the document,
    ``positions`` has one training position in 0..1 for each copy.  Copy k of a document
    covers the words k*source_size + before ... + size of its source in a fixed shuffled
    order, and is taken if its middle lies below the target, so that a source's taken
    words miss the target by less than half a document.

    Defined results: a null text has size 0; a null source is a source of its own, the
    last; a source without words has target 0 and nothing of it is taken; repeated rows
    are separate documents; no rows give no rows; further columns are ignored.
    """
    sizes = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"), order_key(F.col("doc_id")).alias("key")
    )
    sizes = cut(sizes)
    targets = source_targets(sizes, weights, share, repeats)
    # The few columns of a source travel with its rows' (source, slice) keys, so that a hot source is many keys.
    slices = 64
    spread = targets.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    ranked = sizes.withColumn("_slice", F.pmod(F.col("key"), F.lit(slices)).cast("int")).alias("d")
    ranked = (
        ranked.join(spread.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._slice") == F.col("s._slice")))
        .select("d.doc_id", "d.size", "d.text_key", "d.key", "s.rank", "s.source_size", "s.target")
    )
    placed = running_total(ranked, "rank", "key", "size", "before", ["doc_id", "text_key", "size"], rows=sizes.count())
    middles = F.array(*[F.col("source_size") * k + F.col("before") + F.col("size") / 2 for k in range(repeats)])
    placed = placed.withColumn("middles", F.filter(middles, lambda m: m < F.col("target")))
    return placed.select(
        "doc_id", "text_key", "size", "source_size", "target",
        F.size("middles").alias("copies"),
        (F.size("middles") * F.col("size")).alias("taken"),
        F.transform("middles", lambda m: training_position(m / F.col("target"), F.col("rank"), schedules)).alias("positions"),
    )


def in_training_order(mixed: DataFrame, position: str = "position") -> DataFrame:
    """Range-partition and sort by training position."""
    return mixed.orderBy(position, "doc_id")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as it is taken, range-sorted by training position."""
    quoted = [f"`{c}`" for c in docs.columns]
    mixed = mix(docs, **options).where("copies > 0")
    # Repeated rows have an entry each; nothing tells them apart, so their positions are pooled and dealt to one of them.
    pooled = mixed.groupBy(F.coalesce("doc_id", F.lit(0)).alias("__own_id"), F.col("doc_id").isNull().alias("__own_none"), F.col("text_key").alias("__own_key"))
    pooled = pooled.agg(F.flatten(F.collect_list("positions")).alias("__own_positions"), F.count(F.lit(1)).alias("__own_rows"))
    own = {"__own_id": F.coalesce("doc_id", F.lit(0)), "__own_none": F.col("doc_id").isNull(), "__own_key": F.xxhash64("text")}
    joined = docs.withColumns(own).join(pooled, list(own))
    single = joined.where("__own_rows = 1").select(*quoted, F.explode("__own_positions").alias("__own_position"))
    repeated = joined.where("__own_rows > 1").dropDuplicates(list(own)).select(*quoted, F.explode("__own_positions").alias("__own_position"))
    return single.unionByName(repeated).orderBy("__own_position", "doc_id").drop("__own_position")
