"""Curriculum by retrieval utility: competence, the visible pool, an epoch's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.ranks import with_rank


def competence(step: Column, total: Column, initial: float = 0.25) -> Column:
    """Square-root growth from ``initial`` to 1 over ``total`` steps."""
    done = F.least(F.greatest(step / F.nullif(total, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    return F.when(total <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.sqrt(done * (1 - initial**2) + initial**2)))


def ranked(utilities: DataFrame) -> DataFrame:
    """Rank 1 is the highest utility; ties go to the smaller id."""
    return with_rank(utilities, F.desc("utility"), F.asc("example_id"))


def visible_pool(ranks: DataFrame, share: float) -> DataFrame:
    """The best ``share`` of the examples, at least one."""
    n = ranks.count()
    size = F.greatest(F.lit(1), F.bround(F.lit(float(share)) * n, 0).cast("long"))
    return ranks.where(F.col("rank") <= size)


def schedule(n: int, batch_size: int = 8, accumulation: int = 4, epochs: int = 3, ramp: float = 0.5) -> list[tuple[int, int, int]]:
    """(epoch, step at its start, steps of the ramp)."""
    per_epoch = max(1, n // batch_size) // accumulation
    ramp_steps = max(1, int(per_epoch * epochs * ramp))
    return [(e, e * per_epoch, ramp_steps) for e in range(epochs)]


#: The permutation's prime and factors (fixed values).
_PRIME, _FACTORS = 2_147_483_647, (1_103_515_245, 1_299_709, 16_807, 48_271)
#: Steps of a walk out of the surplus places at most; each is needed with a probability below 1 / sqrt(n).
WALK = 24


def _mix(x: Column, number: int, key: Column) -> Column:
    return x * ((x * _FACTORS[number] + key) % _PRIME) % _PRIME


def permuted(place: Column, n: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. n - 1, without a sort: four rounds of a Feistel network over a grid of a x b >= n places,
    where a is the root of n rounded up; who lands on one of the fewer than a surplus places goes on from there. ``key``:
    a number from 0 to 2^31 - 2."""
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("long"))

    def step(v: Column, a: Column, b: Column) -> Column:
        left = F.call_function("div", v, b)
        right = v % b
        for number in (0, 2):
            left = (left + _mix(right, number, (key + number) % _PRIME)) % a
            right = (right + _mix(left, number + 1, (key + number + 1) % _PRIME)) % b
        return left * b + right

    def walk(grid: Column) -> Column:
        a, b = grid["a"], grid["b"]
        found = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(place, a, b), lambda v, _: F.when(v < n, v).otherwise(step(v, a, b)))
        return F.when(found < n, found).otherwise(F.raise_error(F.lit("a walk of the permutation is too long; take another seed")))

    grid = F.struct(a.alias("a"), F.greatest(F.lit(1), F.ceil(n / a)).cast("long").alias("b"))
    return F.element_at(F.transform(F.array(grid), walk), 1)


def epoch_pools(utilities: DataFrame, initial: float = 0.25, batch_size: int = 8, accumulation: int = 4, epochs: int = 3, ramp: float = 0.5, seed: int = 42) -> DataFrame:
    """(epoch, place, example_id): each epoch's visible pool in a seeded order, in which rank r of the pool has the place that
    a permutation keyed by seed and epoch gives it. The epoch table has a row an epoch."""
    ranks = ranked(utilities)
    n = ranks.count()
    plan = utilities.sparkSession.createDataFrame(schedule(n, batch_size, accumulation, epochs, ramp), "epoch int, step long, ramp long")
    sized = plan.withColumn("size", F.greatest(F.lit(1), F.bround(competence(F.col("step"), F.col("ramp"), initial) * n, 0).cast("long")))
    pools = ranks.join(F.broadcast(sized.select("epoch", "size")), F.col("rank") <= F.col("size"))
    key = (F.lit(seed).cast("long") * 7919 + F.col("epoch") * 104_729) % _PRIME
    return pools.select("epoch", (permuted(F.col("rank") - 1, F.col("size"), key) + 1).alias("place"), "example_id")
