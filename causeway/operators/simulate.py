"""What-if simulation on adjacency matrices (J17, J18), one row a run, inside one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQUASH = {
    "sigmoid": lambda x, lam: 2.0 / (1.0 + F.exp(-x * lam)) - 1.0,
    "tanh": lambda x, lam: F.tanh(x * lam),
    "none": lambda x, lam: x,
}


def _initial(concepts, activation, bound: bool = False):
    value = lambda c: F.coalesce(F.try_element_at(activation, c).cast("double"), F.lit(0.0))
    return F.transform(concepts, lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value(c))) if bound else value(c))


def _pushed(state, matrix, i):
    """The state of concept ``i`` plus what its causes send."""
    return F.get(state, i) + F.aggregate(F.zip_with(state, matrix, lambda a, row: a * F.coalesce(F.get(row, i), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def simulate(runs: DataFrame, steps: int = 30, squash: str = "sigmoid", lam: float = 1.0, clamp_drivers: bool = True, tol: float = 1e-4) -> DataFrame:
    """Runs (..., concepts array, matrix array of rows, activation map) with history, final, influence, iterations, converged.

    Each step is f(a + A'a); concepts in ``activation`` keep their value if drivers are clamped. A run stops when no
    value moves by ``tol``. Names that the map does not have are ignored. Null activations are empty.
    """
    if squash not in SQUASH:
        raise ValueError(f"unknown squash={squash!r}")
    activation = F.coalesce("activation", F.create_map().cast("map<string,double>"))
    df = runs.withColumn("_start", _initial(F.col("concepts"), activation)).withColumn("_driver", F.transform("concepts", lambda c: F.array_contains(F.map_keys(activation), c)))

    def step(acc):
        state = acc["state"]
        after = F.transform(F.sequence(F.lit(0), F.size(state) - 1), lambda i: F.when(F.get("_driver", i) if clamp_drivers else F.lit(False), F.get("_start", i)).otherwise(SQUASH[squash](_pushed(state, F.col("matrix"), i), lam)))
        return after

    def move(acc, after):
        gap = F.array_max(F.zip_with(acc["state"], after, lambda a, b: F.abs(a - b)))
        return F.struct(after.alias("state"), F.concat(acc["history"], F.array(after)).alias("history"), (F.coalesce(gap, F.lit(0.0)) < tol).alias("done"))

    empty = F.col("_start")
    start = F.struct(empty.alias("state"), F.array(empty).alias("history"), F.lit(False).alias("done"))
    # `after` is bound once a step by a one-element aggregate, so the step is not expanded twice
    run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, _: F.when(acc["done"] | (F.size(acc["state"]) == 0), acc).otherwise(F.get(F.transform(F.array(step(acc)), lambda after: move(acc, after)), F.lit(0))))
    out = df.withColumn("_run", run)
    return out.select(
        *runs.columns, F.col("_run.history").alias("history"), F.col("_run.state").alias("final"), F.zip_with("_run.state", "_start", lambda a, b: a - b).alias("influence"),
        (F.size("_run.history") - 1).alias("iterations"), F.col("_run.done").alias("converged"),
    )


def top_effects(simulated: DataFrame, n: int = 15) -> DataFrame:
    """Rows (keys..., concept, final, influence, rank) of the ``n`` largest influences of each run; ties by position."""
    keys = [c for c in simulated.columns if c not in ("concepts", "matrix", "activation", "history", "final", "influence", "iterations", "converged")]
    items = F.transform(F.arrays_zip("concepts", "final", "influence"), lambda x, i: F.struct((-F.abs(x["influence"])).alias("order"), i.alias("i"), x["concepts"].alias("concept"), x["final"].alias("final"), x["influence"].alias("influence")))
    return simulated.select(*keys, F.posexplode(F.slice(F.array_sort(items), 1, n)).alias("rank", "x")).select(*keys, (F.col("rank") + 1).alias("rank"), "x.concept", "x.final", "x.influence")


def run_scenario(runs: DataFrame, steps: int = 5) -> DataFrame:
    """clip(x + A'x) within [-1, 1] for a fixed number of steps; activations are clipped, drivers are not held; 4 places."""
    activation = F.coalesce("activation", F.create_map().cast("map<string,double>"))
    start = _initial(F.col("concepts"), activation, bound=True)
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: clip(_pushed(s, F.col("matrix"), i))))
    return runs.withColumn("state", F.transform(state if steps > 0 else start, lambda x: F.round(x, 4)))


def spread(edges: DataFrame, activation: DataFrame, steps: int = 5, lam: float = 1.0) -> DataFrame:
    """Kosko steps (tanh, drivers held) in long form for maps too large for a matrix: map_key, concept, value.

    Each step is a join with the edges and a partly pre-summed group-by; lineage is cut in the shared folder.
    """
    from ..shared import written
    from .graph import nodes_of

    drivers = activation.select("map_key", "concept", F.col("value").alias("held"))
    base = written(nodes_of(edges).select("map_key", "concept").join(drivers, ["map_key", "concept"], "left"), "spread")
    state = base.select("map_key", "concept", F.coalesce("held", F.lit(0.0)).alias("value"))
    arcs = edges.groupBy("map_key", "source", "target").agg(F.sum("weight").alias("weight"))
    for _ in range(steps):
        sent = arcs.join(state.withColumnRenamed("concept", "source"), ["map_key", "source"]).groupBy("map_key", F.col("target").alias("concept")).agg(F.sum(F.col("weight") * F.col("value")).alias("got"))
        after = base.join(state, ["map_key", "concept"]).join(sent, ["map_key", "concept"], "left")
        state = written(after.select("map_key", "concept", F.coalesce("held", F.tanh(lam * (F.col("value") + F.coalesce("got", F.lit(0.0))))).alias("value")), "spread")
    return state
