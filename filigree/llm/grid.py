"""A grid over the most varied features of each data set, its counted cells and the touching ones (all SQL).

Cells are `width` wide, and records at most `width` apart lie in the same or in touching cells. How many features the
grid takes follows from the number of records, so that cells do not fill as data grow: the fewest for which a cell is
expected to hold at most LOAD records, at most AXES. A feature that is not used has coordinate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = 6
LOAD = 512
COORDS = [f"c{k}" for k in range(AXES)]
CELL = ["dataset_id", *COORDS]


def named(prefix: str, columns: list[str]) -> list[str]:
    """SQL that gives the columns a prefix."""
    return [f"{c} AS {prefix}_{c}" for c in columns]


def axes(vectors: DataFrame, width: float) -> DataFrame:
    """(dataset_id, axes, n): positions of the features that the grid takes, of greatest variance first.

    vectors: (dataset_id, features) of clean rows. Any rows of the same kind may be given (older or repeated ones as
    well), since axes decide the speed and never a result.
    """
    parts = vectors.select("dataset_id", F.posexplode("features").alias("pos", "v"))
    spread = parts.groupBy("dataset_id", "pos").agg(F.var_pop("v").alias("s"), F.count("*").alias("n"))
    best = spread.groupBy("dataset_id").agg(F.max("n").alias("n"), F.expr(f"slice(array_sort(collect_list(struct(-s AS v, pos AS k))), 1, {AXES})").alias("best"))
    # cells that +-2 deviations of the first features span, one number for each number of features
    span = f"greatest(1D, 4 * sqrt(-x.v) / {width}D)"
    few = best.selectExpr("*", f"transform(sequence(1, size(best)), g -> aggregate(slice(best, 1, g), 1D, (a, x) -> a * {span})) AS cells")
    return few.selectExpr("dataset_id", f"transform(slice(best, 1, size(filter(cells, c -> c * {LOAD} < n)) + 1), x -> x.k) AS axes", "n")


def with_cells(rows: DataFrame, axes_: DataFrame, width: float) -> DataFrame:
    """rows (dataset_id, features, ...) plus the coordinates of their cell and `g`, the number of features in use. The
    join is on data sets, of which Catalyst broadcasts the few that there are or splits hot ones."""
    cells = [f"coalesce(CAST(floor(get(features, get(axes, {k})) / {width}D) AS BIGINT), 0) AS {c}" for k, c in enumerate(COORDS)]
    return rows.join(axes_.select("dataset_id", "axes"), "dataset_id").selectExpr(*rows.columns, *cells, "size(axes) AS g")


def touching(cells: DataFrame, extra: list[str], half: bool = True) -> DataFrame:
    """Pairs of counted cells that touch: a_* and b_* of the cell and of the `extra` columns.

    cells: one row per cell, with g. With half, each pair once and no cell with itself; else all ordered pairs and each
    cell with itself. The offsets are the digits of a number to base 3.
    """
    steps = "sequence(CAST((pow(3, g) - 1) / 2 AS INT) + 1, CAST(pow(3, g) AS INT) - 1)" if half else "sequence(0, CAST(pow(3, g) AS INT) - 1)"
    a = cells.where("g > 0").selectExpr(*named("a", [*CELL, *extra]), "g", f"explode({steps}) AS _o")
    # the first feature is the highest digit, so that a half of the numbers is a half of the offsets
    digit = [f"a_{c} + CASE WHEN g > {k} THEN CAST(floor(_o / pow(3, g - 1 - {k})) AS BIGINT) % 3 - 1 ELSE 0 END AS b_{c}" for k, c in enumerate(COORDS)]
    a = a.selectExpr(*(f"a_{c}" for c in [*CELL, *extra]), "a_dataset_id AS b_dataset_id", *digit)
    return a.join(cells.selectExpr(*named("b", [*CELL, *extra])), [f"b_{c}" for c in CELL])


def gap(low: str, high: str, other_low: str, other_high: str) -> str:
    """SQL of the squared distance of two boxes; the four templates name a bound by its feature, as in 'a_lo{k}'."""
    part = lambda k: f"coalesce(greatest(0D, {other_low} - {high}, {low} - {other_high}), 0D)".format(k=k)
    return " + ".join(f"{part(k)} * {part(k)}" for k in range(AXES))


def squared(a: str, b: str, dims: int) -> Column:
    """Squared distance over the first `dims` features, as plain code; features that both lack add nothing."""
    term = lambda k: f"coalesce(get({a}, {k}) - get({b}, {k}), 0D)"
    return F.expr(" + ".join(f"{term(k)} * {term(k)}" for k in range(max(1, dims))))


def distance(a: str, b: str) -> Column:
    """Euclidean distance over all features."""
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))")
