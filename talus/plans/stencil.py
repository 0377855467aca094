"""Plans that bring the neighbours of each cell into its row.

``neighbours`` shifts twice: within rows, then the shifted columns within columns. That takes two shuffles (by row and by
column) whatever the size of the window, and every window is bounded by the raster's width or height. A shift looks at the
row before or after and checks its index, so a gap in the cells is a missing neighbour.

``separable`` aggregates square windows with two moving frames, so the work grows with the width of the window, not its area.

``halo_tiles`` copies each cell to the tiles in whose halo it lies, for kernels that need arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, radius: int, z: str = "z") -> DataFrame:
    """row, col and the columns z{i}{j} of a (2 radius + 1) square window."""
    n = 2 * radius + 1
    along, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")

    def shifted(value: str, key: str, k: int, w) -> Column:
        if k == 0:
            return F.col(value)
        move = F.lag if k < 0 else F.lead
        return F.when(move(key, abs(k)).over(w) == F.col(key) + k, move(value, abs(k)).over(w))

    wide = df.select("row", "col", *(shifted(z, "col", j - radius, along).alias(f"_c{j}") for j in range(n)))
    return wide.select("row", "col", *(shifted(f"_c{j}", "row", i - radius, down).alias(f"z{i}{j}") for i in range(n) for j in range(n)))


def separable(df: DataFrame, radius: int, aggregates: dict[str, tuple[Callable[[str], Column], str]]) -> DataFrame:
    """Square-window aggregates of columns: out -> (aggregate, column), with the number of values as ``n`` and z.

    The aggregate must be one that can be taken over rows first: sum, min or max."""
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    first = df.select("*", F.count("z").over(along).alias("_n"), *(f(c).over(along).alias(f"_{out}") for out, (f, c) in aggregates.items()))
    return first.select(*df.columns, F.sum("_n").over(down).alias("n"), *(f(f"_{out}").over(down).alias(out) for out, (f, _) in aggregates.items()))


def halo_tiles(df: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], halo: int, out: list[str], size: int = 256, columns: tuple[str, ...] = ("z",)) -> DataFrame:
    """row, col and the columns out of kernel(array), which gets tiles of at most size + 4 halo cells a side (missing cells are NaN)
    and returns arrays of the same shape. Only cells of the table itself are returned. A tile is the unit of memory."""
    ends = lambda key: F.sequence(F.floor((F.col(key) - halo) / size), F.floor((F.col(key) + halo) / size))
    tiled = df.select("row", "col", *columns, F.explode(ends("row")).alias("tile_row")).select("*", F.explode(ends("col")).alias("tile_col"))
    schema = ", ".join(["row int", "col int", *(f"{c} double" for c in out)])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        own = (row // size == key[0]) & (col // size == key[1])
        # only the part that holds cells, with a rim of missing ones around it
        i, j = row - row.min() + halo, col - col.min() + halo
        shape = (int(i.max()) + halo + 1, int(j.max()) + halo + 1)
        arrays = []
        for c in columns:
            a = np.full(shape, np.nan)
            a[i, j] = pdf[c].to_numpy(float)
            arrays.append(a)
        found = kernel(*arrays)
        return pd.DataFrame({"row": pdf["row"].to_numpy()[own], "col": pdf["col"].to_numpy()[own], **{c: found[c][i[own], j[own]] for c in out}})

    result = tiled.groupBy("tile_row", "tile_col").applyInPandas(run, schema)
    return result.select("row", "col", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in out))
