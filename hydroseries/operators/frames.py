"""Ordered computations over long series without putting a series into one task.

A plain ``Window.partitionBy(series)`` gathers a whole series in one task, which
fails when one series holds a large part of the rows. Two building blocks avoid
that; every ordered operator of the library is made of them.

* ``halo``  - for frames of bounded reach (k rows, k hours): the series is cut into
  blocks of ``rows`` positions and only the border rows of a block are copied to its
  neighbour. One shuffle, a few percent more rows, block size bounded by design.
* ``scan_series`` - for unbounded reach (previous row, last known value): each chunk is
  scanned on its own, one summary row per chunk carries state over chunk borders. The
  summaries are the only thing windowed per series (one row per chunk).

Both repartition explicitly by series and chunk. Without that the planner would accept
rows that an earlier step left partitioned by series alone, as this also clusters them by
series and chunk, and a whole series would be back in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 4096


def _ordered(order: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def _dealt(df: DataFrame, keys: Sequence[str], chunk: str, tasks: int | None) -> DataFrame:
    """Rows by series and chunk. A given number of ``tasks`` is kept, where adaptive execution would merge them by their size on disk:
    hours of a grid are a few bytes each there, but whole rows in every sort of a task."""
    return df.repartition(tasks, *keys, chunk) if tasks else df.repartition(*keys, chunk)


def scan_series(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    ffill: Mapping[str, Column] | None = None,
    bfill: Mapping[str, Column] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add columns that look along a series, in time order.

    ``prev`` / ``next``: the expression on the row before / after (NULL at the ends).
    ``ffill`` / ``bfill``: its last non-null value at or before / first at or after.
    ``chunk`` must be non-decreasing along ``order``; ``order`` must be free of ties. ``tasks``: see ``_dealt``.
    """
    keys, order = list(keys), list(order)
    df = _dealt(df, keys, chunk, tasks)
    groups = [("p", prev or {}), ("n", next or {}), ("f", ffill or {}), ("b", bfill or {})]
    up = Window.partitionBy(*keys, chunk).orderBy(*_ordered(order))
    down = Window.partitionBy(*keys, chunk).orderBy(*_ordered(order, True))
    rank = F.struct(*order)

    inner: dict[str, Column] = {}
    state: list[Column] = []
    for kind, wanted in groups:
        for name, expr in wanted.items():
            boxed = F.when(expr.isNotNull(), F.struct(expr.alias("v")))
            if kind == "p":
                inner[name] = F.lag(F.struct(expr.alias("v"))).over(up)
                state.append(F.max_by(F.struct(expr.alias("v")), rank).alias(f"_s_{name}"))
            elif kind == "n":
                inner[name] = F.lead(F.struct(expr.alias("v"))).over(up)
                state.append(F.min_by(F.struct(expr.alias("v")), rank).alias(f"_s_{name}"))
            elif kind == "f":
                inner[name] = F.last(boxed, True).over(up.rowsBetween(Window.unboundedPreceding, 0))
                state.append(F.max_by(boxed, F.when(expr.isNotNull(), rank)).alias(f"_s_{name}"))
            else:
                # A descending running "last" is linear; a frame to the end would be quadratic.
                inner[name] = F.last(boxed, True).over(down.rowsBetween(Window.unboundedPreceding, 0))
                state.append(F.min_by(boxed, F.when(expr.isNotNull(), rank)).alias(f"_s_{name}"))

    chunk_up = Window.partitionBy(*keys).orderBy(chunk)
    chunk_down = Window.partitionBy(*keys).orderBy(F.col(chunk).desc())
    before = Window.unboundedPreceding, -1
    carried: list[Column] = []
    for kind, wanted in groups:
        for name in wanted:
            s = F.col(f"_s_{name}")
            c = {
                "p": F.lag(s).over(chunk_up),
                "n": F.lead(s).over(chunk_up),
                "f": F.last(s, True).over(chunk_up.rowsBetween(*before)),
                "b": F.last(s, True).over(chunk_down.rowsBetween(*before)),
            }[kind]
            carried.append(c.alias(f"_c_{name}"))
    summary = df.groupBy(*keys, chunk).agg(*state).select(*keys, chunk, *carried)

    local = df.select("*", *[c.alias(f"_l_{n}") for n, c in inner.items()])
    joined = local.join(summary, [*keys, chunk], "left")
    return joined.select(
        *df.columns, *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))["v"].alias(n) for n in inner]
    )


def with_position(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], out: str = "pos", tasks: int | None = None) -> DataFrame:
    """Zero-based row number along each series: row number in the chunk plus rows of earlier chunks."""
    keys, order = list(keys), list(order)
    df = _dealt(df, keys, chunk, tasks)
    sizes = df.groupBy(*keys, chunk).agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, chunk, F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(*_ordered(order))) - 1
    local = df.select("*", inside.alias("_i"))
    return local.join(sizes, [*keys, chunk], "left").select(*df.columns, (F.col("_base") + F.col("_i")).alias(out))


def halo(
    df: DataFrame, keys: Sequence[str], pos: str, before: int = 0, after: int = 0, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut series into blocks of ``rows`` positions; border rows are repeated next door.

    Adds ``_block`` and ``_home``; compute over ``partitionBy(keys, "_block")`` and
    keep ``_home`` rows (see ``in_blocks``). Frames reaching further than a block are
    served by enlarging the block.
    """
    rows = max(int(rows), int(before), int(after))
    p = F.col(pos)
    home = F.floor(p / F.lit(rows)).cast("long")
    offset = F.pmod(p, F.lit(rows))
    blocks = [home]
    if before:
        blocks.append(F.when(offset >= rows - before, home + 1))
    if after:
        blocks.append(F.when(offset < after, home - 1))
    wide = df.withColumn("_block", F.explode(F.array_compact(F.array(*blocks))))
    return wide.withColumn("_home", F.col("_block") == home).repartition(*keys, "_block")


def in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Mapping[str, "object"],
    before: int = 0,
    after: int = 0,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns of bounded reach. ``columns`` maps a name to ``f(window) -> Column``."""
    wide = halo(df, keys, pos, before, after, rows)
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    out = wide.select("*", *[make(w).alias(name) for name, make in columns.items()])
    return out.where("_home").drop("_block", "_home")


def join_per_key(
    df: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: str | None = None, how: str = "left", salts: int = 32
) -> DataFrame:
    """Join with a table of one or few rows per key (thresholds, statistics).

    Rows of a key are dealt out over ``salts`` partitions by the hash of ``spread`` (default:
    all other columns) and the
    small side is repeated for each, so a key that holds a third of all rows does not end
    in one task. Where the small side is small enough Spark broadcasts it instead.
    """
    by = [spread] if spread else [c for c in df.columns if c not in keys]
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest by ``order``; an aggregate, so copies shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` first rows per key; the filter on the rank lets Spark limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
