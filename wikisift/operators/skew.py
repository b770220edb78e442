"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikisift.sources.tables import materialize

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
ROWS_PER_SPLIT = 100_000
PAIRS_PER_TASK = 20_000_000
BLOCK_TASKS = 10_000


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Check with a bounded job whether ``df`` is small enough to be broadcast."""
    strings = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.typeName() == "string"]
    width = sum((F.coalesce(s, F.lit(0)) for s in strings), F.lit(8 * len(df.columns)))
    found = (
        df.select(width.cast("bigint").alias("w"))
        .limit(rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("b"))
        .first()
    )
    return found["n"] <= rows and (found["b"] or 0) <= size


def join_lookup(
    big: DataFrame, small: DataFrame, keys: list[str], spread_by: str, fits: bool, salts: int = 32
) -> DataFrame:
    """Inner join of a large table, skewed on ``keys``, with a lookup side.

    The lookup side is broadcast when it was found to fit. Otherwise it is repeated
    ``salts`` times and the large side is salted by ``spread_by``, so the rows of one
    key go to ``salts`` tasks. The hint keeps Spark from broadcasting these copies, whose
    size it takes to be that of the lookup side's files.
    """
    if fits:
        return big.join(F.broadcast(small), keys)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return salted.join(copies.hint("merge"), [*keys, "_salt"]).drop("_salt")


def _grid(left: Column, right: Column, rows_per_split: int, pairs_per_task: int) -> tuple[Column, Column]:
    """Splits of either side of a key: no split has more than its rows, and no pair of splits more than its pairs."""
    n = [F.greatest(F.coalesce(side, F.lit(0)), F.lit(1)).cast("double") for side in (left, right)]
    splits = [F.ceil(side / rows_per_split) for side in n]
    pairs = n[0] / splits[0] * n[1] / splits[1]
    finer = F.sqrt(F.greatest(pairs / pairs_per_task, F.lit(1.0)))
    # A side that is already cut into single rows leaves the rest to the other one.
    first = F.least(F.ceil(splits[0] * finer), n[0])
    rest = F.greatest(n[0] / first * n[1] / splits[1] / pairs_per_task, F.lit(1.0))
    second = F.least(F.ceil(splits[1] * rest), n[1])
    return first.cast("int"), second.cast("int")


def full_outer_join(
    left: DataFrame, right: DataFrame, key: str, rows_per_split: int = ROWS_PER_SPLIT, pairs_per_task: int = PAIRS_PER_TASK
) -> DataFrame:
    """Full outer equi-join on ``key`` that splits frequent keys on either side.

    Spark's own skew handling does not cover full outer joins. Without a key of more
    than ``rows_per_split`` rows or ``pairs_per_task`` pairs this is the plain join.
    Otherwise the pairs of a frequent key are a grid: both sides are cut into splits by
    their measured counts, and a cell of the grid, which is what meets at a time, has no
    more than that many pairs. Every pair is in exactly one cell. A split is one packed
    row, and what is shuffled are blocks of splits: a split is repeated once for each
    block of the other side, and blocks have up to ``PAIRS_PER_TASK`` pairs, however small
    the cells are. A pack has an array for each column, so columns that nobody reads are
    not packed. The rows of packs that meet are unpacked at the end, after all other rows have
    joined them as packs of one: a reader that counts or sums takes its pairs from the loop that
    makes them. Rows whose frequent key the other side lacks are passed on. Other keys are
    not repeated.

    Columns of the two sides must have different names, but for ``key``. The table of
    frequent keys has at most rows / sqrt(pairs_per_task) entries per side. It is written
    first, so Spark knows its size and broadcasts it only below its own threshold.
    """
    sides = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    frequent = (
        sides.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum("l").alias("_n_left"), F.sum("r").alias("_n_right"))
        .where((F.greatest("_n_left", "_n_right") > rows_per_split) | (F.col("_n_left").cast("double") * F.col("_n_right") > pairs_per_task))
        .select(
            F.col(key),
            ((F.col("_n_left") > 0) & (F.col("_n_right") > 0)).alias("_both"),
            *(
                c.alias(f"_{side}_{name}")
                for name, limits in (("splits", (rows_per_split, pairs_per_task)), ("blocks", (max(rows_per_split, ROWS_PER_SPLIT), max(pairs_per_task, PAIRS_PER_TASK))))
                for side, c in zip(("left", "right"), _grid(F.col("_n_left"), F.col("_n_right"), *limits))
            ),
        )
    )
    frequent = materialize(frequent, "frequent-keys")
    blocks = F.when(F.col("_both"), F.col("_left_blocks").cast("bigint") * F.col("_right_blocks")).otherwise(0)
    found = frequent.agg(F.count(F.lit(1)).alias("keys"), F.sum(blocks).alias("blocks")).first()
    if not found.keys:
        return left.join(right, key, "full_outer")

    # Row numbers spread rows evenly over splits; they are stored, so a retried task sees the same.
    rows = [materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered") for df in (left, right)]
    others = [[c for c in df.columns if c != key] for df in (left, right)]
    sides = ("left", "right")

    def single(df: DataFrame, names: list[str], side: str) -> DataFrame:
        return df.select(key, F.array("_row").alias(f"_{side}_rows"), *(F.array(c).alias(c) for c in names))

    plain = [single(r.join(frequent, key, "left_anti"), names, side) for r, names, side in zip(rows, others, sides)]
    packs = [packed(r, frequent, key, *names) for r, names in zip(rows, (sides, sides[::-1]))]
    # Packs are few bytes for many pairs; Spark, which sees bytes, would merge their tasks.
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * found.blocks, BLOCK_TASKS))
    packs = [p.repartition(tasks, key, "_left_block", "_right_block") for p in packs]
    pairs = packs[0].join(packs[1].hint("merge"), [key, "_left_block", "_right_block"]).drop("_left_block", "_right_block")
    alone = [single(r.join(frequent.where(~F.col("_both")), key), names, side) for r, names, side in zip(rows, others, sides)]
    lots = plain[0].join(plain[1], key, "full_outer").unionByName(pairs).unionByName(alone[0], True).unionByName(alone[1], True)
    # The last step of all, so what reads the pairs does so in the loop that makes them, and no pair is ever a row on its own.
    first = lots.select("*", F.posexplode_outer("_left_rows").alias("_at", "_row"))
    first = first.select(key, *(F.get(c, F.col("_at")).alias(c) for c in others[0]), "_right_rows", *others[1])
    second = first.select("*", F.posexplode_outer("_right_rows").alias("_at", "_row"))
    return second.select(key, *others[0], *(F.get(c, F.col("_at")).alias(c) for c in others[1]))


def packed(rows: DataFrame, frequent: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """``(key, blocks of either side, numbers of the rows, columns)``: each split of the frequent keys of one side, once for each block of the other.

    A column is an array of its own, so Spark leaves out those that nobody reads.
    """
    names = [c for c in rows.columns if c not in (key, "_row")]
    mine = rows.join(frequent.where("_both"), key).withColumn("_split", F.pmod("_row", F.col(f"_{own}_splits")).cast("int"))
    # In a struct, as lists leave out nulls.
    lists = [F.collect_list(F.struct(c)).alias(c) for c in names]
    packs = mine.groupBy(key, "_split", f"_{own}_blocks", f"_{other}_blocks").agg(F.collect_list("_row").alias(f"_{own}_rows"), *lists)
    return packs.select(
        key, F.pmod("_split", F.col(f"_{own}_blocks")).alias(f"_{own}_block"), f"_{own}_rows",
        *(F.col(c).getField(c).alias(c) for c in names),
        F.explode(F.sequence(F.lit(0), F.col(f"_{other}_blocks") - 1)).alias(f"_{other}_block"),
    )
