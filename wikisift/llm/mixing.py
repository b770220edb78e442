"""Mixing sources to target weights with exact quotas.

Each source gets a share of ``total_percent`` of all words by its weight, but at most
``max_repeats`` times its own words; what is above is shared again by weight among the
others, until nothing is. Full passes over a source are taken whole; for the rest the
source's documents are dealt by a hash into permuted blocks, and blocks are drawn in
order until the target is met, the last one in part (its documents that still fit). So no document is taken more than ``ceil(max_repeats)`` times.

Blocks go to output shards by a multivariate-hypergeometric splitting tree: the exact
number of blocks drawn of each source is split between the two halves of the shards as a
random draw without replacement would, and so on down to single shards. Every shard then
holds disjoint runs of each source's permuted blocks, and its documents are shuffled by a
hash within it.

The only things gathered are sums: per source, per 1024 blocks, per block of one such
run, and the documents of the one block that is drawn in part.

Defined results: null and empty texts have size 0 and are taken with their block; a null
source is a source of its own, the last; a source without words has target 0 and gives
its documents no turn. Rows that agree in id, source and text are taken together. Columns other than those
named are kept or ignored, whatever they are called. Runs over the same rows agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wikisift.llm import ragged
from wikisift.operators.ranking import with_positions
from wikisift.sources.tables import materialize

_SPAN = 1024  # blocks summed up together
_TREE_SOURCES = 4096  # sources whose quotas are split together
_BROADCAST_SOURCES = 2_000
_TWO_64 = float(2**64)


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def with_size(docs: DataFrame, text: str, size: str) -> DataFrame:
    """Add the number of words of each text."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            counts = [np.zeros(0, np.int64)]
            for piece in ragged.pieces(b.column(at)):
                counts.append(np.diff(ragged.words(piece.data, piece.offsets)[2]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(counts).astype(np.int64))], names=[*b.schema.names, size])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(size, LongType())]))


def targets(sources: DataFrame, weights: tuple[int, ...], total_percent: int, max_repeats: int) -> DataFrame:
    """Add ``source_no``, ``weight`` and ``target`` to ``(source, source_size, ...)``, sources in code point order, null last."""
    ordered = with_positions(sources, [F.col("source").asc_nulls_last()], "source_no")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    weighted = materialize(ordered.withColumn("weight", pick), "sources")
    cap = F.col("source_size") * max_repeats
    wanted = (weighted.agg(F.sum("source_size")).first()[0] or 0) * total_percent / 100
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= cap
        r = weighted.agg(
            F.sum(F.when(above, cap).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        if r["full"] == full or not r["open"]:
            break
        level, full = (wanted - r["held"]) / r["open"], r["full"]
    above = F.col("weight") * F.lit(level) >= cap
    return weighted.withColumn("target", F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def _place(blocks: Column, draw: Column) -> Column:
    """The permuted block of a document: its 64-bit draw, scaled to the number of blocks."""
    unit = (draw.cast("double") + F.lit(_TWO_64 / 2)) / F.lit(_TWO_64)
    return F.least(F.floor(unit * blocks), blocks - 1).cast("bigint")


def _cut(sums: DataFrame, place: str) -> DataFrame:
    """Per source, the first ``place`` at which the running sum of ``words`` passes ``rest``, and what is left there."""
    order = Window.partitionBy("source_no").orderBy(place)
    running = sums.withColumn("_before", F.sum("words").over(order) - F.col("words"))
    passed = running.where((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("words") > F.col("rest")))
    return passed.groupBy("source_no").agg(F.min(F.struct(place, (F.col("rest") - F.col("_before")).alias("left"))).alias("_at")).select(
        "source_no", F.col(f"_at.{place}").alias(place), F.col("_at.left").alias("rest")
    )


def _fill(part: pd.DataFrame) -> pd.DataFrame:
    """Documents of the last block of a source, in the order of their draws: each that still fits, and one more if that is nearer."""
    part = part.sort_values("draw")
    left, taken, words = float(part["rest"].iloc[0]), [], part["words"].to_numpy()
    for i, size in enumerate(words):
        if size <= left:
            taken.append(i)
            left -= size
    others = np.setdiff1d(np.arange(len(words)), taken)
    if len(others):
        nearest = others[np.abs(words[others] - left).argmin()]
        if abs(words[nearest] - left) < left:
            taken.append(int(nearest))
    return pd.DataFrame({"source_no": [part["source_no"].iloc[0]], "last_docs": [part["draw"].to_numpy()[sorted(taken)]]})


def _split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns)."""
    if shards == 1:
        return quota[:, None]
    half = shards // 2
    total = int(quota.sum())
    share = total * half // shards
    left = rng.multivariate_hypergeometric(quota, share, method="marginals") if total else quota * 0
    return np.hstack([_split(left, half, rng), _split(quota - left, shards - half, rng)])


def _quotas(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per source, the number of drawn blocks before each shard: the splitting tree, for groups of sources."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("source_no")
        rng = np.random.Generator(np.random.PCG64([seed, int(key[0])]))
        split = _split(part["drawn"].to_numpy(np.int64), shards, rng)
        firsts = np.cumsum(split, axis=1) - split
        return pd.DataFrame({"source_no": part["source_no"].to_numpy(), "shard_starts": list(firsts)})

    grouped = plan.select("source_no", "drawn", F.floor(F.col("source_no") / _TREE_SOURCES).alias("tree")).groupBy("tree")
    return grouped.applyInPandas(run, "source_no bigint, shard_starts array<bigint>")


def plan_sources(
    sized: DataFrame, weights: tuple[int, ...], total_percent: int, max_repeats: int, shards: int, block_docs: int, seed: int,
) -> DataFrame:
    """One row per source: target, full passes, blocks, where the last pass ends, first drawn block of each shard.

    ``sized`` has ``(source, size, draw)`` of every document.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    plan = targets(sources, weights, total_percent, max_repeats)
    plan = plan.withColumn("blocks", F.ceil(F.col("docs") / block_docs))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-plan")
    placed = _with_plan(sized, plan, ["source_no", "blocks", "rest"]).where("rest > 0")
    placed = placed.withColumn("block", _place(F.col("blocks"), F.col("draw"))).withColumn("span", F.floor(F.col("block") / _SPAN))
    sums = placed.groupBy("source_no", "span", "block").agg(F.sum("size").alias("words"), F.min("rest").alias("rest"))
    sums = materialize(sums, "mix-blocks")
    spans = sums.groupBy("source_no", "span").agg(F.sum("words").alias("words"), F.min("rest").alias("rest"))
    span_cut = _cut(spans, "span")
    block_cut = materialize(_cut(sums.drop("rest").join(span_cut, ["source_no", "span"]), "block"), "mix-cut")
    # Only the documents of one block of each source take part from here on.
    ends = placed.drop("rest").join(_hinted(block_cut), ["source_no", "block"])
    ends = ends.groupBy("source_no", "draw").agg(F.sum("size").alias("words"), F.min("rest").alias("rest"))
    inside = ends.groupBy("source_no").applyInPandas(_fill, "source_no bigint, last_docs array<bigint>")
    plan = plan.join(block_cut.select("source_no", F.col("block").alias("last_block")), "source_no", "left")
    plan = materialize(plan.join(inside, "source_no", "left"), "mix-plan")
    drawn = F.col("passes") * F.col("blocks") + F.coalesce(F.col("last_block") + 1, F.lit(0))
    quotas = _quotas(plan.withColumn("drawn", drawn), shards, seed)
    return materialize(plan.join(quotas, "source_no"), "mix-plan")


def _hinted(table: DataFrame) -> DataFrame:
    """Send a table of one row per source to all executors where it is known to be small."""
    return F.broadcast(table) if table.count() <= _BROADCAST_SOURCES else table


def _with_plan(rows: DataFrame, plan: DataFrame, columns: list[str]) -> DataFrame:
    plan = plan.select(F.col("source").alias("_plan_source"), *columns)
    return rows.join(_hinted(plan), rows["source"].eqNullSafe(F.col("_plan_source"))).drop("_plan_source")


def draws(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1),
    total_percent: int = 150, max_repeats: int = 2, shards: int = 16, block_docs: int = 256, seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with a column ``mix`` (source_size, target, size, copies, first blocks), and the plan."""
    size = _fresh("mix_size", docs.columns)
    sized = with_size(docs, text, size)
    draw = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    narrow = sized.select(F.col(source).alias("source"), F.col(size).alias("size"), draw.alias("draw"))
    narrow = materialize(narrow, "mix-sizes")
    plan = plan_sources(narrow, weights, total_percent, max_repeats, shards, block_docs, seed)
    # All own columns stand in one struct each, under names that ``docs`` does not use.
    of, info, hashed = (_fresh(name, sized.columns) for name in ("mix_of", "mix_plan", "mix_draw"))
    plan_columns = ("source_no", "source_size", "target", "passes", "blocks", "last_block", "last_docs", "shard_starts")
    small = plan.select(F.struct("source").alias(of), F.struct(*plan_columns).alias(info))
    rows = sized.withColumns({of: F.struct(F.col(source).alias("source")), hashed: draw})
    rows = rows.join(_hinted(small), of)
    facts, block = F.col(info), _place(F.col(info)["blocks"], F.col(hashed))
    last = (block == facts["last_block"]) & F.array_contains(facts["last_docs"], F.col(hashed))
    copies = facts["passes"] + F.coalesce((block < facts["last_block"]) | last, F.lit(False)).cast("int")
    mix = F.struct(
        F.col(size).alias("size"), facts["source_size"].alias("source_size"), facts["target"].alias("target"), copies.alias("copies"),
        block.alias("block"), facts["blocks"].alias("blocks"), facts["shard_starts"].alias("shard_starts"), F.col(hashed).alias("draw"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], mix.alias(_fresh("mix", docs.columns))), plan


def mixture(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, with ``shard`` and ``place`` (the order within it)."""
    drawn, _ = draws(docs, seed=seed, **options)
    mix = drawn.columns[-1]
    turn, shard, place = (_fresh(n, drawn.columns) for n in ("turn", "shard", "place"))
    rows = drawn.where(F.col(mix)["copies"] > 0).withColumn(turn, F.explode(F.sequence(F.lit(0), F.col(mix)["copies"] - 1)))
    number = F.col(turn) * F.col(mix)["blocks"] + F.col(mix)["block"]
    rows = rows.withColumn(shard, F.size(F.filter(F.col(mix)["shard_starts"], lambda first: first <= number)) - 1)
    rows = rows.withColumn(place, F.xxhash64(F.lit(seed + 1), F.col(shard), F.col(turn), F.col(mix)["draw"]))
    return rows.repartitionByRange(shard, place).sortWithinPartitions(shard, place).drop(mix, turn)


def op2_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    drawn, _ = draws(docs)
    return drawn.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"),
        F.col("mix.copies").alias("copies"), "source",
    )
