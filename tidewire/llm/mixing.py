"""Sources mixed to target shares: exact quotas, dealt to shards by a hypergeometric splitting tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import tokens
from tidewire.runtime import cut

BLOCK_ROWS, MOST_BLOCKS = 256, 65_536  # rows of a block, about; blocks of a source, at most (then blocks grow)
SHARD_ROWS = 50_000


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """How many blocks of each source every shard gets (shards by sources); columns add up to ``quotas`` exactly.

    The shards are halved again and again; each time the left half's share of every source is one multivariate
    hypergeometric draw, so the deal is the same as drawing blocks at random without putting any back.
    """
    random, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), np.int64)

    def deal(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        take = int(counts.sum()) * (middle - low) // (high - low)
        left = random.multivariate_hypergeometric(counts, take, method="marginals") if take else np.zeros_like(counts)
        deal(low, middle, left), deal(middle, high, counts - left)

    deal(0, shards, np.array(quotas, np.int64))
    return out


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pa.array([tokens.count(t, vocabulary) if t else 0 for t in b.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["_key", "_source", "n_tokens"])


def count_tokens(documents: DataFrame, key: str, source: str, text: str, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``_key, _source, n_tokens`` of every row, counted once and kept in the shared folder."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    return cut(documents.select(key, source, text).mapInArrow(lambda it: _count(it, vocabulary), f"_key {kinds[key]}, _source {kinds[source]}, n_tokens long"))


def plan_quotas(available: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, dict]:
    """Tokens each source gives: whole copies of all its rows, and the tokens still wanted from one more copy.

    ``available``: rows and tokens of a source; ``targets``: share and most repeats. Shares of sources without tokens fall to
    the others in proportion. The total is the largest that every source can fill within its repeats, or ``total_tokens`` if that is less.
    """
    usable = {s: (share, cap) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and available.get(s, (0, 0))[1] > 0}
    whole = sum(share for share, _ in usable.values())
    if not whole:
        return {}
    total = min(cap * available[s][1] * whole / share for s, (share, cap) in usable.items())
    if total_tokens is not None:
        total = min(total, total_tokens)
    plan = {}
    for s, (share, cap) in sorted(usable.items()):
        rows, size = available[s]
        quota = total * share / whole
        full = min(cap, math.floor(quota / size + 1e-9))
        plan[s] = {"rows": rows, "tokens": size, "quota": quota, "full": full, "rest": max(0.0, quota - full * size) if full < cap else 0.0}
    return plan


def _fill(placed: DataFrame, plan: dict[str, dict]) -> list[tuple]:
    """Further records that fit into what the prefix of each source leaves, the largest first.

    From every size class (a quarter of a doubling) the first record in the permuted order is looked at: some eighty a source at most.
    """
    spark = placed.sparkSession
    got = {r["_source"]: r["t"] for r in placed.where("_part").groupBy("_source").agg(F.sum("n_tokens").alias("t")).collect()}
    left = {s: p["rest"] - got.get(s, 0) for s, p in plan.items()}
    room = spark.createDataFrame(list(left.items()), "_source string, _left double")
    fitting = placed.join(F.broadcast(room), "_source").where("not _part and n_tokens <= _left")
    best = fitting.groupBy("_source", F.floor(F.log2("n_tokens") * 4).alias("class")).agg(F.min(F.struct("_chance", "_key", "n_tokens")).alias("r"))
    picks = []
    for r in sorted(best.select("_source", "r.*").collect(), key=lambda r: (r["_source"], -r["n_tokens"])):
        if r["n_tokens"] <= left[r["_source"]]:
            left[r["_source"]] -= r["n_tokens"]
            picks.append((r["_source"], r["_key"], r["_chance"], r["n_tokens"]))
    return picks


def mix_sources(documents: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", total_tokens: int | None = None, shards: int | None = None, seed: int = 17, vocabulary: str = tokens.VOCABULARY, counted: DataFrame | None = None) -> DataFrame:
    """``key, source, copy_no, n_tokens, shard, place``: the rows chosen, a row for each use, in shards of about SHARD_ROWS rows.

    Every source of ``targets`` (``source, target_share, max_repeats``: a small table, one row a source) gives its share of all tokens
    as nearly as its records' sizes let it, and not more; a record is used ``max_repeats`` times at most. Sources without rows can't give any: the others keep
    their proportions. Rows of other or null sources are not used, nor are null or empty texts (they have no tokens). Repeated keys are
    rows of their own. The choice depends on ``seed`` and the keys only.

    A source is permuted by a hash and divided into blocks by it; whole copies take all blocks, the last partial copy a prefix
    found by block totals, so that no task holds a source, and a few records that fill what the prefix leaves. Blocks are then dealt to shards by :func:`splitting_tree`.
    """
    spark = documents.sparkSession
    counted = count_tokens(documents, key, source, text, vocabulary) if counted is None else counted
    counted = counted.where(F.col("n_tokens") > 0)
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.dropna(subset=["source", "target_share", "max_repeats"]).collect()}
    stats = counted.where(F.col("_source").isin(list(wanted))).groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()
    plan = plan_quotas({r["_source"]: (r["n"], r["t"]) for r in stats}, wanted, total_tokens)
    kinds = dict(counted.dtypes)
    if not plan:
        return spark.createDataFrame([], f"`{key}` {kinds['_key']}, `{source}` {kinds['_source']}, copy_no int, n_tokens long, shard int, place int")
    names = list(plan)
    blocks = {s: min(MOST_BLOCKS, -(-p["rows"] // BLOCK_ROWS)) for s, p in plan.items()}
    config = spark.createDataFrame([(s, blocks[s], p["full"], float(p["rest"])) for s, p in plan.items()], "_source string, _blocks long, _full int, _rest double")
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_key"), 11)).cast("double") / float(1 << 53)
    rows = counted.join(F.broadcast(config), "_source").withColumn("_chance", chance).withColumn("_block", F.floor(F.col("_chance") * F.col("_blocks")).cast("long"))
    totals = rows.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_source", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_source", "_block").orderBy("_chance", "_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["_source", "_block"]).withColumn("_part", F.col("_offset") + F.col("_in") + F.col("n_tokens") <= F.col("_rest")))
    extra = spark.createDataFrame(_fill(placed, plan), placed.select("_source", "_key", "_chance", "n_tokens").schema).withColumn("_extra", F.lit(1))
    placed = placed.join(F.broadcast(extra), ["_source", "_key", "_chance", "n_tokens"], "left")
    copies = F.col("_full") + (F.col("_part") | F.col("_extra").isNotNull()).cast("int")
    chosen = placed.withColumn("_copies", copies).where("_copies > 0")
    chosen = cut(chosen.select("_key", "_source", "n_tokens", "_block", F.explode(F.sequence(F.lit(1), "_copies")).alias("copy_no")))
    # units are the blocks that have rows, for each copy; a source has copies x MOST_BLOCKS of them at most, in an order given by a hash
    mixed = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed + 2), "copy_no", "_block"), "copy_no", "_block")
    units = cut(chosen.groupBy("_source", "copy_no", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_unit", F.row_number().over(mixed) - 1))
    sizes = {r["_source"]: (r["u"], r["n"]) for r in units.groupBy("_source").agg(F.count(F.lit(1)).alias("u"), F.sum("_n").alias("n")).collect()}
    shards = shards or max(8, -(-sum(n for _, n in sizes.values()) // SHARD_ROWS))
    names = [s for s in names if s in sizes]
    upto = splitting_tree([sizes[s][0] for s in names], shards, seed).cumsum(axis=0)
    deal = pd.DataFrame({"_source": np.repeat(names, shards), "shard": np.tile(np.arange(shards, dtype=np.int32), len(names)), "_to": upto.T.ravel(), "_from": np.vstack([np.zeros((1, len(names)), np.int64), upto[:-1]]).T.ravel()})
    deal = spark.createDataFrame(deal[deal["_to"] > deal["_from"]], "_source string, shard int, _to long, _from long")  # a row for each shard and source
    deal = deal.select("_source", "shard", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_unit"))
    dealt = chosen.join(units.join(deal, ["_source", "_unit"]).select("_source", "copy_no", "_block", "shard"), ["_source", "copy_no", "_block"])
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "_key", "copy_no"), "_key", "copy_no", "n_tokens")
    return dealt.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("copy_no").cast("int").alias("copy_no"), "n_tokens", "shard", F.row_number().over(local).alias("place"))


def reached_shares(mixed: DataFrame, targets: DataFrame, counted: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """``source, target_share, max_repeats, available_tokens, tokens, share, records, most_used`` for every source of either table (null included)."""
    used = mixed.groupBy(F.col(source).alias("s")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copy_no").alias("most_used"))
    used = cut(used)  # a row a source
    total = used.agg(F.sum("tokens")).first()[0] or 0
    there = counted.groupBy(F.col("_source").alias("s")).agg(F.sum("n_tokens").alias("available_tokens"))
    asked = targets.groupBy(F.col("source").alias("s")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = there.join(asked, there.s.eqNullSafe(asked.s), "full").select(F.coalesce(there.s, asked.s).alias("source"), "target_share", "max_repeats", "available_tokens")
    rows = rows.join(used, rows.source == used.s, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("max_repeats").alias("max_repeats"), zero("available_tokens").alias("available_tokens"), zero("tokens").alias("tokens"), (zero("tokens") / F.lit(max(1, total))).alias("share"), zero("records").alias("records"), zero("most_used").alias("most_used"))
