"""Problem 6: containers of fixed capacity filled with items of varying size.

Method: a grouping genetic algorithm. A gene is a container; crossover injects whole well-filled containers of one
parent into the other, removes the containers that hold an item twice, empties some poorly filled ones, and puts the displaced items
back by best fit. Items are spread by hash over blocks of bounded size; each block is evolved by several islands, rows of their own in
the cluster, each with a population. After each epoch an island gets the elite of its neighbour in place of its worst solution.
Containers left poorly filled are emptied and their items packed again in fewer blocks, so that little is lost between blocks.

An item larger than the capacity is cut into full containers and a rest; no other item is split. Items of size 0 and
null texts (size 0) are placed too. Ties are settled by seeded random numbers, so results repeat.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import cut, stored

BLOCK_ITEMS = 2000
ISLANDS = 3
EPOCHS = 3
POPULATION = 6
#: Crossovers of an island in an epoch.
OFFSPRING = 20
#: Share of a parent's containers that are injected, and of the other's that are emptied.
INJECTED, EMPTIED = 0.15, 0.05
#: Containers filled below this are emptied for the next round.
POOR = 0.97
ROUNDS = 2


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, where: np.ndarray, loads: list[int]) -> None:
    """Put the items of ``order`` each into the fullest container that holds it; ``where`` and ``loads`` are changed."""
    free = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
    size_list = sizes.tolist()
    for i in order.tolist():
        s = size_list[i]
        at = bisect_left(free, (s, -1))
        if at == len(free):
            room, b = capacity, len(loads)
            loads.append(0)
        else:
            room, b = free.pop(at)
        where[i] = b
        loads[b] += s
        if room - s > 0:
            insort(free, (room - s, b))


def fitness(where: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the containers; larger is better."""
    loads = np.bincount(where, sizes)
    return float(np.mean((loads / capacity) ** 2)) if len(loads) else 1.0


def compact(where: np.ndarray) -> np.ndarray:
    return np.unique(where, return_inverse=True)[1].astype(np.int64)


def first_solution(sizes: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    where = np.full(len(sizes), -1, np.int64)
    order = np.argsort(-sizes * (1 + noise * rng.random(len(sizes))), kind="stable")
    best_fit(sizes, order, capacity, where, [])
    return where


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject well-filled containers of ``b`` into ``a``; displaced items go back by best fit."""
    fill = np.bincount(b, sizes)
    good = np.argsort(-fill * (1 + 0.1 * rng.random(len(fill))))[: len(fill) // 2 + 1]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, min(len(good), int(INJECTED * len(fill)))), replace=False)] = True
    injected = chosen[b]
    loads = np.bincount(a, sizes)
    hit = np.zeros(len(loads), bool)
    hit[a[injected]] = True
    hit[np.argsort(loads * (1 + 0.1 * rng.random(len(loads))))[: max(1, int(EMPTIED * len(loads)))]] = True  # mutation
    displaced = hit[a] & ~injected
    where = np.where(injected, b + len(hit), a)
    kept = ~displaced
    where[kept] = compact(where[kept])
    loads = np.bincount(where[kept], sizes[kept]).astype(np.int64).tolist() if kept.any() else []
    items = np.flatnonzero(displaced)
    best_fit(sizes, items[np.argsort(-sizes[items] * (1 + 0.05 * rng.random(len(items))), kind="stable")], capacity, where, loads)
    return where


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], rng: np.random.Generator, offspring: int = OFFSPRING) -> list[np.ndarray]:
    """The population after ``offspring`` crossovers, best first. Parents are the better of two drawn; a child takes the place of the worst if it is better."""
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(population)), reverse=True)
    made = len(scored)
    for _ in range(offspring if len(scored) > 1 else 0):
        i, j = (int(min(rng.choice(len(scored), 2))) for _ in range(2))
        if i == j:
            j = (i + 1) % len(scored)
        child = crossover(scored[i][2], scored[j][2], sizes, capacity, rng)
        f = fitness(child, sizes, capacity)
        if f > scored[-1][0]:
            scored[-1] = (f, made, child)
            made += 1
            scored.sort(reverse=True)
    return [p for _, _, p in scored]


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    return -(-int(sizes.sum()) // capacity)


BLOCK = "spec_id long, capacity long, block long, doc_id binary, part binary, size binary"
STATE = BLOCK + ", island int, population binary, elite binary, score double"


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """One row for all items of a block, in order of their ids; a block is bounded."""
    table = table.sort_by([("doc_id", "ascending"), ("part", "ascending")])
    packed = {c: pa.array([np.array(table.column(c)).astype(t).tobytes()], pa.binary()) for c, t in (("doc_id", np.int64), ("part", np.int32), ("size", np.int32))}
    return pa.table({**{c: pa.array([k.as_py()], pa.int64()) for c, k in zip(("spec_id", "capacity", "block"), key, strict=True)}, **packed})


def _epoch(epoch: int):
    """Evolve every island of a batch; its population may hold the elite of its neighbour in place of its worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["size"], np.int32).astype(np.int64)
                capacity = row["capacity"]
                rng = np.random.default_rng([row["spec_id"], capacity, row["block"], row["island"], epoch])
                if row["population"] is None:
                    population = [first_solution(sizes, capacity, rng, 0.3 * k / POPULATION if k else 0.3 * (row["island"] > 0)) for k in range(POPULATION)]
                else:
                    population = list(np.frombuffer(row["population"], np.int32).reshape(-1, len(sizes)).astype(np.int64))
                if row["elite"] is not None:
                    population[-1] = np.frombuffer(row["elite"], np.int32).astype(np.int64)
                population = [compact(p) for p in evolve(sizes, capacity, population, rng)]
                row |= {"population": np.concatenate(population).astype(np.int32).tobytes(), "elite": population[0].astype(np.int32).tobytes(), "score": fitness(population[0], sizes, capacity)}
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items of solved blocks with their containers and how far these are filled."""
    for batch in batches:
        for row in batch.to_pylist():
            size, bins = np.frombuffer(row["size"], np.int32).astype(np.int64), np.frombuffer(row["elite"], np.int32).astype(np.int64)
            n = len(size)
            of = lambda c: pa.array(np.full(n, row[c], np.int64))  # noqa: B023, E731
            yield pa.record_batch(
                [
                    of("spec_id"), of("capacity"), of("block"), pa.array(np.frombuffer(row["doc_id"], np.int64)), pa.array(np.frombuffer(row["part"], np.int32)),
                    pa.array(size), pa.array(bins), pa.array(np.bincount(bins, size)[bins] / row["capacity"]),
                ],
                ["spec_id", "capacity", "block", "doc_id", "part", "size", "bin", "fill"],
            )


SOLUTION = "spec_id long, capacity long, block long, doc_id long, part int, size long, bin long, fill double"


def _packed(items: DataFrame, blocks: int) -> DataFrame:
    """Items in the containers of the best island of their block."""
    placed = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks)))
    rows = placed.groupBy("spec_id", "capacity", "block").applyInArrow(_block, BLOCK)
    island = ["spec_id", "capacity", "block", "island"]
    none = F.lit(None).cast("binary")
    state = rows.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("population", none).withColumn("elite", none).withColumn("score", F.lit(0.0)).repartition(*island)
    for epoch in range(EPOCHS):
        state = stored(state.mapInArrow(_epoch(epoch), STATE))
        if epoch < EPOCHS - 1:
            moving = state.select("spec_id", "capacity", "block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "elite")
            state = state.drop("elite").join(moving, island).select(*state.columns)
    best = state.groupBy("spec_id", "capacity", "block").agg(F.max_by(F.struct("doc_id", "part", "size", "elite"), F.struct("score", -F.col("island"))).alias("b"))
    return stored(best.select("spec_id", "capacity", "block", "b.*").mapInArrow(_unpacked, SOLUTION))


def pack(sizes: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(spec_id, capacity, bin_id, doc_id, part, size): the container of every item, or of every part of one too large.

    ``specs`` (spec_id, capacity_tokens) is a short list; specs without a positive capacity are left out.
    """
    wanted = [(int(r[0]), int(r[1])) for r in specs.select("spec_id", "capacity_tokens").filter("capacity_tokens > 0").distinct().orderBy("spec_id").collect()]
    if not wanted:
        return sizes.sparkSession.createDataFrame([], "spec_id long, capacity long, bin_id string, doc_id long, part int, size long")
    sizes = cut(sizes.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")))
    spec = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in wanted]))
    rows = sizes.withColumn("s", spec).select("s.spec_id", "s.capacity", "doc_id", "n")
    full = F.floor(F.col("n") / F.col("capacity")).cast("int")
    whole = rows.filter(full > 0).withColumn("part", F.explode(F.sequence(F.lit(0), full - 1))).select("spec_id", "capacity", "doc_id", "part", F.col("capacity").alias("size"))
    whole = whole.select("spec_id", "capacity", F.concat_ws("-", F.lit("d"), "doc_id", "part").alias("bin_id"), "doc_id", "part", "size")
    items = rows.filter((full == 0) | (F.col("n") % F.col("capacity") > 0)).select("spec_id", "capacity", "doc_id", full.alias("part"), (F.col("n") % F.col("capacity")).alias("size"))
    out = [whole]
    count = sizes.count()
    for k in range(ROUNDS):
        solved = _packed(items, max(1, -(-count // BLOCK_ITEMS)))
        last = k == ROUNDS - 1
        done = solved if last else solved.filter(F.col("fill") >= POOR)
        out.append(done.select("spec_id", "capacity", F.concat_ws("-", F.lit(f"r{k}"), "block", "bin").alias("bin_id"), "doc_id", "part", "size"))
        if not last:
            items = cut(solved.filter(F.col("fill") < POOR).select("spec_id", "capacity", "doc_id", "part", "size"))
            count = max((r[1] for r in items.groupBy("spec_id").count().collect()), default=0)
            if not count:
                break
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def report(packed: DataFrame) -> DataFrame:
    """(spec_id, capacity, items, tokens, bins, least_bins, fill) of each capacity; least_bins is no packing's possible number below."""
    bins = packed.groupBy("spec_id", "capacity", "bin_id").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("items"))
    total = bins.groupBy("spec_id", "capacity").agg(F.sum("items").alias("items"), F.sum("load").alias("tokens"), F.count(F.lit(1)).alias("bins"), F.max("load").alias("largest_load"))
    return total.withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))
