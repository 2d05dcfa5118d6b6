"""Problem 7: records of several sources combined to target shares of the total size.

Method: a low-discrepancy schedule. Slot k is given to the source in whose stretch of the cumulative shares the point
frac(k * golden ratio) falls, and slots are ranked within their source. Each source's records, in a shuffled order that
is another one in each repetition, are laid out in blocks of equal tokens; slot number r of a source takes its block r.

The total is the largest at which no source needs more than its tokens times its cap. Positions within a source are
running sums over bounded chunks, so a source of any size is spread over many tasks. Sources without tokens are
reported with share 0 and don't limit the others; records of null source or of a source not in the mix are left out;
records without tokens are left out. Shares of a mix are taken relative to their sum.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.running import running_before
from tessella.plans.lineage import cut

BLOCK_TOKENS = 1024
CHUNK_RECORDS = 20_000
CHUNK_SLOTS = 1 << 16
GOLDEN = (math.sqrt(5) - 1) / 2


def schedule(targets: list[tuple[int, str, float, int]], available: dict[str, int], block: int = BLOCK_TOKENS) -> list[dict]:
    """Per mix: number of slots, and of each source its stretch of the shares; from the short list of targets."""
    plans = []
    for mix in sorted({t[0] for t in targets}):
        rows = [(s, w, r) for m, s, w, r in sorted(targets) if m == mix and available.get(s, 0) > 0 and w > 0 and r > 0]
        total = sum(w for _, w, _ in rows)
        if not rows:
            continue
        # a source gets its share of the slots within the sequence's discrepancy, which is taken off beforehand
        most = max(1.0, min(available[s] * r / (w / total) / block for s, w, r in rows))
        off = math.log(most) / 2 + 2
        slots = max(1, int(min(max(1.0, available[s] * r / block - off) / (w / total) for s, w, r in rows)))
        upto, stretches = 0.0, []
        for s, w, r in rows:
            stretches.append((s, upto, 2.0 if s == rows[-1][0] else upto + w / total, r))
            upto += w / total
        plans.append({"mix": mix, "slots": slots, "stretches": stretches})
    return plans


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", block: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_id, slot, source, doc_id, repeat_no, n_tokens): the records of every mix in the order of its slots.

    ``targets`` (mix_id, source, target_share, max_repeats) is a short list.
    """
    spark = sized.sparkSession
    rows = sized.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens")).filter("source is not null and n_tokens > 0")
    wanted = [(int(r[0]), r[1], float(r[2]), int(r[3])) for r in targets.select("mix_id", "source", "target_share", "max_repeats").dropna().distinct().collect()]
    names = sorted({s for _, s, _, _ in wanted})
    rows = cut(rows.filter(F.col("source").isin(names))) if names else cut(rows.filter("false"))
    held = {r[0]: (int(r[1]), int(r[2])) for r in rows.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}
    plans = schedule(wanted, {s: n for s, (n, _) in held.items()}, block)
    empty = "mix_id long, slot long, source string, doc_id long, repeat_no int, n_tokens long"
    if not plans:
        return spark.createDataFrame([], empty)
    # slots: the source each falls to, and its rank among the slots of that source
    slots = None
    for p in plans:
        k = spark.range(p["slots"]).withColumnRenamed("id", "slot").withColumn("mix_id", F.lit(p["mix"]).cast("long"))
        u = F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(1.0))
        of = F.coalesce(*[F.when((u >= a) & (u < b), F.lit(s)) for s, a, b, _ in p["stretches"]])
        part = k.withColumn("source", of)
        slots = part if slots is None else slots.unionByName(part)
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    ranked = running_before(slots, ["mix_id", "source"], "chunk", ["slot"], F.lit(1), "rank").select("mix_id", "slot", "source", "rank")
    # records: each repetition of a source in an order of its own, one behind the other
    most: dict[str, int] = {}
    for p in plans:
        for s, _, _, r in p["stretches"]:
            most[s] = max(most.get(s, 0), r)
    of_source = lambda values: F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in values.items()])
    chunks = {s: max(1, -(-held[s][1] // CHUNK_RECORDS)) for s in most}
    stream = rows.filter(F.col("source").isin(sorted(most))).withColumn("repeat_no", F.explode(F.sequence(F.lit(1), of_source(most))))
    stream = stream.withColumn("at", F.xxhash64("doc_id", "repeat_no"))
    inner = F.floor((F.shiftrightunsigned("at", 1) / F.lit(float(2**63))) * of_source(chunks))  # chunk of the shuffled order
    stream = stream.withColumn("chunk", (F.col("repeat_no") - 1) * of_source(chunks) + F.least(inner, of_source(chunks) - 1))
    laid = running_before(stream, ["source"], "chunk", ["at", "doc_id"], F.col("n_tokens"), "before")
    laid = laid.withColumn("rank", F.floor(F.col("before") / block)).select("source", "rank", "doc_id", "repeat_no", "n_tokens")
    caps = F.coalesce(*[F.when((F.col("mix_id") == p["mix"]) & (F.col("source") == s), F.lit(r)) for p in plans for s, _, _, r in p["stretches"]])
    return ranked.join(laid, ["source", "rank"]).filter(F.col("repeat_no") <= caps).select("mix_id", "slot", "source", "doc_id", "repeat_no", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, tokens, share, records, most_repeats): what every mix came to."""
    per = mixed.groupBy("mix_id", "source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    got = per.groupBy("mix_id", "source").agg(F.sum("t").alias("tokens"), F.sum("k").alias("records"), F.max("k").alias("most_repeats"))
    total = got.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    full = targets.join(got, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return full.select("mix_id", "source", "target_share", "max_repeats", zero("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), zero("records"), zero("most_repeats"))
