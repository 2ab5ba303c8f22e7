"""Deterministic range partitioning by a key and a hash that tells its rows apart: bounds from a bounded, order-free sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys from which bounds are taken, about so many at least, and so many a range: those whose hash is in a share of all hashes.
SAMPLE, EACH = 20_000, 8

Bounds = list[tuple[int, int]]


def range_bounds(df: DataFrame, key: Column, tie: Column, weight: Column, parts: int) -> Bounds:
    """Pairs of key and tie (longs, never null) that part the table into about equal sums of weight. The sample only says where to cut: every row is dealt. Rows equal in both stay together."""
    keys = df.select(key.alias("k"), tie.alias("t"), weight.cast("bigint").alias("w"))
    share = min(1.0, max(SAMPLE, EACH * parts) / max(1, df.count()))
    picked = keys.where(F.pmod(F.xxhash64("k", "t"), F.lit(1 << 31)) < int(share * (1 << 31))).groupBy("k", "t").agg(F.sum("w").alias("w"))
    found = sorted((r.k, r.t, r.w) for r in picked.collect())
    total, passed, out = sum(w for *_, w in found), 0, set()
    share_of = lambda done: min(parts - 1, done * parts // max(1, total))
    for k, t, w in found:
        # the cut is before the row that goes over a range's share
        if passed and share_of(passed) != share_of(passed + w):
            out.add((k, t))
        passed += w
    return sorted(out)


def range_of(key: Column, tie: Column, bounds: Bounds) -> Column:
    """The number of bounds that are at most (key, tie), found by halving over two constant arrays."""
    if not bounds:
        return F.lit(0)
    ks, ts = (F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>") for v in zip(*bounds, strict=True))
    state = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        k = F.get(ks, mid)
        below = (s["lo"] < s["hi"]) & ((k < key) | ((k == key) & (F.get(ts, mid) <= tie)))
        return F.when(below, state(mid + 1, s["hi"])).otherwise(state(s["lo"], mid))

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, state(F.lit(0), F.lit(len(bounds))), halve)["lo"]
