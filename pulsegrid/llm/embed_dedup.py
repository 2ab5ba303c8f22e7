"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a random product code: a vector's halves are scored against one small set of random unit
vectors each, and a filter is a pair of them, its score their sum. A vector is listed under every filter whose
score exceeds a threshold, which sorting one half's scores finds without looking at all pairs. What is joined on
filters is an id and a sketch of 32 bytes; only rows whose sketch is near another one's under that filter fetch
their vectors and are verified by a blocked matrix product in double precision.

One code finds fewer of the pairs at a given cosine the more vectors there are, and longer lists under it help
little: its filters are not independent. So larger tables get several codes, drawn independently.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import lean
from .components import components
from .workspace import Workspace

#: Filters of a code that a vector exceeds on average, at least, and vectors under a filter on average.
LISTS, LEAST, OCCUPANCY = 20, 10, 256
#: Vectors of a block; a fuller filter is dealt to several blocks, all pairs of which are multiplied.
BLOCK = 1024
#: One code serves up to so many code words per half; each further code, GROWTH times as many, or LOW_GROWTH under so many dimensions.
ONE_CODE, GROWTH, FULL_DIM, LOW_GROWTH = 100, 7, 64, 3
SEED = 7
#: Bits of a sketch, and how many standard deviations over the mean a pair at the threshold may differ: three in 100,000 differ more.
BITS, SLACK = 256, 4.0
#: Filters that a block's pairs are compared by at first; then four times as many, up to 64 times.
COLUMNS = 64


def codes(dim: int, c: int, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """c random unit vectors for each half of `dim` dimensions, the same everywhere; another number, another code."""
    rng = np.random.default_rng([SEED, dim, c, number] if number else [SEED, dim, c])
    out = []
    for d in ((dim + 1) // 2, dim - (dim + 1) // 2):
        u = rng.standard_normal((c, max(d, 1)))[:, :d] if d else np.zeros((c, 0))
        out.append(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300))
    return out[0], out[1]


def code_size(n: int, dim: int) -> int:
    """Code words per half for n vectors of `dim` dimensions.

    At most 2 to the power of half the dimensions: finer caps would be narrower than the angle of a pair and part it. So
    with few dimensions filters grow with n, as links themselves do, until all blocks meet.
    """
    wanted = math.ceil(math.sqrt(LISTS * n / OCCUPANCY))
    return max(8, min(wanted, math.floor(2 ** min(dim / 2, 60))))


def code_count(c: int, dim: int) -> int:
    """Independent codes of c code words per half: as many as keep recall at cosine 0.9 over 0.95 (the README has figures)."""
    count, most = 1, ONE_CODE
    while c > most:
        count, most = count + 1, most * (GROWTH if dim >= FULL_DIM else LOW_GROWTH)
    return count


def decode(units: np.ndarray, c: int) -> list[np.ndarray]:
    """The filters of each vector, ascending: of every code all whose score exceeds the threshold, and its LEAST best at least."""
    found = [_decode(units, c, number) for number in range(code_count(c, units.shape[1]))]
    return [np.concatenate([x + number * c**2 for number, x in enumerate(lists)]) for lists in zip(*found, strict=True)]


def _decode(units: np.ndarray, c: int, number: int) -> list[np.ndarray]:
    dim = units.shape[1]
    left, right = codes(dim, c, number)
    cut = (dim + 1) // 2
    # two unit directions side by side have length sqrt(2)
    threshold = NormalDist().inv_cdf(1 - min(0.5, LISTS / c**2)) * math.sqrt(2 / dim)
    a, b = units[:, :cut] @ left.T, units[:, cut:] @ right.T
    order = np.argsort(b, axis=1)
    out = []
    for k in range(len(units)):
        ascending = b[k][order[k]]
        count = c - np.searchsorted(ascending, threshold - a[k])
        rows = np.flatnonzero(count)
        if count.sum() < LEAST:
            top_a, top_b = np.argsort(-a[k])[:LEAST], order[k][::-1][:LEAST]
            sums = (a[k][top_a][:, None] + b[k][top_b][None, :]).ravel()
            best = np.argsort(-sums)[:LEAST]
            found = top_a[best // len(top_b)] * c + top_b[best % len(top_b)]
        else:
            found = np.concatenate([i * c + order[k][c - count[i] :] for i in rows])
        out.append(np.sort(found).astype(np.int64))
    return out


def sketch(units: np.ndarray) -> np.ndarray:
    """On which sides of BITS random hyperplanes each vector lies, as unsigned 64-bit integers."""
    dim = units.shape[1]
    planes = np.random.default_rng([SEED, dim, BITS, 1]).standard_normal((dim, BITS))
    return np.packbits(units @ planes > 0, axis=1).view(np.uint64)


def sketch_limit(threshold: float) -> int:
    """The most bits in which the sketches of two vectors of this cosine differ, but for the few that SLACK tells."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(BITS * p + SLACK * math.sqrt(BITS * p * (1 - p)))


def _first_here(lists: list[np.ndarray], linked: np.ndarray, now: int) -> np.ndarray:
    """Of linked pairs (a symmetric matrix) those that share no filter before `now`: a pair is counted under its first one. Products of 0/1 matrices of vectors by earlier filters, the commonest first, so many near copies cost little more than a block's product."""
    cut = [x[x < now] for x in lists]
    owner = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
    _, column, times = np.unique(np.concatenate(cut) if cut else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    place = np.empty(len(times), np.int64)
    place[np.argsort(-times, kind="stable")] = np.arange(len(times))
    column, shared = place[column], int((times > 1).sum())
    out, lo, width = linked.copy(), 0, COLUMNS
    while lo < shared and len(left := np.flatnonzero(out.any(axis=1))):
        to = np.full(len(cut), -1)
        to[left] = np.arange(len(left))
        some = (column >= lo) & (column < min(shared, lo + width)) & (to[owner] >= 0)
        has = np.zeros((len(left), width), np.float32)
        has[to[owner[some]], column[some] - lo] = 1
        out[np.ix_(left, left)] &= has @ has.T == 0
        lo, width = lo + width, min(4 * width, 64 * COLUMNS)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (least id reachable, itself included), kept (id is component_id).

    Rows link if found together and their cosine, in double precision, is at least `threshold`. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths
    don't meet. Equal vectors are one class: it is listed once, with its number of rows. Repeated ids are rows
    of their own; a null id is never the least one. Other columns are ignored. An empty table gives no rows.

    A filter's rows never meet in one task beyond BLOCK: fuller filters are dealt to pairs of blocks. Blocks
    give a row per linked vector, with its number of links and the least vector it reaches, never pairs. A pair
    under several filters counts at the first.

    Rows that travel: sketches once per filter, then, of rows with a near sketch, vectors once per such filter.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "embed-dedup")
    kind = vectors.schema[id_col].dataType.simpleString()
    values = F.transform(F.col(vec_col), lambda x: x.cast("double"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entity, dim, data = [], [], []
            for v in batch.column(1):
                x = np.array([np.nan if y is None else y for y in v.as_py() or []], np.float64)
                scale = np.abs(x).max() if len(x) else 0.0
                good = bool(len(x)) and bool(np.isfinite(x).all()) and scale > 0
                if good:
                    x = x / scale
                    x = x / np.sqrt(x @ x)
                entity.append(xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) if good else None)
                dim.append(len(x))
                data.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entity, pa.int64()), pa.array(dim, pa.int32()), pa.array(data, pa.binary())], ["id", "entity", "dim", "unit"])

    rows = ws.save(vectors.select(F.col(id_col).alias("id"), values.alias("v")).mapInArrow(lean(unit), f"id {kind}, entity bigint, dim int, unit binary"), "rows")
    classes = ws.save(rows.where("entity IS NOT NULL").groupBy("entity").agg(F.count("*").alias("rows"), F.min("unit").alias("unit")), "classes")
    n = classes.count()

    most, parts = sketch_limit(threshold), [f"s{k}" for k in range(BITS // 64)]

    def enlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                units = part.column(1).to_pylist()
                size = np.array([len(u) for u in units])
                for width in np.unique(size):
                    which = np.flatnonzero(size == width)
                    x = np.frombuffer(b"".join(units[i] for i in which), np.float64).reshape(len(which), -1)
                    lists, bits = decode(x, code_size(n, width // 8)), sketch(x)
                    again = np.repeat(np.arange(len(which)), [len(x) for x in lists])
                    out = [np.concatenate(lists), np.full(len(again), width // 8, np.int32), part.column(0).to_numpy()[which][again], *bits[again].view(np.int64).T]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["filter", "dim", "entity", *parts])

    def dealt(listed: DataFrame) -> DataFrame:
        full = listed.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.expr(f"cast((n - 1) div {block} + 1 as int)")).drop("n")
        both = listed.join(full, ["dim", "filter"]).withColumn("own", F.pmod(F.xxhash64("entity"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return both.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("parts", "other")

    def screen(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        bits = np.stack([table.column(k).to_numpy().view(np.uint64) for k in parts], axis=1)
        near = sum(np.bitwise_count(v[:, None] ^ v[None, :]).astype(np.int16) for v in bits.T) <= most
        np.fill_diagonal(near, False)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            near &= own[:, None] != own[None, :]
        return table.select(["dim", "filter", "entity"]).filter(pa.array(near.any(axis=1)))

    listed = ws.save(classes.select("entity", "unit").mapInArrow(lean(enlist), ", ".join(["filter bigint, dim int, entity bigint", *[f"{x} bigint" for x in parts]])), "listed")
    active = dealt(listed).groupBy("dim", "filter", "i", "j").applyInArrow(screen, "dim int, filter bigint, entity bigint")
    active = ws.save(active.distinct(), "active")
    # a pair's common filters are active for both, so these lists tell its first one
    whole = active.groupBy("entity").agg(F.array_sort(F.collect_list("filter")).alias("filters")).join(classes, "entity")
    both = dealt(active).join(whole, "entity")

    def multiply(table: pa.Table) -> pa.Table:
        entity, weight = table.column("entity").to_numpy(), table.column("rows").to_numpy()
        i, j, now = (table.column(x)[0].as_py() for x in ("i", "j", "filter"))
        own = table.column("own").to_numpy()
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(entity), -1)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        linked &= (own[:, None] != own[None, :]) | (i == j)
        if not linked.any():
            return pa.table({"entity": entity[:0], "links": weight[:0], "root": entity[:0]})
        new = _first_here([np.array(f, np.int64) for f in table.column("filters").to_pylist()], linked, now)
        links = np.array([weight[row].sum() for row in new])
        root = entity.copy()
        some = np.flatnonzero(linked.any(axis=1))
        near = linked[np.ix_(some, some)] | np.eye(len(some), dtype=bool)
        while True:
            least = np.where(near, root[some][None, :], np.iinfo(np.int64).max).min(axis=1)
            if (least == root[some]).all():
                break
            root[some] = least
        return pa.table({"entity": entity[some], "links": links[some].astype(np.int64), "root": root[some]})

    found = ws.save(both.groupBy("dim", "filter", "i", "j").applyInArrow(multiply, "entity bigint, links bigint, root bigint"), "found")
    links = found.groupBy("entity").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("entity").alias("a"), F.col("root").alias("b")), ws).select(F.col("id").alias("entity"), "root")
    per_class = classes.select("entity", "rows").join(links, "entity", "left").join(roots, "entity", "left")
    per_class = per_class.select("entity", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n"), F.coalesce("root", "entity").alias("label"))
    named = rows.select("id", "entity").join(per_class, "entity", "left")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component"))
    out = named.join(least, "label", "left").withColumn("component_id", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
