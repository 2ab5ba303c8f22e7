"""Mixing sources to target weights by systematic sampling.

Each source's documents stand in a fixed order; their expected copies are summed up along it from one random
offset, and a document is emitted once per integer that its step crosses. The order goes by length first, so
equal steps take an even share of every length and the words taken come near the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: A document's words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of one source and length class are ordered in independent parts, by a hash of their id: this many at least.
PARTS = 16

_S, _C, _P, _N, _R, _T, _W = (f"__mix_{x}" for x in ("source", "class", "part", "size", "rate", "target", "source_size"))


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, budget: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """Targets of sources: their share of `budget` times all words, by weight, none above `most` times its own words.

    `sizes` has a row per source, which is what its single-task windows read. Sources ascend by code point,
    null last, and weigh by `weights`, repeating. What is cut off goes to the others by weight until none is
    above: sources are filled in order of their limit over their weight, and one is at its limit if sharing
    the rest among it and all after it would exceed that limit.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(table, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("top", F.col(size) * F.lit(float(most)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = [(F.col("top") / F.col("w")).asc(), F.col(source).asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum(size).over(every) * F.lit(float(budget)) - F.coalesce(F.sum("top").over(before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("w").over(after))
    # the first source that isn't at its limit fixes the level of all after it
    s = s.withColumn("free", F.col("level") * F.col("w") < F.col("top"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return s.select(source, size, F.least(F.col("top"), F.coalesce(level * F.col("w"), F.col("top"))).alias("target"))


def part_count(rows: int) -> int:
    """Parts for a table of so many rows. As their root, so both what is sorted in a part and the parts that are summed up along a source stay small."""
    return max(PARTS, math.ceil(math.sqrt(rows) / 4))


def hash32(text: Column) -> Column:
    """An even integer hash that other engines have too: the first eight hex digits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str, budget: float, most: float, weights: tuple, seed: str) -> DataFrame:
    """The columns of docs, and those named above and __mix_copies."""
    n, parts = F.col(_N), part_count(docs.count())
    digits = F.length(n.cast("string"))
    d = docs.withColumn(_N, words(F.col(text_col)))
    # length class: the number of digits, then the first digit
    d = d.withColumns({_C: (digits * 10 + F.substring(n.cast("string"), 1, 1).cast("int")).cast("int"), _P: F.pmod(hash32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts)).cast("int"), _S: F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))})
    # a small table, written because it is read twice and texts are long to read
    cells = Workspace(docs.sparkSession, "mixing").save(d.groupBy(_S, _C, _P).agg(F.count("*").alias("__mix_rows"), F.sum(_N).alias("__mix_words")), "cells")
    sources = cells.groupBy(_S).agg(F.sum("__mix_words").alias(_W)).select(F.when(~F.col(_S)["none"], F.col(_S)["name"]).alias("s"), F.col(_W))
    goal = targets(sources, "s", _W, budget, most, weights).select(F.struct(F.col("s").isNull().alias("none"), F.coalesce("s", F.lit("")).alias("name")).alias(_S), _W, F.col("target").alias(_T))
    along = Window.partitionBy(_S).orderBy(_C, _P).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__mix_before", F.coalesce(F.sum("__mix_rows").over(along), F.lit(0))).join(goal, _S).drop("__mix_rows", "__mix_words")
    rank = F.row_number().over(Window.partitionBy(_S, _C, _P).orderBy(_N, id_col, F.xxhash64(text_col)))
    d = d.withColumn("__mix_rank", rank).join(cells, [_S, _C, _P])
    offset = hash32(F.concat(F.lit(f"{seed}|"), F.col(_S)["name"], F.lit("|"), F.col(_S)["none"].cast("string"))) / F.lit(2.0**32)
    rate = F.coalesce(F.try_divide(F.col(_T), F.col(_W).cast("double")), F.lit(0.0))
    at = F.col("__mix_before") + F.col("__mix_rank")
    return d.withColumn("__mix_copies", (F.floor(offset + rate * at) - F.floor(offset + rate * (at - 1))).cast("long"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """All rows of docs with their columns and size, source_size, target, copies and taken (copies times size).

    Expected copies of a document are its source's target over its source's words, at most `most`; so its
    copies are that number rounded down or up. A source without words has target 0 and gives no copies. A
    null text has no words, null sources form one source, ids may repeat or be null (rows are then told
    apart by a hash of their text). The offset is a hash of seed and source: reruns agree. Added columns replace
    columns of their names.

    One row never waits for all of its source: rows are ranked within (source, length class, hash part), and
    the parts' row counts, part_count(rows) times some hundred per source at most, are summed up along the source.
    """
    d = _counted(docs, id_col, text_col, source_col, budget, most, weights, seed)
    added = {"size": F.col(_N), "source_size": F.col(_W), "target": F.col(_T), "copies": F.col("__mix_copies"), "taken": F.col("__mix_copies") * F.col(_N)}
    return d.select(*[c for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each row of docs as often as copies() says, with the columns of docs unchanged."""
    d = _counted(docs, id_col, text_col, source_col, budget, most, weights, seed).where("__mix_copies > 0")
    return d.withColumn("__mix_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*docs.columns)
