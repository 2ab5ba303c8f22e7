"""Source divergence audit: how far the sources of a language differ in their terms, and which terms tell each source.

Terms are dealt into shards by a hash of language and term. Each shard is a DuckDB database in memory that
sums counts and adds its part of every pair's distance by SQL; Spark merges the sums and ranks them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import lean, raw, slices
from .workspace import Workspace

#: Documents of its language that a term needs, what is added to each count, the unit of a share, and terms told per source.
MIN_DOCS, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text a shard: some five million words, whose counts by language, source and term a task can hold.
SHARD_BYTES = 32 << 20
#: Counts that a task gathers before it adds up equal ones, and hands on what are still more than half as many.
GATHERED = 400_000

_LETTER = np.ones(256, bool)
_LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_KEPT = "lang string, source string, term string, n bigint, total bigint"


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of letters and of characters beyond ASCII, A-Z in lower case, and the row that each is in. In UTF-8 the other characters are bytes of their own, so the rule on bytes is the rule on characters."""
    data, off = raw(column)
    inside = _LETTER[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    begin[edge] = inside[edge]
    start = np.flatnonzero(begin)
    # where a term starts among the letters alone is where the one before ends
    ends = np.append((np.cumsum(inside) - 1)[start], inside.sum()).astype(np.int64)
    letters = _LOWER[data[inside]]
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return found, np.searchsorted(off, start, side="right") - 1


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """A slice's counts of occurrences and of documents by language, source and term."""
    found, row = terms(batch.column("text"))
    coded = found.dictionary_encode()
    term, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
    key, n = np.unique(row * size + term, return_counts=True)
    key, back = np.unique(group[key // size] * size + key % size, return_inverse=True)
    lang_of, source_of = np.divmod(key // size, max(1, len(source.dictionary)))
    total, docs = (np.bincount(back, weights, len(key)).astype(np.int64) for weights in (n, None))
    columns = [lang.dictionary.take(pa.array(lang_of)), source.dictionary.take(pa.array(source_of)), coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(total), pa.array(docs)]
    return pa.table(dict(zip(("lang", "source", "term", "n", "docs"), columns, strict=True)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged(parts: list[pa.Table]) -> pa.Table:
        by = ["lang", "source", "term"]
        return pa.concat_tables(parts).group_by(by).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*by, "n", "docs"])

    held: list[pa.Table] = []
    for batch in batches:
        for part in slices(batch):
            held.append(_counted(part))
            if sum(t.num_rows for t in held) > GATHERED:
                held = [merged(held)]
                if held[0].num_rows > GATHERED // 2:
                    yield from held.pop().to_batches(max_chunksize=50_000)
    if held:
        yield from merged(held).to_batches(max_chunksize=50_000)


class _Shard:
    """A DuckDB database of one task, over the rows that Spark sends it."""

    def __init__(self, batches: Iterator[pa.RecordBatch], columns: str):
        import duckdb

        self.scratch = tempfile.TemporaryDirectory()
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": self.scratch.name, "preserve_insertion_order": False})
        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER"}
        self.con.execute(f"CREATE TABLE rows ({', '.join(f'{name} {kinds[kind]}' for name, kind in (c.split() for c in columns.split(', ')))})")
        for batch in batches:
            self.con.register("batch", pa.Table.from_batches([batch]))
            self.con.execute(f"INSERT INTO rows SELECT {', '.join(c.split()[0] for c in columns.split(', '))} FROM batch")
            self.con.unregister("batch")

    def ask(self, sql: str) -> Iterator[pa.RecordBatch]:
        yield from self.con.sql(sql).to_arrow_table().to_batches(max_chunksize=50_000)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.con.close()
        self.scratch.cleanup()


_SUMS = f"""
WITH c AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, sum(docs) AS docs FROM rows GROUP BY ALL),
t AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS})
SELECT lang, source, term, n, total FROM c JOIN t USING (lang, term)
UNION ALL SELECT lang, NULL, term, total, total FROM t
"""

#: Shares of the shard's terms: p of a source and b, that of a term it doesn't have; q of the language.
_SHARES = f"""
CREATE TABLE g AS SELECT lang, source, n AS size, v, total AS lang_size, 1 + {UNIT * ADDED} // (n + {ADDED} * v) AS b FROM rows WHERE term IS NULL;
CREATE TABLE k AS
SELECT r.lang, r.source, r.term, g.b, CAST(1 + (CAST({UNIT} AS HUGEINT) * (r.n + {ADDED})) // (g.size + {ADDED} * g.v) AS BIGINT) AS p,
       CAST(1 + (CAST({UNIT} AS HUGEINT) * (r.total + {ADDED})) // (g.lang_size + {ADDED} * g.v) AS BIGINT) AS q
FROM rows r JOIN g ON g.lang = r.lang AND g.source = r.source WHERE r.term IS NOT NULL
"""

#: The distance of two sources is v * |b - b'|, and for each term that one of them has, what its share changes in that; where both have it, what is between the two changes and that of the term.
_PAIRS = """
WITH one AS (
  SELECT k.lang, k.source, h.source AS item, sum(abs(k.p - h.b) - abs(k.b - h.b)) AS d
  FROM k JOIN g h ON h.lang = k.lang AND h.source <> k.source GROUP BY ALL),
two AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.b) - abs(a.b - b.p) + abs(a.b - b.b)) AS d
  FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL)
SELECT lang, least(source, item) AS source, greatest(source, item) AS item, CAST(sum(d) AS BIGINT) AS value, 'pair' AS part
FROM (FROM one UNION ALL FROM two) GROUP BY ALL
"""

_TERMS = f"""
SELECT lang, source, term AS item, p - q AS value, 'term' AS part FROM k WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {TOP}
"""


def audit(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) over documents (text, lang, source; null: ''). Other columns are ignored.

    Terms are maximal runs of A-Z, a-z and characters beyond ASCII, A-Z in lower case. A language keeps the terms of
    at least MIN_DOCS of its rows. A term's share in a source that has it c of n times is 1 + floor(UNIT * (c + ADDED)
    / (n + ADDED * v)) with v kept terms; all arithmetic is of whole numbers. Part `pair`: for every source of a
    language each other one, with the sum of absolute differences of shares over all kept terms, 0 without any.
    Part `term`: the TOP terms of a source whose share most exceeds the language's. Rows are ranked by value, then by
    item. A source without terms has pairs and no terms, a table without rows gives none; equal rows count as
    often as they stand.

    A term that every document has is one count per source and task, added up before and after the shuffle. A source
    is no key: its terms are spread over all shards. Per term only sources that have it meet. The pairs are as many
    as the result's rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "source-audit")
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")

    def dealt(df: DataFrame, columns: str, run: Callable[[_Shard], Iterator[pa.RecordBatch]], to: str) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with _Shard(batches, columns) as own:
                yield from run(own)

        return df.repartitionById(shards, "shard").drop("shard").mapInArrow(lean(task), to)

    counts = rows.mapInArrow(lean(_count), _COUNTS)
    kept = work.save(dealt(counts.withColumn("shard", shard), _COUNTS, lambda s: s.ask(_SUMS), _KEPT), "kept")
    # each source's and each language's number of occurrences; a language's row has no source
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    of = sums.where("source IS NULL").select(F.col("lang").alias("l"), F.col("n").alias("total"), "v")
    own = sums.where("source IS NOT NULL").select(F.col("lang").alias("k"), F.col("source").alias("s"), "n")
    groups = rows.select("lang", "source").distinct().join(own, (F.col("lang") == F.col("k")) & (F.col("source") == F.col("s")), "left").join(of, F.col("lang") == F.col("l"), "left")
    groups = work.save(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "total", "v")]), "groups")

    placed = kept.where("source IS NOT NULL").select(shard.alias("shard"), "lang", "source", "term", "n", "total", F.lit(None).cast("bigint").alias("v"))
    # a shard is told of all sources of the languages that it has terms of
    told = placed.select("shard", "lang").distinct().join(groups, "lang").select("shard", "lang", "source", F.lit(None).cast("string").alias("term"), "n", "total", "v")

    def both(own: _Shard) -> Iterator[pa.RecordBatch]:
        own.con.execute(_SHARES)
        yield from own.ask(_PAIRS)
        yield from own.ask(_TERMS)

    found = dealt(placed.unionByName(told), f"{_KEPT}, v bigint", both, "lang string, source string, item string, value bigint, part string")
    found = work.save(found, "found")

    share = F.expr(f"CASE WHEN v > 0 THEN 1 + {UNIT * ADDED} div (n + {ADDED} * v) END")
    ends = groups.select("lang", "source", "v", share.alias("b"))
    other = ends.select(F.col("lang").alias("l"), F.col("source").alias("item"), F.col("b").alias("c"))
    base = ends.join(other, (F.col("lang") == F.col("l")) & (F.col("source") < F.col("item"))).select("lang", "source", "item", F.coalesce(F.col("v") * F.abs(F.col("b") - F.col("c")), F.lit(0)).cast("bigint").alias("value"))
    pairs = base.unionByName(found.where("part = 'pair'").select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", "value", ways.alias("way")).select("lang", "way.*", "value", F.lit("pair").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
