"""Exact Jaccard join of documents on word n-grams, by a blocked sparse matrix product.

The matrix has a row per distinct set of n-grams and a column per n-gram. Columns with one entry go first
(`shared`). By the size-derived bound, two sets can only link if each shares at least the threshold's part of
itself; most rows go with that. What is left is multiplied in blocks of rows, in two rounds:

1. Blocks of rows with the same minimum of hashed n-grams, which near copies mostly share: this joins large groups
   of copies early and decides nothing else.
2. Two rows can only link if they share one of their rarest n-grams (prefixes whose length the size bound gives).
   Prefix n-grams all of whose rows are one class already have no work left. Rows that the others bring
   together, directly or through other rows, are a block; where that would be larger than BLOCK entries, each of
   the n-grams is a block of its own instead, so chains of rows that share but don't link stay small.

A block's products accumulate overlap counts along the posting lists of a row's own n-grams, and pairs below the
bounds are discarded. Rows of one class aren't compared, so a group of near copies costs its size, not its square;
what leaves a block is a link for each two classes that it joins, never its pairs.

Sets are told apart by 64 bits, and n-grams by 48 bits and those of their bucket: with 10^10 different sets some
three are expected to share a hash with another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Words, lean, mix, ragged_unique, signed, slices
from .components import components
from .shared import bucket_count, shared_features
from .workspace import Workspace

#: Entries of a block, each row counting as ROW entries more. The rows of one n-gram that have more are dealt to several parts, and all pairs of parts are multiplied.
BLOCK, ROW = 1_000_000, 100
#: Entries of a block of the first round, which needn't meet all pairs: a larger one is split, and its least row stands in every part.
COPIES = 16_384
#: Entries that a task multiplies at once: several small blocks.
FLUSH = 500_000
#: Salts of the minima in the first round.
SALTS = (1, 2)
#: What a block's row brings: where it belongs (kind, blk and the parts i and j), its own part, itself and its class.
_PLACE = "kind int, blk bigint, i int, j int, own int, entity bigint, label bigint, n bigint, tokens array<bigint>"


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word k-grams of each text in lower case, sorted, and their offsets. A text of fewer words has one, the whole sequence; without words none."""
    words = Words(column, lower=True)
    at, grams = words.grams(k)
    owner, counts = words.text_of()[at], words.counts()
    short_owner, short = [], []
    for n in range(1, k):
        which = np.flatnonzero(counts == n)
        h = mix(words.hash[words.first[which]] + np.uint64(n))
        for j in range(1, n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words.hash[words.first[which] + j])
        short_owner.append(which)
        short.append(h)
    return ragged_unique(np.concatenate([grams, *short]), np.concatenate([owner, *short_owner]), len(column))


def set_hashes(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(tokens[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)


def linked_classes(block: np.ndarray, own: np.ndarray, apart: np.ndarray, label: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (label, least label) that join the classes which rows of one block link, directly or through others.

    Rows ascend by block. Row products over the transposed incidence matrix: the posting lists of one row's
    entries, counted, are its overlaps. Only rows that nothing has reached yet are compared, and where `apart` only
    rows of different parts.
    """
    m, out = len(label), []
    owner = np.repeat(np.arange(m), np.diff(offsets))
    # columns belong to their block: what rows of different blocks share doesn't count
    _, code = np.unique(tokens, return_inverse=True)
    _, column, count = np.unique(block[owner] * (int(code.max(initial=0)) + 1) + code, return_inverse=True, return_counts=True)
    postings = owner[np.argsort(column, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(count)])
    _, name = np.unique(label, return_inverse=True)
    _, cls = np.unique(block * (int(name.max(initial=0)) + 1) + name, return_inverse=True)
    of_class = np.argsort(cls, kind="stable")
    first = np.searchsorted(cls[of_class], np.arange(int(cls.max(initial=-1)) + 2))
    members = lambda c: of_class[first[c] : first[c + 1]]
    left = np.bincount(block)
    done = np.zeros(m, bool)
    for x in range(m):
        if done[x]:
            continue
        b, reached, todo = block[x], [cls[x]], members(cls[x]).tolist()
        done[todo] = True
        left[b] -= len(todo)
        while todo and left[b]:
            y = todo.pop()
            mine = column[offsets[y] : offsets[y + 1]]
            mine = mine[count[mine] > 1]
            if not len(mine):
                continue
            size = count[mine]
            met = postings[np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))]
            met = met[~done[met] & (own[met] != own[y])] if apart[y] else met[~done[met]]
            near, overlap = np.unique(met, return_counts=True)
            hit = near[den * overlap >= num * (sizes[y] + sizes[near] - overlap)]
            for c in np.unique(cls[hit]).tolist():
                more = members(c).tolist()
                done[more] = True
                left[b] -= len(more)
                todo += more
                reached.append(c)
        if len(reached) > 1:
            names = label[of_class[first[reached]]]
            out += [(int(v), int(names.min())) for v in names if v != names.min()]
    return out


def _links(placed: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (a, b) that join classes, from rows that know their block: one shuffle by block, and several small blocks at once."""
    place = ["kind", "blk", "i", "j"]

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in place], axis=1)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        block = np.cumsum(new) - 1
        # a row that is alone in its block meets nothing
        some = np.flatnonzero(np.bincount(block)[block] > 1)
        if not len(some):
            return
        table, block = table.take(pa.array(some)).combine_chunks(), np.unique(block[some], return_inverse=True)[1]
        lists = table.column("tokens").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = np.asarray(lists.offsets).astype(np.int64)
        column = lambda c: table.column(c).to_numpy()
        out = linked_classes(block, column("own"), column("i") != column("j"), column("label"), column("n"), np.asarray(lists.values)[offsets[0] : offsets[-1]], offsets - offsets[0], num, den)
        for at in range(0, len(out), 50_000):
            a, b = zip(*out[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                keys = list(zip(*(batch.column(c).to_pylist() for c in place), strict=True))
                if size >= FLUSH:
                    # up to the first row of a new block
                    cut = next((k for k, key in enumerate(keys) if key != (keys[k - 1] if k else last)), None)
                    if cut is not None:
                        yield from found([*held, batch.slice(0, cut)])
                        batch, held, size = batch.slice(cut), [], 0
                held.append(batch)
                size += len(batch.column("tokens").flatten())
                last = keys[-1]
        if held:
            yield from found(held)

    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [x.split()[0] for x in _PLACE.split(", ")]
    return placed.select(*columns).repartition(parts, *place).sortWithinPartitions(*place, "entity").mapInArrow(lean(multiply), "a bigint, b bigint")


def _copies_first(rows: DataFrame, ws: Workspace, num: int, den: int, block: int) -> DataFrame:
    """Links of the first round: blocks of a common minimum, split beyond COPIES entries."""
    block = min(block, COPIES)
    minima = F.array(*[F.array_min(F.transform("tokens", lambda t, s=s: F.xxhash64(t, F.lit(s)))) for s in SALTS])
    met = rows.select("entity", "n", "tokens", F.explode(minima).alias("blk"))
    heavy = met.groupBy("blk").agg(F.sum(F.size("tokens") + ROW).alias("w"), F.min("entity").alias("hub")).where(F.col("w") > block)
    heavy = ws.save(heavy.select("blk", "hub", F.expr(f"cast(w div {block} + 1 as int)").alias("parts")), "heavy")
    own = F.pmod(F.xxhash64("entity"), F.col("parts").cast("bigint")).cast("int")
    part = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("entity") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    placed = met.join(heavy, "blk", "left").withColumn("i", F.explode(part))
    return ws.save(_links(placed.withColumns({"kind": F.lit(0), "j": F.col("i"), "own": F.col("i"), "label": F.col("entity")}), num, den), "copies")


def _by_prefix(rows: DataFrame, classes: DataFrame, ws: Workspace, num: int, den: int, block: int) -> DataFrame:
    """Links of the second round, between the classes of the first."""
    length = (F.size("tokens") - F.col("least") + 1).cast("int")
    named = rows.select("entity", (F.size("tokens") + ROW).alias("w"), F.slice("tokens", F.lit(1), length).alias("prefix")).join(classes, "entity", "left")
    prefix = named.select("entity", "w", F.coalesce("root", "entity").alias("label"), F.explode("prefix").alias("t"))
    open_ = prefix.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("entity").alias("b"), F.sum("w").alias("tw"), F.count("*").alias("m"), F.sum(F.xxhash64("entity").cast("decimal(38,0)")).alias("who")).where("lo < hi")
    # n-grams of just the same rows are one
    open_ = open_.groupBy("who", "m").agg(F.min(F.struct("t", "b", "tw")).alias("x")).select("x.t", "x.b", "x.tw")
    members = ws.save(prefix.join(open_, "t").select("t", "b", "tw", "entity", "label", "w"), "members")
    groups = components(members.select(F.col("entity").alias("a"), "b"), ws, "meets").select(F.col("id").alias("entity"), F.col("root").alias("grp"))
    one = members.groupBy("entity").agg(F.min("label").alias("label"), F.min("w").alias("w")).join(groups, "entity")
    weights = one.groupBy("grp").agg(F.sum("w").alias("gw"))
    one = ws.save(one.join(weights, "grp"), "groups")
    same = {c: F.lit(0) for c in ("i", "j", "own")}
    small = one.where(F.col("gw") <= block).select(F.lit(1).alias("kind"), F.col("grp").alias("blk"), "entity", "label").withColumns(same)
    large = members.join(one.where(F.col("gw") > block).select("entity"), "entity", "left_semi").withColumn("parts", F.expr(f"cast(tw div {block} + 1 as int)"))
    large = large.withColumn("own", F.pmod(F.xxhash64("entity"), F.col("parts").cast("bigint")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select(F.lit(2).alias("kind"), F.col("t").alias("blk"), "entity", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    placed = small.unionByName(large).join(rows.select("entity", "n", "tokens"), "entity")
    return ws.save(_links(placed, num, den), "links")


def _labelled(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """Rows (id, th, n, label) of all documents: a hash of the text, the set's size, and a label that groups share; null without words."""
    ws = Workspace(docs.sparkSession, "ngram-join")
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, offsets = shingle_sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(signed(set_hashes(tokens, offsets)))], ["id", "th", "n", "entity"])

    def extract(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, offsets = shingle_sets(part.column(0), k)
        return set_hashes(tokens, offsets), tokens, offsets

    sets = ws.save(text.mapInArrow(lean(describe), f"id {kind}, th bigint, n bigint, entity bigint"), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    found = shared_features(text.select("text"), extract, bucket_count(total))
    # two plain arrays in step; the order by df needs no more than 15 bits of it, the same in all rows of a feature
    lists = (F.collect_list(F.least("df", F.lit(32767)).cast("smallint")).alias("d"), F.collect_list("feature").alias("f"))
    # rows that come twice stand side by side once sorted; array_distinct would compare all pairs of structs
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x["f"] != F.get(a, i - 1)["f"]))
    whole = F.get(F.transform(F.array(F.array_sort(F.arrays_zip("d", "f"))), once), F.lit(0))
    sizes = sets.where("n > 0").groupBy("entity").agg(F.max("n").alias("n"))
    least = F.expr(f"(n * {num} + {den - 1}) div {den}")
    rows = found.groupBy("entity").agg(*lists).join(sizes, "entity").withColumn("least", least).where(F.size("f") >= F.col("least"))
    rows = rows.select("entity", "n", "least", F.transform(whole, lambda x: x["f"]).alias("tokens")).where(F.size("tokens") >= F.col("least"))
    rows = ws.save(rows, "rows")

    found = _copies_first(rows, ws, num, den, block)
    label = components(found, ws, "copies").select(F.col("id").alias("entity"), "root")
    more = _by_prefix(rows, label, ws, num, den, block)
    if not more.isEmpty():
        label = components(found.unionByName(more), ws, "all").select(F.col("id").alias("entity"), "root")
    return sets.join(label, "entity", "left").select("id", "th", "n", F.when(F.col("n") > 0, F.coalesce("root", "entity")).alias("label"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Documents with the class they belong to: id, n_shingles, component_id.

    Two documents link if den * |intersection| >= num * |union| of their sets of distinct word k-grams (see
    shingle_sets); component_id is the least id reachable by links, itself included. Documents without words
    link with nothing, not even each other, and keep their own id. Equal sets are one row of the matrix and
    need no links. Null texts have no words; a null id is never the least one, and a group of null ids only has
    component null. Repeated ids are rows of their own and meet through their sets. Other columns are ignored.

    Rows that travel: the packed matrix once, its shared entries once, near-copy candidates twice, and once more those that the first round left apart.
    """
    named = _labelled(docs, k, num, den, id_col, text_col, block)
    # written, so that the join is between two plain shuffles, which Spark can split where a group is large
    least = Workspace(docs.sparkSession, "ngram-least").save(named.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component")), "least")
    out = named.join(least, "label", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One document of each group that near_duplicates finds, with the columns of docs: that of the least id.

    Of rows that share this id, one of the least text hash stays, of rows equal in both the first by their
    other columns. A null id stays only if its whole group has none. Documents without words all stay.
    """
    named = _labelled(docs, k, num, den, id_col, text_col, block).select("id", "th", "label")
    first = named.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("x")).select("x.id", "x.th")
    keep = first.unionByName(named.where("label IS NULL").select("id", "th")).distinct().select(F.col("id").alias("__one_id"), F.col("th").alias("__one_th"))
    rows = docs.withColumn("__one_key", F.xxhash64(text_col))
    rows = rows.join(keep, F.col(id_col).eqNullSafe(F.col("__one_id")) & (F.col("__one_key") == F.col("__one_th")), "left_semi")
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rank = F.row_number().over(Window.partitionBy(id_col, "__one_key").orderBy(*[F.col(f"`{c}`") for c in others] or [F.lit(1)]))
    return rows.withColumn("__one_rank", rank).where((F.col("__one_rank") == 1) | ~worded).select(*docs.columns)
