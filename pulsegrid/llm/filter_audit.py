"""Filter interaction audit: what five quality filters remove, alone and together, in every order they can be applied.

Words are exploded and counted per document and word, then per document; the outer join with the other flags
gives each document a pattern of failed filters. A part's counts of the 32 patterns, one column each, are all
that its 120 orders need.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
PATTERNS = 1 << len(FILTERS)
#: Fewest words (A), least share of distinct words (B) and most capitals (C) in percent, and the signs of D.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
#: No word: stands for the text itself among its words.
TEXT = " "


def word_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, words, distinct_words) of the texts in `text`, one per combination of keys, which rows of one text share.

    The first shuffle deals texts by their keys, so that words are counted where they are exploded: texts travel
    once and words never do. A word of many texts makes no large group, since groups are those of one text. Rows
    of the same keys are one text said several times; its counts are those of one of them.
    """
    dealt = docs.select(*keys, "text").repartition(*keys)
    words = dealt.select(*keys, F.explode(F.concat(F.array(F.lit(TEXT)), F.split("text", SPACE))).alias("word")).where("word <> ''")
    own = F.col("word") == TEXT
    each = words.groupBy(*keys, "word").agg(F.count("*").alias("n")).groupBy(*keys)
    found = each.agg(F.sum(F.when(~own, F.col("n"))).alias("said"), F.sum(F.when(own, F.col("n"))).alias("rows"), F.count_if(~own).alias("distinct_words"))
    return found.select(*keys, F.expr("coalesce(said, 0) div rows").alias("words"), "distinct_words")


def failed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, pattern, n): n rows of docs that agree in doc_id, source and text. Bit k of pattern is set if they fail filter k of FILTERS.

    A null text is empty, a null source the part ''. A row without a doc_id is neither smaller nor larger than any
    other, so it fails E never and makes none fail it; rows of the same doc_id and text don't make each other fail E.
    E asks whether a document is itself the first of its text, by a join on both: a text that a third of all rows
    have is no key of it. Texts count as identical if their MD5 is.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = F.length("text")
    capitals = size - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flags = rows.select("doc_id", "part", "h", F.md5(F.encode("text", "UTF-8")).alias("digest"), (100 * capitals > MAX_CAPITALS * size).alias("c"), F.col("text").rlike(SIGNS).alias("d"))
    flags = flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))
    counts = word_counts(rows, ["doc_id", "h"]).select(F.col("doc_id").alias("id"), F.col("h").alias("k"), "words", "distinct_words")
    first = flags.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id")).select("id", F.col("digest").alias("of"))
    found = flags.join(counts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k")), "left").drop("id", "k")
    found = found.join(first, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("of")), "left")
    fails = [
        F.col("words") < MIN_WORDS,
        100 * F.col("distinct_words") < MIN_DISTINCT * F.col("words"),
        F.col("c"),
        F.col("d"),
        F.col("doc_id").isNotNull() & F.col("of").isNull(),
    ]
    bits = [F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)]
    return found.select("doc_id", "part", reduce(Column.__add__, bits).alias("pattern"), "n")


def pattern_counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part with three times 32 columns: n0 to n31, the rows of each pattern of failed(), and good0.., toxic0.., those of labels quality=1 and toxic=1.

    A doc_id of several labels is good or toxic if one of them says so; one without a label, or without an id, is neither.
    """
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of = lambda name: F.sum(F.col("n") * F.coalesce(name, F.lit(0))).alias(name)
    joined = found.join(known, F.col("doc_id") == F.col("id"), "left")
    sums = joined.groupBy("part", "pattern").agg(F.sum("n").alias("rows"), of("good"), of("toxic"))
    column = lambda name, to, k: F.coalesce(F.sum(F.when(F.col("pattern") == k, F.col(name))), F.lit(0)).alias(f"{to}{k}")
    return sums.groupBy("part").agg(*[column(name, to, k) for name, to in (("rows", "n"), ("good", "good"), ("toxic", "toxic")) for k in range(PATTERNS)])


def interactions(counts: DataFrame) -> DataFrame:
    """The audit: for each part of pattern_counts(), each of the 120 orders and each of its steps, one row (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A filter that comes first among those that a pattern fails removes its rows. shapley is what the step's filter
    removes, summed over all orders: of the orders, a share of one in as many as the pattern has failures. No
    rows give none.
    """
    arrays = [F.array(*[F.col(f"{to}{k}") for k in range(PATTERNS)]).alias(to) for to in ("n", "good", "toxic")]
    everything = ["".join(p) for p in permutations(FILTERS)]
    bit = F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)])
    rows = counts.select("part", *arrays, F.explode(F.array(*[F.lit(x) for x in everything])).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    rows = rows.withColumn("own", F.element_at(bit, F.substr("filter_order", "step", F.lit(1))))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda x, k: x.bitwiseOR(F.element_at(bit, F.substr("filter_order", k, F.lit(1)))))
    rows = rows.withColumn("before", before.bitwiseXOR(F.col("own")))
    every = F.sequence(F.lit(0), F.lit(PATTERNS - 1))

    def total(name: str, keep, weight=lambda p: F.lit(1)) -> Column:
        return F.aggregate(every, F.lit(0).cast("bigint"), lambda x, p: x + F.when(keep(p), F.get(name, p) * weight(p)).otherwise(0))

    own = lambda p: p.bitwiseAND(F.col("own")) != 0
    earlier = lambda p: p.bitwiseAND(F.col("before")) != 0
    first = lambda p: own(p) & ~earlier(p)
    share = lambda p: F.floor(len(everything) / F.bit_count(p)).cast("bigint")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda p: ~own(p) & ~earlier(p)).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda p: own(p) & earlier(p)).alias("redundant"),
        F.get("n", "own").alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        total("n", own, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of documents (doc_id, text, source) and labels (doc_id, quality, toxic); other columns are ignored."""
    return interactions(pattern_counts(failed(docs), labels))
