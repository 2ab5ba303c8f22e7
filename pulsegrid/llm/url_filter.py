"""URL filters: allow and block rules, and where none fits, logistic regression on hashed character n-grams of host and path.

Features, training and scoring are DataFrame expressions; no Python runs on the executors, nor any over rows on
the driver. The labelled URL table is small (its bound is MAX_LABELS), so one task trains, and a model is one
array of BUCKETS weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of a model; n-grams are hashed to one of them.
BUCKETS = 2048
GRAM = 4
MAX_LABELS = 10_000
MAX_RULES = 1_000

#: Rules of the query: (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: What filter lists commonly block, and what ordinary sites are about: (host words, path words) of label 1 and of label 0.
_BLOCKED = (
    ("casino", "jackpot", "poker", "pills", "pharmacy", "replica", "payday", "webcam", "escort", "warez", "torrent", "clickbait"),
    ("bonus", "bet", "viagra", "discount-meds", "fake-watches", "instant-loan", "adult", "crack", "keygen", "popunder", "tracker", "affiliate"),
)
_ORDINARY = (
    ("museum", "university", "library", "recipes", "gardening", "weather", "astronomy", "railway", "orchestra", "hospital", "cityhall", "football"),
    ("history", "opening-hours", "lessons", "articles", "seasons", "timetable", "concerts", "team", "departments", "archive", "gallery", "contact"),
)
_TOPS = ("com", "net", "org", "info")


def training_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, host, label) of the query: label 1 for URLs to block.

    It is made by rule from the words above, which were written down for this purpose and come from no data set:
    each pair of words of one label gives a host, and three paths with words of that label. Nothing in it is
    taken from URLs that are judged. Any other table with url and label can be trained on instead.
    """
    rows = []
    for label, (names, topics) in ((1, _BLOCKED), (0, _ORDINARY)):
        for i, name in enumerate(names):
            for j in range(0, len(topics), 3):
                host_name = f"{'www.' * (i % 2)}{name}{('-', '')[j % 2]}{topics[j]}.{_TOPS[(i + j) % len(_TOPS)]}"
                rows += [(f"http{'s' * (j % 2)}://{host_name}/{topics[(j + k) % len(topics)]}/{name}{('', '/', '?id=7')[k]}", host_name, label) for k in range(3)]
    return spark.createDataFrame(rows, "url string, host string, label int")


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z in lower case. Empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end. Empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def features(host_col: Column, path_col: Column) -> Column:
    """The distinct buckets (1 to BUCKETS) of the character 4-grams of host and path, each with its part's mark and ends."""

    def grams(text: Column, mark: str) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.greatest(F.char_length(whole) - F.lit(GRAM - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: (F.pmod(F.xxhash64(F.lit(mark), F.substring(whole, i, GRAM)), F.lit(BUCKETS)) + 1).cast("int"))

    return F.array_distinct(F.concat(grams(host_col, "h"), grams(path_col, "p")))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def train(labelled: DataFrame, steps: int = 150, rate: float = 2.0, penalty: float = 1e-3) -> list[float]:
    """Weights of a logistic regression: BUCKETS of them and the intercept last, by full gradient steps from zero.

    `labelled` has url and label (0 or 1); rows with a null in either are left out. It is small: over
    MAX_LABELS rows raise an error. An empty table gives zero weights, so every score is 0.5.

    The rows are brought into one, in an order of their own, and the steps are an aggregate over it, in one task:
    sums have a fixed order, so the weights don't depend on partitions. Only the weights reach the driver.
    """
    known = labelled.where("url IS NOT NULL AND label IS NOT NULL")
    if known.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labelled URLs")
    x = F.array_sort(features(host(F.col("url")), path(F.col("url"))))
    rows = known.select(x.alias("x"), F.col("label").cast("double").alias("y"))
    # The sum over a row's features is divided by the root of their number, which bounds the step size.
    rows = rows.withColumn("scale", 1 / F.sqrt(F.size("x").cast("double")))
    data = rows.agg(F.array_sort(F.collect_list(F.struct("x", "y", "scale"))).alias("data"))
    # of each bucket: the rows that have it
    at = data.select(F.posexplode("data").alias("row", "r")).select((F.col("row") + 1).alias("row"), F.col("r.scale").alias("scale"), F.explode("r.x").alias("i"))
    at = at.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("row", "scale"))).alias("rows"))
    every = labelled.sparkSession.range(1, BUCKETS + 1).select(F.col("id").cast("int").alias("i")).join(at, "i", "left")
    every = every.agg(F.array_sort(F.collect_list(F.struct("i", "rows"))).alias("buckets"))
    zero = F.lit(0.0)

    def step(state: Column, _: Column) -> Column:
        w, b, n = state["w"], state["b"], F.size("data")

        def off(r: Column) -> Column:
            total = F.aggregate(r["x"], zero, lambda a, i: a + F.element_at(w, i)) * r["scale"] + b
            return 1 / (1 + F.exp(-total)) - r["y"]

        def moved(d: Column) -> Column:
            def weight(k: Column) -> Column:
                g = F.aggregate(k["rows"], zero, lambda a, r: a + F.element_at(d, r["row"]) * r["scale"])
                old = F.element_at(w, k["i"])
                return F.when(k["rows"].isNull(), old).otherwise(old - rate * (g / n + penalty * old))

            return F.struct(F.transform("buckets", weight).alias("w"), (b - rate * F.aggregate(d, zero, lambda a, v: a + v) / n).alias("b"))

        return _bind(F.transform("data", off), moved)

    start = F.struct(F.array_repeat(zero, BUCKETS).alias("w"), zero.alias("b"))
    fitted = F.when((F.size("data") > 0) & F.lit(steps > 0), F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)).otherwise(start)
    w, b = data.crossJoin(F.broadcast(every)).select(fitted.alias("m")).select("m.w", "m.b").first()  # one row each
    return [*w, b]


def score(host_col: Column, path_col: Column, weights: list[float]) -> Column:
    """The probability that a URL is to be blocked."""
    x = features(host_col, path_col)
    table = F.lit(weights[:-1])
    total = F.aggregate(x, F.lit(0.0), lambda a, i: a + F.element_at(table, i)) / F.sqrt(F.size(x).cast("double")) + F.lit(weights[-1])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fitting_rule(host_col: Column, path_col: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Of two equal rules the first counts."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name = verdict = None
    for rule, says in sorted(rules, key=lambda r: -len(r[0])):
        of_host, slash, of_path = rule.partition("/")
        of_host = of_host.lower()
        fits = ((host_col == of_host) | host_col.endswith("." + of_host)) & path_col.startswith(slash + of_path)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def judge(pages: DataFrame, weights: list[float], rules: tuple = RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: id, host, path, rule, verdict ("allow" or "block") and score (of the model, for every row).

    A rule "host/path" fits its host and all subdomains if the URL's path starts with the rule's; the longest
    wins. Without a fitting rule the model decides: block from `threshold` on. A URL that is null or has no
    :// has empty host and path and is scored as such. Every row gives one row, repeated ids too; other
    columns are ignored. Nothing is shuffled: rules and weights are of bounded size and part of the plan.
    """
    named = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    h, p = F.col("host"), F.col("path")
    rule, says = fitting_rule(h, p, rules)
    return named.withColumn("score", score(h, p, weights)).select(id_col, "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
