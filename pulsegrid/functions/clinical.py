"""Column functions of the clinical model: missing values, outcome targets, flags, classes, bins and header lines.

Missing is NULL everywhere; NaN is turned into NULL where data come in, since Spark orders NaN above every number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_nan(c: Column) -> Column:
    """NULL for NaN."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """Whether a value is a number other than NaN and infinity; false for NULL."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def normalize_nan(df: DataFrame) -> DataFrame:
    """All float columns with NULL for NaN, in one projection."""
    return df.select(*[null_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def yes(c: Column) -> Column:
    """A predicate that is false where it can't be told."""
    return F.coalesce(c, F.lit(False))


def composite_target(ph: Column, apgar5: Column, nicu: Column, ph_below: float = 7.10, apgar_below: float = 7, nicu_above: float = 0) -> Column:
    """1 if any of the three criteria holds; a missing value fulfils none."""
    return (yes(null_nan(ph) < ph_below) | yes(null_nan(apgar5) < apgar_below) | yes(null_nan(nicu) > nicu_above)).cast("int")


def acog_all(ph: Column, apgar5: Column) -> Column:
    """The strict rule: pH under 7.00 and Apgar at 5 min under 7."""
    return yes(ph < 7.00) & yes(apgar5 < 7)


def acog_any(ph: Column, apgar5: Column, hie: Column) -> Column:
    """The wide rule: pH under 7.00 or Apgar at 5 min under 7 or HIE."""
    return yes(ph < 7.00) | yes(apgar5 < 7) | yes(hie > 0)


def outcome_flags(ph: Column, apgar1: Column, apgar5: Column, hie: Column, nicu: Column) -> dict[str, Column]:
    """The eleven outcome flags, 0 or 1: three bands of pH, depression at 1 and 5 minutes, and four combined rules. A missing value fulfils none."""
    flags = {
        "ph_severe": yes(ph < 7.05),
        "ph_moderate": yes(ph >= 7.05) & yes(ph < 7.10),
        "ph_mild": yes(ph >= 7.10) & yes(ph < 7.20),
        "apgar1_lt_7": yes(apgar1 < 7),
        "apgar5_lt_7": yes(apgar5 < 7),
        "apgar1_lt_4": yes(apgar1 < 4),
        "apgar5_lt_4": yes(apgar5 < 4),
        "acog": acog_all(ph, apgar5),
        "wide": yes(ph < 7.10) & yes(apgar1 < 7),
        "ph705_apgar5": yes(ph < 7.05) & yes(apgar5 < 7),
        "gold": yes(ph < 7.05) & yes(apgar5 < 7) & (yes(hie > 0) | yes(nicu > 0)),
    }
    return {k: v.cast("int") for k, v in flags.items()}


def outcome_criteria(ph: Column, apgar1: Column, apgar5: Column, hie: Column, nicu: Column) -> dict[str, Column]:
    """The ten criteria that the outcome report counts, in its order: the flags, but pH under 7.10 as a whole in place of its two upper bands."""
    flags = {k: v == 1 for k, v in outcome_flags(ph, apgar1, apgar5, hie, nicu).items()}
    order = ("ph_severe", "ph_lt_710", "apgar1_lt_7", "apgar5_lt_7", "apgar1_lt_4", "apgar5_lt_4", "acog", "ph705_apgar5", "wide", "gold")
    return {k: yes(ph < 7.10) if k == "ph_lt_710" else flags[k] for k in order}


def outcome_category(ph: Column, apgar1: Column, apgar5: Column) -> Column:
    """One label per birth, by the first rule that holds; without all three values there is none."""
    rules = [
        (ph.isNull() | apgar1.isNull() | apgar5.isNull(), "incomplete data"),
        ((ph < 7.05) & (apgar5 < 7), "confirmed asphyxia"),
        (ph < 7.05, "acidosis without depression"),
        (apgar5 < 7, "depression without severe acidosis"),
        ((ph < 7.10) & (apgar1 < 7), "borderline"),
    ]
    return first_match(rules, "normal")


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    out = None
    for rule, label in rules:
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return F.lit(default) if out is None else out.otherwise(default)


def left_closed_bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin [edges[i], edges[i + 1]) that holds the value; NULL outside and for NULL."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True):
        cond = (c >= lo) & (c < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


# Cut points of the two pH classifications and of the Apgar classes.
PH_CUTS_EARLY = (7.05, 7.10, 7.20)
PH_CUTS_EDA = (7.00, 7.10, 7.20)
APGAR_CUTS = (4.0, 7.0)
APGAR_TWO = (7.0,)


def ph_class(ph: Column, cuts: tuple = PH_CUTS_EDA, labels: tuple = ("severe", "moderate", "mild", "normal"), missing: str = "no data") -> Column:
    """The first class whose upper cut point is above the value."""
    return first_match([(ph.isNull(), missing), *[(ph < c, name) for c, name in zip(cuts, labels, strict=False)]], labels[-1])


def apgar_class(score: Column, labels: tuple = ("0-3", "4-6", "7-10"), missing: str | None = "no data", cuts: tuple = APGAR_CUTS) -> Column:
    """The Apgar class, one more than cut points; with missing=None a missing score falls through to the last class. The score at 5 minutes has two classes in the outcome analysis: cuts=APGAR_TWO."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("a label more than cut points")
    head = [] if missing is None else [(score.isNull(), missing)]
    return first_match([*head, *[(yes(score < c), name) for c, name in zip(cuts, labels, strict=False)]], labels[-1])


def code_label(code: Column, names: dict, default: str) -> Column:
    """A code's name, or the default."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(default))


def header_entry(line: Column) -> Column:
    """A header line `key<two or more spaces or a tab>value` as a struct of lower-case key and value; NULL for comments, blanks and single-spaced lines."""
    parts = F.split(F.trim(line), r"\s{2,}|\t", 2)
    good = line.isNotNull() & (F.trim(line) != "") & ~F.ltrim(line).startswith("--") & (F.size(parts) == 2)
    return F.when(good, F.struct(F.lower(F.trim(parts[0])).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value")))


def record_of_path(path: Column, suffix: str = "_fhr.npy") -> Column:
    """The record that a file's name stands for."""
    return F.regexp_extract(path, r"([^/]+)" + suffix.replace(".", r"\."), 1)


def synthetic_id(n: Column) -> Column:
    return F.format_string("syn_%05d", n)


def replicate_id(source: Column, k: Column) -> Column:
    return F.concat_ws("_boot_", source, k.cast("string"))


def safe_odds(coef: Column) -> Column:
    """exp with its result held between 0 and infinity instead of failing."""
    return F.when(coef > 709.0, F.lit(float("inf"))).when(coef < -745.0, F.lit(0.0)).otherwise(F.exp(coef))


def birth_minute(n_samples: Column, sig2birth_s: Column, fs: int = 4) -> Column:
    """Minutes from the record's start to birth: its length, and the time after its end where that is finite and positive."""
    after = F.when(finite(sig2birth_s) & (sig2birth_s > 0), sig2birth_s / 60.0).otherwise(0.0)
    return n_samples / F.lit(float(fs * 60)) + after


def subsample(values: Column, most: int) -> Column:
    """At most `most` elements at evenly spaced positions, ends included."""
    n = F.size(values)
    pick = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.element_at(values, (F.floor(k * (n - 1) / F.lit(float(most - 1))) + 1).cast("int")))
    return F.when(n <= most, values).otherwise(pick)


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts alone, the same in every engine: eight hex digits of an MD5 over 2^32."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
