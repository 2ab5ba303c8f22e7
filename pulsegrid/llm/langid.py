"""Language identification by compression.

One zstandard raw-content dictionary per language is filled with text of that language. A text is compressed
with each dictionary, and the language whose dictionary gives the fewest bytes is chosen; a narrow margin to
the next language means rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import lean
from .workspace import small_batches

UNKNOWN = "und"
#: Bounds of what is learned: languages (more are an error), and hash cells per language with a document each.
MAX_LANGS, CELLS = 1024, 512
#: Bytes of a language's dictionary.
DICTIONARY = 256 << 10
#: So many languages have that many cells and bytes; more share the same total, whatever the table's size.
FULL_LANGS = 64
#: Whole texts are compressed in pieces of so many bytes, each of them against the dictionary alone.
PIECE = 8 << 10
LEVEL = 6
#: A text is rejected if the margin, the share by which the next language's size exceeds the best one's, is less.
MIN_MARGIN = 0.002
#: What makes a text one that has a language.
LETTER = r"\p{L}"


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> dict[str, bytes]:
    """A dictionary's content per language, the most frequent first, from a bounded sample of the rows with text and lang.

    Rows fall into cells per language by a hash of their key, and each cell gives its row of least hash: a
    sample that depends on the rows alone, made of partial aggregates. The sampled documents are taken whole, in
    lower case and in order of hash, until a dictionary is full. Every language with a text that isn't empty is
    learned: up to FULL_LANGS languages have CELLS cells and DICTIONARY bytes each, more share what those would
    have. Over MAX_LANGS languages raise an error. A table without labelled rows gives none.

    Two passes over the labelled rows: one finds the cells' documents and their sizes, one fetches the texts
    that the dictionaries have room for. The driver holds a row per cell and the dictionaries.
    """
    rows = labelled.where((F.length(text_col) > 0) & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(key_col).cast("string")).alias("h"), F.col(text_col).alias("text"))
    cells = rows.groupBy("lang", F.pmod("h", F.lit(CELLS)).alias("cell")).agg(F.count("*").alias("n"), F.min(F.struct("h", F.octet_length("text").alias("size"))).alias("least"))
    # as many languages as would be an error already
    langs = cells.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS + 1)
    found = langs.join(cells.select("lang", "cell", "least"), "lang").collect()
    by_count = sorted({(-r.n, r.lang) for r in found})
    if len(by_count) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    share = max(FULL_LANGS, len(by_count))
    count, size = max(1, CELLS * FULL_LANGS // share), DICTIONARY * FULL_LANGS // share
    wanted: dict[str, list[int]] = {}
    for _, lang in by_count:
        # cells beyond `count` of them are left out, then documents beyond what fits
        least = sorted((r.least.h, r.least["size"]) for r in found if r.lang == lang and r.cell < count) or [min((r.least.h, r.least["size"]) for r in found if r.lang == lang)]
        have = 0
        for h, n in least:
            if have < size:
                wanted.setdefault(lang, []).append(h)
                have += n
    if not wanted:
        return {}
    pairs = labelled.sparkSession.createDataFrame([(lang, h) for lang, hs in wanted.items() for h in hs], "lang string, h bigint")
    # a text that is longer than a dictionary can't enter it whole
    chosen = rows.join(F.broadcast(pairs), ["lang", "h"]).select("lang", "h", F.substring("text", 1, size).alias("t"))
    # rows of one key and language share a hash: the least text stands for them
    picked = {(r.lang, r.h): r.t for r in chosen.groupBy("lang", "h").agg(F.min("t").alias("t")).collect()}
    return {lang: b"".join(picked[lang, h].lower().encode() for h in hs)[:size] for lang, hs in wanted.items()}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), prefix: str = "") -> DataFrame:
    """The language of every whole text: id, the columns of `keep`, lang_pred, score, margin, rejected.

    lang_pred is the language of fewest bytes (ties: the first in dictionaries), or `und` if the text is null or
    empty, has no letter (LETTER), or nothing was learned. margin is (next - best) / best, 0 with one language; score
    is between 0 and 1: half at no margin, growing with it; 0 for `und`. rejected is true for `und` and for
    a margin under min_margin, false if only one language was learned. Every row gives one row. `prefix`
    goes before the names of the four new columns, should `keep` have columns of those names. Rows stay in
    their partition; the dictionaries are of bounded size (see learn).
    """
    small_batches(docs.sparkSession)
    langs = list(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast([dictionaries[k] for k in langs])
    columns = [id_col, *[c for c in keep if c != id_col]]
    fields = [docs.schema[c] for c in columns]
    added = [f"{prefix}{x}" for x in ("lang_pred", "score", "margin", "rejected")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"`{n}` {t}" for n, t in zip(added, ("string", "double", "double", "boolean"), strict=True)]])
    sent = columns if text_col in columns else [*columns, text_col]

    def compressor(content: bytes):
        import zstandard

        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, source_size=PIECE, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(LETTER).search
        compress = [compressor(content) for content in shared.value]
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                pred, score, margin, rejected = [], [], [], []
                texts = batch.column(sent.index(text_col))
                for k in range(batch.num_rows):
                    text = texts[k].as_py()
                    if not text or not compress or not letter(text):
                        for to, x in ((pred, UNKNOWN), (score, 0.0), (margin, 0.0), (rejected, True)):
                            to.append(x)
                        continue
                    data = text.lower().encode()
                    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                    sizes = [sum([len(f(p)) for p in pieces]) for f in compress]
                    best = min(range(len(sizes)), key=sizes.__getitem__)
                    rest = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best])
                    m = (rest - sizes[best]) / sizes[best]
                    pred.append(langs[best])
                    margin.append(m)
                    score.append(1.0 - 0.5 / (1.0 + 10.0 * m))
                    rejected.append(len(sizes) > 1 and m < min_margin)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], [*columns, *added])

    return docs.select(*sent).mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of the id as text, modulo 5, is 0. A null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
