"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how often they occur. For each of K samples every term draws two
gamma variables of shape 2 and a uniform one from a hash of itself, which with its weight give it a value
(improved consistent weighted sampling); the least value over the terms is the sample. Two documents' samples
agree with a chance equal to the generalised Jaccard similarity of their weights.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, lean, mix
from .ranges import range_bounds, range_of
from .workspace import small_batches

K = 64
#: Bytes of text that are fingerprinted at once.
CHUNK = 2 << 20
#: Terms that are drawn at once.
SLICE = 4096
_U = np.uint64
_SPACE_OR_END = re.compile(rb"[\x20\x09-\x0D]")


def _gamma2(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (lo + hi) / 2
        less = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(less, x, lo), np.where(less, hi, x)
    return hi


class Sampler:
    """Signatures of texts: an array of K unsigned 16-bit samples each."""

    def __init__(self, k: int = K):
        g = _gamma2()
        self.k, self.r, self.ln_c = k, g.astype(np.float32), np.log(g).astype(np.float32)
        self.salt = mix(np.arange(1, k + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))

    def values(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """ln a of each term and sample: ln c - r (t + 1 - beta), with t = floor(ln w / r + beta)."""
        m = mix(terms[:, None] ^ self.salt[None, :])
        r = self.r[(m & _U(0xFFFF)).astype(np.intp)]
        out = self.ln_c[((m >> _U(16)) & _U(0xFFFF)).astype(np.intp)]
        beta = ((m >> _U(32)) & _U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        heavy = np.flatnonzero(weights > 1)
        step = np.float32(1) - beta
        if len(heavy):
            step[heavy] += np.floor(np.log(weights[heavy]).astype(np.float32)[:, None] / r[heavy] + beta[heavy])
        return out - r * step

    def signatures(self, texts: list[str | bytes]) -> np.ndarray:
        """K samples per text; texts without words have all samples 0 and agree with each other only.

        Terms are drawn a slice at a time and only running minima are kept, so memory follows the bytes of CHUNK
        (of one text, pieces of that size) and not the number of terms times K.
        """
        blobs = [t.encode() if isinstance(t, str) else t for t in texts]
        n, begun = len(blobs), [0]
        for t in blobs:
            begun.append(begun[-1] + len(t))
        found = []
        at = 0
        while at < n:
            to = at + 1
            while to < n and begun[to + 1] - begun[at] <= CHUNK:
                to += 1
            if begun[to] - begun[at] <= CHUNK:
                found.append(self._terms(blobs[at:to], at))
            else:
                found.append(self._long_terms(blobs[at], at))
            at = to
        out = np.full((n, self.k), np.inf, np.float32)
        for owner, term, weight in found:
            self._lower(out, owner, term, weight)
        bits = mix(out.view(np.uint32).astype(np.uint64))
        return np.where(np.isinf(out), 0, (bits % _U(65535)) + _U(1)).astype(np.uint16)

    @staticmethod
    def _counted(owner: np.ndarray, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each owner's distinct terms with the sum of their weights."""
        order = np.lexsort((term, owner))
        owner, term = owner[order], term[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        return owner[at], term[at], np.add.reduceat(weight[order], at) if len(at) else weight[:0]

    def _terms(self, blobs: list[bytes], at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(pa.array(blobs, pa.large_binary()))
        return self._counted(words.text_of() + at, words.hash, np.ones(len(words.hash), np.int64))

    def _long_terms(self, blob: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of one text in pieces that end between words; a word longer than a piece lengthens it."""
        total, start = None, 0
        while start < len(blob):
            end = min(start + CHUNK, len(blob))
            if end < len(blob):
                space = _SPACE_OR_END.search(blob, end)
                end = space.start() if space else len(blob)
            part = self._terms([blob[start:end]], at)
            total = part if total is None else self._counted(*(np.concatenate(x) for x in zip(total, part, strict=True)))
            start = end
        return total

    def _lower(self, out: np.ndarray, owner: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Lower the owners' minima by these terms. Each distinct pair of term and weight is drawn once."""
        key = mix(term ^ mix(weight.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        key, owner, term, weight = key[order], owner[order], term[order], weight[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        ends = np.append(first, len(key))
        which = np.cumsum(new) - 1
        lo = 0
        while lo < len(first):
            # some thousand draws and some ten thousand uses of them at a time
            hi = min(lo + SLICE, len(first))
            hi = max(lo + 1, min(hi, int(np.searchsorted(ends, ends[lo] + 4 * SLICE, side="right")) - 1))
            table = self.values(term[first[lo:hi]], weight[first[lo:hi]])
            for i in range(int(ends[lo]), int(ends[hi]), 4 * SLICE):
                use = slice(i, min(i + 4 * SLICE, int(ends[hi])))
                by = np.argsort(owner[use], kind="stable")
                who = owner[use][by]
                begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                least = np.minimum.reduceat(table[which[use][by] - lo], begin, axis=0)
                out[who[begin]] = np.minimum(out[who[begin]], least)
            lo = hi


def edit(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint (k samples as 4 hex digits each), near_edited, near_next.

    The next document is that of the next greater id, after the last the first; null ids come first, and rows
    of one id follow each other by a hash of their text and then by text. The edited text is edit(text, next
    text). near_edited and near_next are the shares of samples in which the fingerprint agrees with the edited
    text's and the next document's. A null text is empty; texts without words agree fully with each other and not
    with others. A table of one row is its own next; an empty table gives none. Other columns are ignored.

    Texts are shuffled once, to ranges of (id, hash of text) of about equal bytes; a range's last document gets the
    next range's first as a row of its own, one per range.
    """
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    # null ids come first: below every other key
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    key, tie = F.col("key"), F.col("tie")
    bounds = range_bounds(rows, key, tie, F.octet_length("text") + 100, parts)
    rows = rows.withColumn("range", range_of(key, tie, bounds))
    # one row per range, of which there are as many as partitions
    firsts = sorted((r.range, *r.least) for r in rows.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("least")).collect())
    # the first row of each range stands again at the end of the range before, and of all at the end of the last
    moved = [(firsts[i - 1][0], *least) for i, (_, *least) in enumerate(firsts)] or [(0, 0, 0)]
    ends = docs.sparkSession.createDataFrame(moved, "range int, key bigint, tie bigint")
    again = rows.drop("range").join(F.broadcast(ends), ["key", "tie"]).groupBy("range", "key", "tie").agg(F.min("text").alias("text"))
    both = rows.select("id", "key", "tie", "text", "range", F.lit(0).alias("end")).unionByName(again.select(F.lit(None).cast(kind).alias("id"), "key", "tie", "text", "range", F.lit(1).alias("end")))
    dealt = both.repartitionById(parts, "range").sortWithinPartitions("range", "end", "key", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(k)

        def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
            edited = [edit(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
            own = sampler.signatures(texts)
            other = sampler.signatures(edited)
            text_of = lambda s: [x.tobytes().hex() for x in s.astype(">u2")]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(text_of(own[:-1]), pa.string()),
                    pa.array(text_of(other), pa.string()),
                    pa.array((own[:-1] == other).mean(axis=1)),
                    pa.array((own[:-1] == own[1:]).mean(axis=1)),
                ],
                [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        ids, texts, size, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for i, (t, end) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                texts.append(t.as_py())
                size += len(texts[-1])
                if end:
                    if ids:
                        yield emit(ids, texts)
                    ids, texts, size = [], [], 0
                    continue
                ids.append(batch.column(0)[i].as_py())
                if size > CHUNK and len(ids) > 1:
                    # the last one's next is still to come
                    yield emit(ids[:-1], texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    schema = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("id", "text", "end").mapInArrow(lean(run), schema)
