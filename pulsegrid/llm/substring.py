"""Substring deduplication with suffix automata of reference shards.

A window is W consecutive words of one document; a word goes if a window over it also starts in a document of a
smaller id. Not every document can meet every automaton, so texts are cut by content first: the anchor of a
window is the least hash among the runs of ANCHOR words within it, which equal windows share. Anchors that one
text alone has are put aside; around the others, texts are cut into segments of windows with one anchor. A
reference shard is the segments of some anchors, in ascending order of document; its automaton is built as the
segments stream through it, and the matching statistics tell, for every window, the first document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, gram_hashes, lean, mix, ragged_unique, signed, slices
from .shared import _take, bucket_count, reduced, shared_features
from .workspace import Workspace

#: Words of an anchor.
ANCHOR = 5
#: Windows of a segment at most; longer runs of one anchor are cut.
RUN = 64
#: An anchor of more texts is split by its windows: each is a segment of its own with a key of its own.
SPLIT = 256
#: Words of an automaton.
SHARD_WORDS = 50_000

_U = np.uint64


class SuffixAutomaton:
    """A suffix automaton of several word sequences. Each state knows the first document that had its strings; sequences must come in ascending order of document."""

    __slots__ = ("first", "length", "link", "to")

    def __init__(self) -> None:
        self.to: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.to)
        self.to.append(dict(self.to[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        to, link = self.to, self.link
        while p >= 0 and to[p].get(c) == q:
            to[p][c] = new
            p = link[p]
        self.link[q] = new
        return new

    def add(self, words: list[int], doc: int) -> None:
        to, link, length, first = self.to, self.link, self.length, self.first
        last = 0
        for c in words:
            q = to[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new, p = len(to), last
            to.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(doc)
            while p >= 0 and c not in to[p]:
                to[p][c] = new
                p = link[p]
            if p >= 0:
                q = to[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def firsts(self, words: list[int], w: int, own: int) -> list[int]:
        """For each window of w words the first document that had it, `own` if none had."""
        to, link, length, first = self.to, self.link, self.length, self.first
        state = matched = 0
        out = []
        for i, c in enumerate(words):
            while state and c not in to[state]:
                state = link[state]
                matched = length[state]
            if c in to[state]:
                state = to[state][c]
                matched += 1
            if i >= w - 1:
                if matched >= w:
                    s = state
                    while length[link[s]] >= w:
                        s = link[s]
                    out.append(first[s])
                else:
                    out.append(own)
        return out


def window_anchors(words: Words, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a slice: where they start, their text, and their anchor."""
    n = len(words.hash) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(words.hash, min(ANCHOR, w))
    low, span, have = grams, w - min(ANCHOR, w) + 1, 1
    while have < span:  # minima over doubled stretches
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    owner = words.text_of()
    at = np.flatnonzero(np.arange(n) + w <= words.first[1:][owner[:n]])
    return at, owner[at], low[at]


def _segments(words: Words, at: np.ndarray, owner: np.ndarray, anchor: np.ndarray, hot: np.ndarray, big: np.ndarray, w: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one shared anchor: first word, number of words, text and key of each segment."""
    keep = np.isin(anchor, hot)
    at, owner, anchor = at[keep], owner[keep], anchor[keep]
    split = np.isin(anchor, big)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(at)]])))
    new |= (within % RUN == 0) | split
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate([begin, [len(at)]])) + w - 1
    key = anchor[begin]
    alone = split[begin]
    if alone.any():
        key = key.copy()
        key[alone] = mix(key[alone] ^ gram_hashes(words.hash, w)[at[begin[alone]]])
    return at[begin], size, owner[begin], key


def _hits(docs: DataFrame, ws: Workspace, w: int, shard_words: int) -> DataFrame:
    """Rows (id, th, spans): per distinct text and id the windows to remove, as structs of a first word and flags; spans is null if the whole text is a copy."""
    # about one anchor in five words of six bytes
    buckets = bucket_count((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 30)
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = docs.where("id IS NOT NULL").select("id", "text", "th")

    def extract(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = Words(part.column(0))
        _, owner, anchor = window_anchors(words, w)
        values, offsets = ragged_unique(anchor, owner, part.num_rows)
        return part.column(1).to_numpy().view(np.uint64), values, offsets

    found = shared_features(text.select("text", "th"), extract, buckets)
    shared = found.groupBy("entity").agg(F.collect_set(F.struct("feature", (F.col("df") > SPLIT).alias("big"))).alias("anchors"))
    shared = ws.save(shared.withColumnRenamed("entity", "th"), "anchors")
    ids = ws.save(text.select("id", "th").distinct(), "ids")
    least = ws.save(ids.groupBy("th").agg(F.min("id").alias("rep")), "least")
    own = least.join(shared, "th").select(F.col("rep").alias("id"), "th", "anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                flat = pc.list_flatten(part.column(3))
                if not len(flat):
                    continue
                features = flat.field(0).to_numpy().view(np.uint64)
                big = np.unique(features[flat.field(1).to_numpy(zero_copy_only=False)])
                words = Words(part.column(1))
                at, owner, anchor = window_anchors(words, w)
                start, size, owner, key = _segments(words, at, owner, reduced(anchor, buckets), np.unique(features), big, w)
                if not len(start):
                    continue
                data = _take(words.hash, start, size)
                ends = np.concatenate([[0], np.cumsum(size)])
                view = memoryview(data).cast("B")
                seg = np.array([xxhash.xxh3_64_intdigest(view[8 * a : 8 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64)
                doc = part.column(0).to_numpy()[owner]
                # words travel once a slice and segment, with its least document
                order = np.lexsort((doc, key, seg))
                one = np.ones(len(order), bool)
                one[1:] = (seg[order][1:] != seg[order][:-1]) | (key[order][1:] != key[order][:-1])
                last = doc[order][np.concatenate([np.flatnonzero(one)[1:], [len(order)]]) - 1]
                carry, most = np.zeros(len(order), bool), doc.copy()
                carry[order[one]], most[order[one]] = True, last
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(seg), [None, pa.py_buffer(8 * ends), pa.py_buffer(data)])
                raw = pc.if_else(pa.array(carry), raw, pa.scalar(None, pa.large_binary())).cast(pa.binary())
                th = part.column(2).take(pa.array(owner))
                out = [pa.array(doc), th, pa.array((start - words.first[owner]).astype(np.int64)), pa.array(signed(key)), pa.array(signed(seg)), pa.array(most), raw]
                yield pa.RecordBatch.from_arrays(out, ["id", "th", "at", "key", "seg", "last", "words"])

    whole = text.join(own, ["id", "th"]).select("id", "text", "th", "anchors")
    segments = ws.save(whole.mapInArrow(lean(cut), "id bigint, th bigint, at bigint, key bigint, seg bigint, last bigint, words binary"), "segments")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(rows: dict) -> Iterator[pa.RecordBatch]:
            automaton, out = SuffixAutomaton(), []
            for (key, seg), (doc, last, words) in sorted(rows.items(), key=lambda x: x[1][0]):
                seq = memoryview(words).cast("Q").tolist()
                firsts = automaton.firsts(seq, w, doc)
                automaton.add(seq, doc)
                if min(firsts) < last:
                    out.append((key, seg, firsts))
            for i in range(0, len(out), 20_000):
                k, s, f = zip(*out[i : i + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(f, pa.list_(pa.int64()))], ["key", "seg", "firsts"])

        rows: dict = {}
        held, now = 0, None
        for batch in batches:
            for key, seg, doc, last, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != now and held > shard_words:
                    yield from shard(rows)
                    rows, held = {}, 0
                now = key
                old = rows.get((key, seg))
                if old is None:
                    rows[key, seg] = (doc, last, words)
                    held += len(words) // 8
                else:
                    rows[key, seg] = (min(doc, old[0]), max(last, old[1]), words)
        yield from shard(rows)

    streams = segments.where("words IS NOT NULL").select("key", "seg", "id", "last", "words")
    matched = streams.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(lean(match), "key bigint, seg bigint, firsts array<bigint>")
    hit = segments.select("id", "th", "at", "key", "seg").join(matched, ["key", "seg"])
    hit = hit.select("id", "th", "at", F.transform("firsts", lambda f: f < F.col("id")).alias("flags")).where(F.exists("flags", lambda x: x))
    spans = hit.groupBy("id", "th").agg(F.collect_list(F.struct("at", "flags")).alias("spans"))
    copies = ids.join(least, "th").where("rep < id").select("id", "th", F.lit(None).cast("array<struct<at:bigint,flags:array<boolean>>>").alias("spans"))
    return ws.save(spans.unionByName(copies), "spans")


def remove(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, prefix: str = "", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows of docs with the words of repeated windows removed: all their columns, and n_words, n_removed, kept_sha256.

    A window of `window` words is repeated if its word sequence also starts in a document with a smaller id;
    windows are judged on the input. kept_sha256 is of the kept words joined by one space. With keep_text the
    text column holds these joined words where something was removed, and the text as it was elsewhere; without,
    the text column is left out. A null text has no words and stays null. Rows of null id lose nothing and take
    nothing from others; rows of one id take nothing from each other. Ids are integers. Added columns, whose
    names `prefix` goes before, replace columns of their names.
    """
    ws = Workspace(docs.sparkSession, "substring")
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    hits = _hits(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), th.alias("th")), ws, window, shard_words)
    hits = hits.select(F.col("id").alias("__sub_id"), F.col("th").alias("__sub_th"), F.col("spans").alias("__sub_spans"), F.lit(True).alias("__sub_hit"))
    added = [f"{prefix}{x}" for x in ("n_words", "n_removed", "kept_sha256")]
    base = [c for c in docs.columns if c not in added and c != text_col]
    joined = docs.select(*base, F.col(text_col).alias("__sub_text"), th.alias("__sub_key")).join(hits, (F.col(id_col).cast("bigint") == F.col("__sub_id")) & (F.col("__sub_key") == F.col("__sub_th")), "left")
    fields = [docs.schema[c] for c in base] + ([docs.schema[text_col]] if keep_text else [])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"`{n}` {t}" for n, t in zip(added, ("bigint", "bigint", "string"), strict=True)]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__sub_text"):
                n, gone, sha, texts = [], [], [], []
                for text, spans, hit in zip(batch.column("__sub_text"), batch.column("__sub_spans").to_pylist(), batch.column("__sub_hit").to_pylist(), strict=True):
                    text = text.as_py()
                    words = (text or "").encode().split()
                    mask = _covered(len(words), spans, hit, window)
                    if mask is not None and mask.any():
                        words_left = [x for x, m in zip(words, mask.tolist(), strict=True) if not m]
                        kept = b" ".join(words_left)
                        gone.append(len(words) - len(words_left))
                        text = kept.decode()
                    else:
                        kept = b" ".join(words)
                        gone.append(0)
                    n.append(len(words))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        texts.append(text)
                out = [batch.column(c) for c in base] + ([pa.array(texts, pa.string())] if keep_text else [])
                yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], [*base, *[text_col] * keep_text, *added])

    out = joined.select(*base, "__sub_text", "__sub_spans", "__sub_hit").mapInArrow(lean(apply), schema)
    return out.select(*[c for c in docs.columns if c in base or (keep_text and c == text_col)], *added)


def _covered(n: int, spans: list | None, hit: bool | None, w: int) -> np.ndarray | None:
    """Which of n words a repeated window covers; None for none."""
    if not hit or n < w:
        return None
    if spans is None:
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        at = s["at"] + np.flatnonzero(s["flags"])
        np.add.at(edge, at, 1)
        np.add.at(edge, at + w, -1)
    return np.cumsum(edge[:-1]) > 0
