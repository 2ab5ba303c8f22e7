"""Features that at least two texts share, found by one shuffle of packed columns of the incidence matrix.

Both the n-gram join and substring removal start from here: a feature (a shingle, an anchor) that only one
text has can't link or repeat anything, so everything after works on what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import lean, signed, slices

_U = np.uint64
#: A feature travels as its upper 48 bits; its bucket is in the lower ones.
_BELOW = _U(16)
_LAST = _U((1 << 16) - 1)
#: A feature of so many texts of one slice isn't sent once per text: its texts are told right away, and its bucket gets a mark.
HOT = 64
#: The df of a marked feature: more than any count.
MARKED = 1 << 40
#: Packed bytes of a bucket at most, on average.
BUCKET_BYTES = 40 << 20
#: Features that a bucket's task works on at once; a fuller bucket is gone through in several turns over its packed rows.
TURN = 1_000_000

Extract = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def bucket_of(features: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket, one of a power of two: the lowest bits, which are even for minima of hashes too."""
    return features & _U(buckets - 1)


def reduced(features: np.ndarray, buckets: int) -> np.ndarray:
    """Feature hashes as they travel: 48 bits and those of their bucket, which from 2^16 buckets on are all 64."""
    return features & (~_LAST | _U(buckets - 1))


def _take(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of values[start:start + size]."""
    total = int(size.sum())
    if not total:
        return values[:0]
    at = np.ones(total, np.int64)
    full = size > 0
    start, size = start[full], size[full]
    at[0] = start[0]
    at[np.cumsum(size)[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return values[np.cumsum(at)]


def _pack(entity: np.ndarray, owner: np.ndarray, features: np.ndarray, marks: np.ndarray) -> bytes:
    """Entries of one bucket, ascending by owner: texts with their counts, then 48 bits of each feature; then marked features. A text of very many features stands several times."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    if len(begin) and (most := int(np.diff(np.concatenate([begin, [len(owner)]])).max())) > 65535:
        begin = np.union1d(begin, np.concatenate([begin + k for k in range(65535, most, 65535)]))
        begin = begin[begin < len(owner)]
    counts = np.diff(np.concatenate([begin, [len(owner)]])) if len(owner) else begin
    low = features >> _BELOW
    head = np.array([len(begin), len(features), len(marks)], np.uint32)
    parts = (head, entity[owner[begin]] if len(begin) else entity[:0], marks, counts.astype(np.uint16), low.astype(np.uint32), (low >> _U(32)).astype(np.uint16))
    return b"".join(x.tobytes() for x in parts)


def _unpack(blob: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, k = np.frombuffer(blob, np.uint32, 3)
    at = 12
    out = []
    for kind, count in ((np.uint64, n), (np.uint64, k), (np.uint16, n), (np.uint32, m), (np.uint16, m)):
        out.append(np.frombuffer(blob, kind, int(count), at))
        at += int(count) * np.dtype(kind).itemsize
    entity, marks, counts, low, high = out
    upper = low.astype(np.uint64) | (high.astype(np.uint64) << _U(32))
    return np.repeat(entity, counts), (upper << _BELOW) | (_U(bucket) & _LAST), marks


def _emit(bucket: list, kind: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _rows(entity: np.ndarray, feature: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(entity), 50_000):
        part = slice(at, at + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(signed(entity[part])), pa.array(signed(feature[part])), pa.array(df[part].astype(np.int64))], ["entity", "feature", "df"])


def bucket_count(features: int) -> int:
    """Buckets for so many features, a power of two: the fewer, the less often a text's id goes along with its features, so their size is what a task can hold packed."""
    return 1 << max(0, (features * 7 // BUCKET_BYTES).bit_length())


def shared_features(docs: DataFrame, extract: Extract, buckets: int) -> DataFrame:
    """Rows (entity, feature, df): each distinct text (entity) with each of its features that another one has too.

    `extract` gives a slice's entities (64 bits per text, equal for texts that count as one), their distinct
    features and the offsets of each text's. df is the number of entities with the feature, or MARKED if it is
    frequent within some slice; it is the same in all of a feature's rows. A row may come more than once.

    Features are dealt by hash into buckets of about equal size; each slice of the input sends a bucket one
    packed row: six bytes a feature, and ten for each text that has some there, so at most sixteen a feature.
    A feature that a third of all texts have sends one mark a slice, so no bucket grows with it.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                entity, features, offsets = extract(part)
                entity, at = np.unique(entity, return_index=True)
                size = (offsets[1:] - offsets[:-1])[at]
                features = _take(features, offsets[:-1][at], size)
                owner = np.repeat(np.arange(len(at)), size)
                if not len(features):
                    continue
                bucket = bucket_of(features, buckets).astype(np.int64)
                features = reduced(features, buckets)
                # a coarse count first, an exact one for what may be frequent
                cell = (features ^ (features >> _U(17))) & _U((1 << 20) - 1)
                maybe = np.flatnonzero(np.bincount(cell, minlength=1 << 20)[cell] >= HOT)
                marks = features[:0]
                if len(maybe):
                    value, back, count = np.unique(features[maybe], return_inverse=True, return_counts=True)
                    marks, hot = value[count >= HOT], maybe[count[back] >= HOT]
                    if len(hot):
                        # dealt evenly by what they hold, not by their bucket
                        blob = np.concatenate([entity[owner[hot]], features[hot]]).tobytes()
                        yield _emit([int(features[hot].sum() % _U(buckets))], [1], [blob])
                        rest = np.ones(len(features), bool)
                        rest[hot] = False
                        features, owner, bucket = features[rest], owner[rest], bucket[rest]
                order = np.argsort(bucket * len(entity) + owner, kind="stable")
                features, owner, bucket = features[order], owner[order], bucket[order]
                marks = marks[np.argsort(bucket_of(marks, buckets), kind="stable")]
                of_marks = bucket_of(marks, buckets).astype(np.int64)
                used = np.union1d(bucket, of_marks)
                lo, hi = np.searchsorted(bucket, used), np.searchsorted(bucket, used, side="right")
                mlo, mhi = np.searchsorted(of_marks, used), np.searchsorted(of_marks, used, side="right")
                yield _emit(used.tolist(), [0] * len(used), [_pack(entity, owner[a:b], features[a:b], marks[c:d]) for a, b, c, d in zip(lo, hi, mlo, mhi, strict=True)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list) -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            entity, feature, marks = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(feature)
            entity, feature = entity[order], feature[order]
            first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]])) if len(feature) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([first, [len(feature)]]))
            marked = np.isin(feature[first], marks)
            some = (size > 1) | marked
            first, size, marked = first[some], size[some], marked[some]
            entity, feature, run = _take(entity, first, size), _take(feature, first, size), np.repeat(np.arange(len(first)), size)
            # equal texts of several slices count once
            order = np.lexsort((entity, run))
            entity, feature, run = entity[order], feature[order], run[order]
            own = np.ones(len(run), bool)
            own[1:] = (run[1:] != run[:-1]) | (entity[1:] != entity[:-1])
            entity, feature, run = entity[own], feature[own], run[own]
            df = np.where(marked, MARKED, np.bincount(run, minlength=len(first)))[run]
            yield from _rows(entity[df > 1], feature[df > 1], df[df > 1])

        held: dict[int, list] = {}
        for batch in batches:
            blobs = batch.column(2)
            for k, (bucket, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                blob = blobs[k].as_py()
                if kind:
                    pair = np.frombuffer(blob, np.uint64)
                    entity, feature = pair[: len(pair) // 2], pair[len(pair) // 2 :]
                    yield from _rows(entity, feature, np.full(len(entity), MARKED))
                else:
                    held.setdefault(bucket, []).append(blob)
        for bucket, packed in held.items():
            turns = sum(int(np.frombuffer(x, np.uint32, 2)[1]) for x in packed) // TURN + 1
            for turn in range(turns):
                parts = []
                for x in packed:
                    entity, feature, marks = _unpack(x, bucket)
                    if turns > 1:
                        own, own_marks = (feature >> _U(20)) % _U(turns) == turn, (marks >> _U(20)) % _U(turns) == turn
                        entity, feature, marks = entity[own], feature[own], marks[own_marks]
                    parts.append((entity, feature, marks))
                yield from found(parts)

    dealt = docs.mapInArrow(lean(deal), "bucket int, kind int, blob binary")
    return dealt.repartitionById(buckets, "bucket").mapInArrow(lean(meet), "entity bigint, feature bigint, df bigint")
