"""Language-model scores by online logistic context mixing.

A text is a sequence of words and an end. Each word is a path of binary decisions down a Huffman tree of
frequent words; a word that isn't in the tree takes an escape and is spelled, byte by byte, down a second one.
Several predictors guess each decision from counts kept by hashed contexts. Their guesses, as log odds, are added up
with weights that a gate chooses and that adapt to the text, and the sum is refined by a map that learns how
far it can be trusted. The bits of all decisions are the text's length in bits.

Counts are sums over all training texts, made by Spark; scoring a text needs tables of bounded size only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Words, lean, mix, signed, slices
from .workspace import Workspace

#: Words in the tree at most: those of the highest counts, of two at least, so that what is seen once tells how often a word is new.
WORDS = 1 << 17
#: Slots of a hashed predictor's table, as a power of two, and slots that a row of counts has when they are added up.
SLOT_BITS, CHUNK_BITS = 22, 16
#: Newton steps at most for the gates' weights, and the change of a weight that ends them.
NEWTON, STILL = 12, 1e-4
#: Where the weights are fitted: levels above none, and under it, of a predictor's log odds, and of a text's own counts; levels of the latter in a unit of log odds.
FINE, COARSE, OWN_SCALE = 15, 7, np.float32(1.25)
#: Training words per task that gathers counts, so that the tables sent to be added up are few against the input.
TASK_WORDS = 8 << 20
#: Symbols of a text before weights, map and own counts adapt for the first time; then after each eighth more, and LAST at most.
BLOCK, LAST = 32, 4096
#: Decisions near the root that a text keeps its own counts of.
OWN = 256
#: What is added to counts for log odds, in units of 1/SCALE; adaption of weights, and decisions from which a block counts no more than so many; weight of the map's start, and its cells.
PRIOR, SCALE, RATE, ENOUGH, STEADY, CELLS = 0.4, 16, 0.004, 256, 24, 33
#: Symbols whose decisions are held at once, if a block has no more.
HELD = 1 << 16
#: Words that are gathered before equal ones are counted as one, and pairs of a symbol and a context.
GATHERED, PAIRS = 1 << 20, 1 << 21
#: Log odds of the mix at most.
SURE = np.float32(11.5)
HASHED, INPUTS, LEVELS = 3, 4, 8
#: The upper bits of a hash that words are found by.
INDEX_BITS = 20
GATES = LEVELS * 4

_U = np.uint64
_END = _U(0x243F6A8885A308D3)
#: In place of a word's hash, how often each byte and a word's end stands in the texts.
_BYTES = _END + np.arange(1, 258, dtype=_U)
_STEP = _U(0x9E3779B97F4A7C15)
#: Hashes of nodes, and of slots, in 32 bits.
_NODE, _SLOT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Where a decision's own, level (a multiple of 4) and node stand in one number after its bit.
_OWN_AT, _LEVEL_AT, _NODE_AT = np.uint32(1), np.uint32(8), np.uint32(13)
_ONE, _OWN_MASK, _LEVEL_MASK = np.uint32(1), np.uint32(511), np.uint32(28)
_LOW = _U((1 << 32) - 1)
#: In place of the byte before a word's first.
_START = _U(256)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] each, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman paths of symbols 0, 1, ...: where each symbol's path starts (one more entry than symbols), and the nodes and bits of all paths. Node 0 is the root, heavier nodes come first."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    for new in range(n, 2 * n - 1):
        (v, a), (w, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = new
        side[b] = 1
        heapq.heappush(heap, (v + w, new))
    at, leaf, steps = np.arange(n), np.arange(n), []
    while len(at) and (above := at != 2 * n - 2).any():
        at, leaf = at[above], leaf[above]
        steps.append((leaf, 2 * n - 2 - parent[at], side[at]))
        at = parent[at]
    if not steps:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
    leaf, node, bit = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.lexsort((-up, leaf))
    start = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))])
    return start, node[order], bit[order].astype(np.int64)


@dataclass
class Coding:
    """Words in the tree, by rising hash, with their counts, and the paths of all symbols: words, escape, end, then bytes and a word's end. `steps` has the bit, own, level and node of each decision in one number; `own` is its number among those that a text counts itself, or OWN; `index` has the first word of each range of hashes."""

    hashes: np.ndarray
    counts: np.ndarray
    start: np.ndarray
    steps: np.ndarray
    index: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray, escaped: int, ends: int, byte_counts: np.ndarray) -> Coding:
        """Of words by rising hash with counts, training words not among them, training texts, and how often bytes and a word's end are spelled."""
        start, nodes, bits = tree(np.concatenate([counts, [escaped + 1, ends + 1]]))
        start2, nodes2, bits2 = tree(byte_counts + 1)
        words, start = start[-1], np.concatenate([start, start2[1:] + start[-1]])
        nodes, bits = np.concatenate([nodes, nodes2]), np.concatenate([bits, bits2])
        assert nodes.max() < 1 << (32 - int(_NODE_AT))
        depth = np.arange(len(nodes)) - np.repeat(start[:-1], np.diff(start))
        level = np.concatenate([np.searchsorted([3, 6, 10, 14], depth[:words], side="right"), 5 + np.searchsorted([2, 4], depth[words:], side="right")])
        own = np.minimum(nodes, OWN)
        own[words:] = OWN
        steps = bits | own << int(_OWN_AT) | level * 4 << int(_LEVEL_AT) | nodes << int(_NODE_AT)
        return Coding.unpacked((hashes, counts, start.astype(np.int32), steps.astype(np.uint32)))

    def packed(self) -> tuple:
        """What tasks are sent."""
        return self.hashes, self.counts, self.start.astype(np.int32), self.steps

    @staticmethod
    def unpacked(packed: tuple) -> Coding:
        hashes, counts, start, steps = packed
        index = np.zeros((1 << INDEX_BITS) + 1, np.int32)
        np.cumsum(np.bincount((hashes >> _U(64 - INDEX_BITS)).astype(np.int64), minlength=1 << INDEX_BITS), out=index[1:])
        return Coding(hashes, counts, start.astype(np.int64), steps, index)

    @cached_property
    def nodes(self) -> np.ndarray:
        return self.steps >> _NODE_AT

    @cached_property
    def bits(self) -> np.ndarray:
        return self.steps & _ONE

    @cached_property
    def level(self) -> np.ndarray:
        return self.steps >> _LEVEL_AT & _LEVEL_MASK

    @cached_property
    def own(self) -> np.ndarray:
        return self.steps >> _OWN_AT & _OWN_MASK

    @property
    def escape(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the words, or the number of words."""
        out = np.full(len(hashes), len(self.hashes))
        cell = (hashes >> _U(64 - INDEX_BITS)).astype(np.int64)
        at, stop = self.index[cell], self.index[cell + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            same = self.hashes[at[left]] == hashes[left]
            out[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


@dataclass
class Symbols:
    """The symbols of some texts in order of (block, text): symbol, contexts, text; where blocks start. Texts are numbered by falling length; `place` is the number of each in the slice."""

    symbol: np.ndarray
    contexts: list
    text: np.ndarray
    blocks: np.ndarray
    place: np.ndarray
    words: Words
    found: np.ndarray


def _edges(longest: int) -> np.ndarray:
    """Where blocks of a text of so many symbols start."""
    out = [0]
    while out[-1] < longest:
        out.append(out[-1] + min(LAST, max(BLOCK, out[-1] // 8)))
    return np.array(out)


def symbols(column: pa.Array, coding: Coding) -> Symbols:
    w = Words(column, lower=True)
    per = w.counts() + 1
    ends = np.cumsum(per) - 1
    total, n = int(per.sum()), len(per)
    first = ends - per + 1
    is_end = np.zeros(total, bool)
    is_end[ends] = True
    at = np.flatnonzero(~is_end)
    hashes, tail, size, begin = np.zeros(total, _U), np.zeros(total, _U), np.zeros(total, np.int64), np.zeros(total, np.int64)
    found = coding.find(w.hash)
    symbol = np.full(total, coding.escape + 1)
    hashes[at], symbol[at], size[at], begin[at] = w.hash, found, w.end - w.start, w.start
    if len(at):
        tail[at] = w.data[w.end - 1].astype(_U) | (np.where(size[at] > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(_U) << _U(8))

    def before(values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        out[1:] = values[:-1]
        out[first] = 0
        return out

    one, near = before(hashes), before(tail)
    short = lambda h: (mix(h) >> _U(32)).astype(np.uint32)
    contexts = [short(one + _U(1)), short((near | before(near) << _U(16)) + (_U(2) << _U(40))), short(one * _STEP + before(one) + _U(3))]

    escaped = np.flatnonzero(symbol == coding.escape)
    runs = np.ones(total, np.int64)
    runs[escaped] += size[escaped] + 1
    head = np.cumsum(runs) - runs
    out = np.empty(int(runs.sum()), np.int64)
    wide = [np.empty(len(out), np.uint32) for _ in contexts]
    out[head] = symbol
    for to, own in zip(wide, contexts, strict=True):
        to[head] = own
    if len(escaped):
        spelled = size[escaped] + 1
        to, j = _ranges(head[escaped] + 1, spelled), _ranges(np.zeros(len(escaped), np.int64), spelled)
        byte = np.repeat(begin[escaped], spelled) + j
        last = j == np.repeat(size[escaped], spelled)
        value = w.data[np.minimum(byte, len(w.data) - 1)].astype(np.int64)
        out[to] = coding.escape + 2 + np.where(last, 256, value)
        back = [np.where(j >= m, w.data[np.maximum(byte - m, 0)].astype(_U), _START) for m in (1, 2, 3, 4)]
        seen = back[0]
        for k in range(HASHED):
            seen = seen | back[k + 1] << _U(9 * (k + 1))
            wide[k][to] = short(seen + (_U(4 + k) << _U(40)))

    sizes = np.add.reduceat(runs, first) if n else np.zeros(0, np.int64)
    place = np.argsort(-sizes, kind="stable")
    edges = _edges(int(sizes.max()) if n else 0)
    # of each block, the texts that reach it, the longest first
    begins, falling = (np.cumsum(sizes) - sizes)[place], sizes[place]
    reach = np.searchsorted(-falling, -edges[:-1])
    block, text = np.repeat(np.arange(len(reach)), reach), _ranges(np.zeros(len(reach), np.int64), reach)
    count = np.minimum(falling[text], edges[block + 1]) - edges[block]
    order = _ranges(begins[text] + edges[block], count)
    text, blocks = np.repeat(text, count), np.concatenate([[0], np.cumsum(np.bincount(block, count, len(reach)).astype(np.int64))])
    return Symbols(out[order], [c[order] for c in wide], text, blocks, place, w, found)


def steps(symbol: np.ndarray, coding: Coding) -> tuple[np.ndarray, ...]:
    """How many decisions each symbol has, and for each decision the number of its symbol, the hash of its node, and what is kept of it."""
    start = coding.start.take(symbol, mode="clip")
    size = coding.start[1:].take(symbol, mode="clip") - start
    of = np.repeat(np.arange(len(symbol)), size)
    start -= np.cumsum(size) - size
    at = start.take(of, mode="clip")
    at += np.arange(len(at))
    mark = coding.steps.take(at, mode="clip")
    node = mark >> _NODE_AT
    node *= _NODE
    return size, of, node, mark


def slots(context: np.ndarray, of: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The cell of a predictor's table for each decision of symbols in a context each."""
    out = context.take(of, mode="clip")
    out ^= node
    out *= _SLOT
    out >>= np.uint32(32 - SLOT_BITS)
    return out.astype(np.int64)


@dataclass
class Model:
    """A coding, the predictors' log odds as bytes, and the weights of each gate."""

    coding: Coding
    tables: list
    weights: np.ndarray


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _runs(s: Symbols) -> Iterator[tuple[int, int]]:
    """Runs of blocks, from one to before another, whose decisions are held at once."""
    block = 0
    while block < len(s.blocks) - 1:
        to = block + 1
        while to < len(s.blocks) - 1 and s.blocks[to + 1] - s.blocks[block] <= HELD:
            to += 1
        yield block, to
        block = to


def _own_odds(own: np.ndarray) -> np.ndarray:
    """Log odds of texts' own counts of zeros and of ones."""
    odds = own[1] + np.float32(PRIOR)
    odds /= own[0] + np.float32(PRIOR)
    np.log(odds, out=odds)
    odds[OWN :: OWN + 1] = 0
    return odds


def mixed(s: Symbols, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block: texts' first decisions, and the final probability of each decision as it was. What is learned from a block holds from the next one on, for its own text alone."""
    n, coding = len(s.place), model.coding
    weights, unit = np.ascontiguousarray(model.weights.T, np.float32), np.float32(1 / SCALE)
    drift = np.zeros((INPUTS, n), np.float32)
    # a text's own counts, its map and its gates' weights all have as many places, so that one number tells where they begin
    places = OWN + 1
    own, seen = np.zeros((2, n * places), np.float32), np.ones((2, n, places), np.float32)
    start = _squash(np.arange(CELLS, dtype=np.float32) / 2 - CELLS // 4)
    seen[:, :, :CELLS] = (np.stack([1 - start, start]) * np.float32(STEADY))[:, None]
    gated, trust = np.zeros((n, places), np.float32), np.zeros((2, n, places), np.float32)
    for block, to in _runs(s):
        base = s.blocks[block]
        size, of, node, mark = steps(s.symbol[base : s.blocks[to]], coding)
        x = np.empty((INPUTS, len(mark)), np.float32)
        gate = mark >> _LEVEL_AT & _LEVEL_MASK
        for k, c in enumerate(s.contexts):
            odds = model.tables[k].take(slots(c[base : s.blocks[to]], of, node), mode="clip")
            np.multiply(odds, unit, out=x[k])
            if k != 1:
                gate += (odds != 0).view(np.uint8) << np.uint8(k // 2)
        begin = np.concatenate([[0], np.cumsum(size)])
        for b in range(block, to):
            symbol = slice(s.blocks[b] - base, s.blocks[b + 1] - base)
            part = slice(int(begin[symbol.start]), int(begin[symbol.stop]))
            if part.start == part.stop:
                continue
            # each text's first decision here, and how many it has
            texts = int(s.text[base + symbol.stop - 1]) + 1
            firsts = begin[symbol][np.searchsorted(s.text[base:][symbol], np.arange(texts))] - part.start
            count = np.diff(np.append(firsts, part.stop - part.start))
            z, m, at = x[:, part], mark[part], np.repeat(np.arange(texts) * places, count)
            bit = m & _ONE
            ones = np.multiply(bit, own.shape[1], dtype=np.int64)
            # -1 for a one, 1 for a zero
            sign = bit.astype(np.float32)
            sign *= np.float32(-2)
            sign += np.float32(1)
            m = m >> _OWN_AT
            m &= _OWN_MASK
            mine = at + m
            _own_odds(own[:, : texts * places]).take(mine, out=z[INPUTS - 1], mode="clip")
            own_gate = at + gate[part]
            total, held = np.zeros(len(m), np.float32), np.empty(len(m), np.float32)
            for k in range(INPUTS):
                np.add(drift[k, :texts, None], weights[k], out=gated[:texts, :GATES])
                gated.ravel().take(own_gate, out=held, mode="clip")
                held *= z[k]
                total += held
            np.clip(total, -SURE, SURE, out=total)
            # the odds against what was, and its probability
            against = np.multiply(total, sign, out=held)
            np.exp(against, out=against)
            p = against + np.float32(1)
            np.reciprocal(p, out=p)
            total *= np.float32(2)
            total += np.float32(CELLS // 2 + 0.5)
            np.clip(total, 0, CELLS - 1, out=total)
            cell = total.astype(np.int64)
            cell += at
            cell += ones
            map_ = seen[:, :texts, :CELLS]
            np.divide(map_, map_[0] + map_[1], out=trust[:, :texts, :CELLS])
            found = trust.ravel().take(cell, out=total, mode="clip")
            found += p
            found *= np.float32(0.5)
            yield firsts, found
            np.add.at(seen.ravel(), cell, np.float32(1))
            miss, rate = np.multiply(against, p, out=against), (-RATE / (1 + count / ENOUGH)).astype(np.float32)
            miss *= sign
            for k in range(INPUTS):
                z[k] *= miss
                drift[k, :texts] += np.add.reduceat(z[k], firsts) * rate
            mine += ones
            np.add.at(own.ravel(), mine, np.float32(1))


def bits(s: Symbols, model: Model) -> np.ndarray:
    """The natural logarithm of each text's probability, in the slice's order."""
    out = np.zeros(len(s.place))
    for firsts, p in mixed(s, model):
        out[: len(firsts)] += np.add.reduceat(np.log(p).astype(np.float64), firsts)
    back = np.empty_like(out)
    back[s.place] = out
    return back


def _counted(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of those in ascending order, and the sums of their counts."""
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by hash, of ends, and of the words' bytes and ends."""

    def send(hashes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"h": signed(hashes), "n": n}).to_batches(max_chunksize=100_000)

    held, n = np.zeros(0, _U), np.zeros(0, np.int64)
    spelled, ends, parts, size = np.zeros(257, np.int64), 0, [], 0

    def merge() -> None:
        nonlocal held, n, size
        new = np.sort(np.concatenate([held[:0], *parts]))
        new, times = _counted(new, np.ones(len(new), np.int64))
        parts.clear()
        both, size = np.concatenate([held, new]), 0
        # two ascending runs
        order = np.argsort(both, kind="stable")
        held, n = _counted(both[order], np.concatenate([n, times])[order])

    for batch in batches:
        for part in slices(batch):
            w = Words(part.column(0), lower=True)
            spelled[:256] += np.bincount(w.data, minlength=256)
            spelled[256] += len(w.hash)
            ends += part.num_rows
            parts.append(w.hash)
            size += len(w.hash)
            if size > GATHERED:
                merge()
                if len(held) > 1 << 20:
                    yield from send(held, n)
                    held, n = held[:0], n[:0]
    merge()
    yield from send(held, n)
    if ends:
        yield from send(np.array([_END]), np.array([ends]))
    # space and U+0009 to U+000D are never spelled
    spelled[[32, *range(9, 14)]] = 0
    yield from send(_BYTES[spelled > 0], spelled[spelled > 0])


_PACKED = "part int, counts binary, cells int, width int"


def _packed(part: int, counts: np.ndarray, codec: pa.Codec) -> dict:
    """A row of counts, packed by the bytes of their numbers, as few as hold them."""
    counts = counts.astype(np.int16 if counts.max() < 1 << 15 else np.int32 if counts.max() < 1 << 31 else np.int64, copy=False)
    planes = np.ascontiguousarray(counts.view(np.uint8).reshape(-1, counts.itemsize).T)
    return {"part": pa.array([part], pa.int32()), "counts": pa.array([codec.compress(planes.tobytes(), asbytes=True)], pa.binary()), "cells": pa.array([len(counts)], pa.int32()), "width": pa.array([counts.itemsize], pa.int32())}


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    zstd = pa.Codec("zstd")
    for batch in batches:
        for part, packed, cells, width in zip(*[batch.column(k) for k in range(4)], strict=True):
            cells, width = cells.as_py(), width.as_py()
            planes = np.frombuffer(zstd.decompress(packed.as_py(), decompressed_size=cells * width), np.uint8).reshape(width, cells)
            yield part.as_py(), np.ascontiguousarray(planes.T).view(f"i{width}").ravel()


def _levels(odds: np.ndarray) -> np.ndarray:
    """Levels of log odds as in a table, 1 to 2 * FINE + 1; none at all has one of its own."""
    size = np.maximum(np.rint(np.abs(odds.astype(np.float32)) * np.float32(FINE / 127)), odds != 0)
    return (np.sign(odds) * size + (FINE + 1)).astype(np.uint8)


def _meeting(s: Symbols, coding: Coding, levels: list, own: np.ndarray, block: int, to: int) -> np.ndarray:
    """For each decision of a run of blocks, where its zeros or ones are counted by what is known about it: its level in the coding, 3 bits, those of the predictors' log odds, 5 each, and that of the text's own counts, 4. Adds the run to the texts' own counts."""
    base, stop = s.blocks[block], s.blocks[to]
    size, of, node, mark = steps(s.symbol[base:stop], coding)
    out = mark >> _LEVEL_AT & _LEVEL_MASK
    out <<= np.uint32(17)
    for k, c in enumerate(s.contexts):
        level = levels[k].take(slots(c[base:stop], of, node), mode="clip").astype(np.uint32)
        level <<= np.uint32(14 - 5 * k)
        out |= level
    begin = np.concatenate([[0], np.cumsum(size)])
    for b in range(block, to):
        symbol = slice(s.blocks[b] - base, s.blocks[b + 1] - base)
        part = slice(int(begin[symbol.start]), int(begin[symbol.stop]))
        if part.start == part.stop:
            continue
        m, used = mark[part], (int(s.text[base + symbol.stop - 1]) + 1) * (OWN + 1)
        mine = np.repeat(s.text[base:][symbol] * (OWN + 1), size[symbol])
        mine += m >> _OWN_AT & _OWN_MASK
        odds = np.clip(np.rint(_own_odds(own[:, :used]) * OWN_SCALE), -COARSE, COARSE) + np.float32(COARSE + 1)
        out[part] |= odds.astype(np.uint32).take(mine, mode="clip")
        mine += (m & _ONE).astype(np.int64) * own.shape[1]
        np.add.at(own.ravel(), mine, np.float32(1))
    return out.astype(np.int64) * 2 + (mark & _ONE)


def _count_pairs(counts: np.ndarray, pairs: np.ndarray, coding: Coding) -> None:
    """Adds up in the cells of a predictor's table the zeros and ones of symbols, the upper 32 bits of each pair, and their contexts, the lower ones. A path is walked once for all equal pairs."""
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    times, pairs = np.diff(np.append(first, len(pairs))).astype(np.int32), pairs[first]
    for at in range(0, len(pairs), HELD):
        some = pairs[at : at + HELD]
        _, of, node, mark = steps((some >> _U(32)).astype(np.int64), coding)
        cell = slots((some & _LOW).astype(np.uint32), of, node)
        cell *= 2
        cell += mark & _ONE
        np.add.at(counts, cell, times[at : at + HELD].take(of, mode="clip"))


def _count_cells(shared, counting: bool, levels=None):
    """Rows of packed counts of zeros and ones over all texts of a task: of the predictors' cells, if counting; given levels of log odds, of what is met with them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = Coding.unpacked(shared.value)
        counts = {k: np.zeros(2 << SLOT_BITS, np.int32) for k in [*range(HASHED if counting else 0), *([] if levels is None else [HASHED])]}
        some, held, pairs = False, 0, [[] for _ in range(HASHED)]

        def count() -> None:
            for k, own in enumerate(pairs):
                if own:
                    whole = np.concatenate(own)
                    own.clear()
                    _count_pairs(counts[k], whole, coding)

        for batch in batches:
            for part in slices(batch, size=1 << 20):
                s = symbols(part.column(0), coding)
                if counting:
                    for own, c in zip(pairs, s.contexts, strict=True):
                        own.append(s.symbol.astype(_U) << _U(32) | c.astype(_U))
                    held += len(s.symbol)
                    if held >= PAIRS:
                        count()
                        held = 0
                if levels is not None:
                    own = np.zeros((2, len(s.place) * (OWN + 1)), np.float32)
                    for block, to in _runs(s):
                        np.add.at(counts[HASHED], _meeting(s, coding, levels.value, own, block, to), np.int32(1))
                some |= part.num_rows > 0
        count()
        zstd = pa.Codec("zstd", 1)
        for k, own in counts.items() if some else ():
            for chunk in range(-(-len(own) // (2 << CHUNK_BITS))):
                yield pa.record_batch(_packed(k * 64 + chunk, own[chunk * (2 << CHUNK_BITS) : (chunk + 1) * (2 << CHUNK_BITS)], zstd))

    return run


def _odds(counts: np.ndarray) -> bytes:
    c = counts.reshape(-1, 2) + PRIOR
    return np.clip(np.rint(SCALE * np.log(c[:, 1] / c[:, 0])), -127, 127).astype(np.int8).tobytes()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each chunk's counts, and their log odds."""
    sums: dict[int, np.ndarray] = {}
    for part, counts in _unpacked(batches):
        if part in sums:
            sums[part] += counts
        else:
            sums[part] = counts.astype(np.int64)
    zstd = pa.Codec("zstd", 1)
    for part, counts in sums.items():
        yield pa.record_batch(_packed(part, counts, zstd) | {"odds": pa.array([_odds(counts) if part < HASHED * 64 else b""], pa.binary())})


def _slopes(weights: np.ndarray):
    """Each gate's gradient and curvature in the weights of the bits of all decisions, from counts of what was met; and how many decisions they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, curve, decided = np.zeros((INPUTS, GATES)), np.zeros((INPUTS, INPUTS, GATES)), 0
        for part, counts in _unpacked(batches):
            pair = counts.reshape(-1, 2)
            some = np.flatnonzero(pair.any(axis=1))
            n, ones, cell = pair[some].sum(axis=1), pair[some, 1], some + (part - HASHED * 64 << CHUNK_BITS)
            level = [(cell >> shift & 31) - (FINE + 1) for shift in (14, 9, 4)]
            x = np.stack([v * (127 / FINE / SCALE) for v in level] + [((cell & 15) - (COARSE + 1)) / float(OWN_SCALE)])
            gate = (cell >> 19) * 4 + (level[2] != 0) * 2 + (level[0] != 0)
            p = _squash(np.clip((weights.T[:, gate] * x).sum(axis=0), -SURE, SURE))
            miss, slope = ones - n * p, n * p * (1 - p)
            for i in range(INPUTS):
                gradient[i] += np.bincount(gate, x[i] * miss, GATES)
                for j in range(INPUTS):
                    curve[i, j] += np.bincount(gate, x[i] * x[j] * slope, GATES)
            decided += int(n.sum())
        sums = np.concatenate([gradient.T.ravel(), curve.transpose(2, 0, 1).ravel(), [decided]])
        yield pa.record_batch({"sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    return run


@dataclass
class Trained:
    model: Model
    counts: DataFrame
    tokens: int
    distinct: int
    decided: int


def train(texts: DataFrame, work: Workspace) -> Trained:
    """The model of all rows of texts (text), their counts of words by hash, and how many decisions the gates' weights are fitted to: all.

    What goes to the driver has a bound: a word's hash and count for WORDS words, a byte per slot, sums per gate.
    The gates' weights are fitted to how often each combination of the predictors' levels was met, with zeros and with
    ones, over all texts: each half of them, told by a hash of the text, meets tables that hold the other half's counts.
    """
    spark = texts.sparkSession
    found = work.save(texts.mapInArrow(lean(_count_words), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    first, last = (int(x) for x in signed(_BYTES[[0, -1]]))
    spelled = np.zeros(257, np.int64)
    for r in found.where(F.col("h").between(first, last)).collect():
        spelled[r.h - first] = r.n
    counts = found.where(~F.col("h").between(first, last))
    end = int(signed(np.array([_END]))[0])
    size = F.floor(F.log2("n") * 16)
    by_size = counts.groupBy(size.alias("size"), (F.col("h") == end).alias("end")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    tokens, distinct, ends = sum(r.n for r in by_size), sum(r.words for r in by_size), sum(r.n for r in by_size if r.end)
    least, held = 1 << 30, 0
    for r in sorted((r for r in by_size if not r.end and r["size"] >= 16), key=lambda r: -r["size"]):
        held += r.words
        if held > WORDS:
            break
        least = r["size"]
    known = counts.where((size >= least) & (F.col("h") != end)).toArrow()
    hashes, n = known.column("h").to_numpy().astype(np.int64).view(_U), known.column("n").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    coding = Coding.of(hashes, n, tokens - ends - int(n.sum()), ends, spelled)
    shared = spark.sparkContext.broadcast(coding.packed())

    tasks = max(8, tokens // (2 * TASK_WORDS))
    adding = min(64, max(16, tasks))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(adding, F.pmod(F.col("part"), F.lit(adding))).mapInArrow(lean(_add_up), _PACKED + ", odds binary")

    def half(k: int, counting: bool, levels=None) -> DataFrame:
        # equal texts are in one half
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(2)) == k).coalesce(tasks)
        return work.save(summed(own.mapInArrow(lean(_count_cells(shared, counting, levels)), _PACKED)), f"half{k}{'' if counting else '-met'}")

    def tables(rows: DataFrame) -> list:
        found, out = {r.part: r.odds for r in rows.where(F.col("part") < HASHED * 64).select("part", "odds").collect()}, []
        for k in range(HASHED):
            parts = [np.frombuffer(found[p], np.int8) for p in sorted(found) if p // 64 == k]
            out.append(np.concatenate(parts) if parts else np.zeros(1 << SLOT_BITS, np.int8))
        return out

    # the second half is counted and meets the first one's tables in one pass
    one = half(0, True)
    of_one = spark.sparkContext.broadcast([_levels(t) for t in tables(one)])
    two = half(1, True, of_one)
    of_one.destroy()
    of_two = spark.sparkContext.broadcast([_levels(t) for t in tables(two)])
    met = half(0, False, of_two).unionByName(two.where(F.col("part") >= HASHED * 64)).drop("odds")
    of_two.destroy()
    every = tables(summed(one.unionByName(two).where(F.col("part") < HASHED * 64).drop("odds")))
    shared.destroy()

    weights, decided = np.full((GATES, INPUTS), 0.3), 0
    for _ in range(NEWTON if ends else 0):
        sums = np.sum([r.sums for r in met.mapInArrow(lean(_slopes(weights)), "sums array<double>").collect()], axis=0)
        gradient, curve, decided = sums[: GATES * INPUTS].reshape(GATES, INPUTS), sums[GATES * INPUTS : -1].reshape(GATES, INPUTS, INPUTS), int(sums[-1])
        # a weak pull to where it began, for gates that are seldom chosen
        before, weights = weights, np.clip(weights + np.linalg.solve(curve + np.eye(INPUTS), (gradient - (weights - 0.3))[..., None])[..., 0], -1, 2)
        if np.abs(weights - before).max() < STILL:
            break
    return Trained(Model(coding, every, weights), counts, tokens, distinct, decided)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learned from the rows for which `training` is true, told apart by 64-bit hashes of words; every row is scored,
    whole. Words are runs without space and U+0009 to U+000D, A-Z in lower case; each text has one end, which
    counts as a token. A null text is empty: an end alone. Equal texts get equal scores, those of very long
    words too. base_score is that of single words, smoothed by a half; without training rows it is 0. score is
    log10 of the probability that the model gives the words and the end, and bits_per_byte its bits by the
    bytes of words and of one separator each. An empty table gives no rows; other columns are ignored.

    Counts of words in the tree go to all tasks. Those of other words are joined by hash; none of them is
    frequent in training.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "context-mixing")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("trains"))
    trained = train(rows.where("trains").select("text"), work)
    model = trained.model
    shared = spark.sparkContext.broadcast((model.coding.packed(), model.tables, model.weights))
    tokens, base = trained.tokens, trained.tokens + 0.5 * (trained.distinct + 1)
    end = trained.counts.where(F.col("h") == int(signed(np.array([_END]))[0])).select("n").collect()
    ends = end[0].n if end else 0
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coding, tables, weights = shared.value
        model = Model(Coding.unpacked(coding), tables, weights)
        counts = np.append(model.coding.counts, 0)
        logs = np.log10((counts + 0.5) / base)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for whole in batches:
            for batch in slices(whole, size=1 << 20):
                n = batch.num_rows
                s = symbols(batch.column(1), model.coding)
                total = bits(s, model)
                w, known = s.words, s.found < model.coding.escape
                sums = lambda v: np.add.reduceat(np.append(v, v.dtype.type(0)), w.first[:-1]) * (w.counts() > 0) if len(v) else np.zeros(n)  # noqa: B023, E731
                per = w.counts() + 1
                length = sums((w.end - w.start).astype(np.int64)) + per
                # the other words of each text, each with how often it stands there
                at = np.flatnonzero(~known)
                order = np.lexsort((w.hash[at], w.text_of()[at]))
                h, owner = w.hash[at][order], w.text_of()[at][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                offsets = pa.array(np.searchsorted(owner[first], np.arange(n + 1)), pa.int32())
                rare = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(signed(h[first])), pa.array(times.astype(np.int32))], ["h", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        batch.column(0),
                        batch.column(2),
                        pa.array(per.astype(np.int64)),
                        pa.array((sums(known.astype(np.int64)) + (ends > 0)).astype(np.int64)),
                        pa.array(sums(np.where(known, logs[s.found], 0.0)) + np.log10((ends + 0.5) / base)),
                        pa.array(total / np.log(10)),
                        pa.array(-total / np.log(2) / length),
                        rare,
                    ],
                    ["row", "doc_id", "trains", "n_tokens", "n_known", "base", "score", "bits_per_byte", "rare"],
                )
                row += n

    scored = rows.select("doc_id", "text", "trains").mapInArrow(lean(run), f"row bigint, doc_id {id_type}, trains boolean, n_tokens bigint, n_known bigint, base double, score double, bits_per_byte double, rare array<struct<h: bigint, times: int>>")
    scored = work.save(scored, "scored")
    shared.destroy()
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.h", "w.times")
    counted = rare.join(trained.counts, "h", "left").groupBy("row", F.coalesce("n", F.lit(0)).alias("n")).agg(F.sum("times").alias("times"))
    # added up in order of the counts, so that equal texts get equal sums
    own = counted.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "times"))).alias("rest")).select(
        F.col("row").alias("of"),
        F.aggregate("rest", F.lit(0.0), lambda x, r: x + r["times"] * F.log10((r["n"] + 0.5) / F.lit(base))).alias("more"),
        F.aggregate("rest", F.lit(0).cast("bigint"), lambda x, r: x + F.when(r["n"] > 0, r["times"]).otherwise(0)).alias("also"),
    )
    return scored.join(own, F.col("row") == F.col("of"), "left").select(
        "doc_id",
        (~F.col("trains")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
        "bits_per_byte",
    )
