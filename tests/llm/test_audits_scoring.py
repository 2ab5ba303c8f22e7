"""The source and filter audits and language-model scores against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import context_mixing, filter_audit, source_audit
from pulsegrid.llm.blocks import Words, mix
from pulsegrid.llm.workspace import Workspace

from .helpers import corpus

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def source_truth(rows):
    """Rows (text, lang, source): the audit by loops over all terms and pairs."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), {(lang, s) for _, lang, s in rows}
    for t, lang, s in rows:
        found = [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
        docs[lang].update(set(found))
        counts[lang, s].update(found)
        counts[lang].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 30]

        def shares(of, kept=kept):
            n = sum(counts[of][t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[of][t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, own = shares(lang), {s: shares((lang, s)) for k, s in groups if k == lang}
        for s, p in own.items():
            pairs = [(-sum(abs(p[t] - other[t]) for t in kept), o) for o, other in own.items() if o != s]
            terms = [(q[t] - p[t], t) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def audited_rows():
    rng = random.Random(3)
    letters = ["Ab", "ab", "é", "straße", "日本", "x1y", "don't", "ÀÉ"]
    rows = []
    for lang, sources in (("en", ["a", "b", None, "", "c"]), (None, ["a", "z"]), ("", ["z"]), ("xx", ["q", "r"])):
        for k in range(140 if lang != "xx" else 12):
            own = letters + [f"w{rng.choice('abcdefghij')}{rng.choice('klmnop')}" for _ in range(5)]
            rows.append((" ".join(rng.choice(own) for _ in range(rng.choice((0, 1, 8, 30)))), lang, sources[0] if k % 3 == 0 else rng.choice(sources)))
    return [*rows, (None, "en", "silent"), ("123 !?", "none", "b"), ("alone " * 500, "en", "c"), *[("ab é", "en", "a")] * 40]


@pytest.mark.parametrize("gathered", [source_audit.GATHERED, 20])
def test_source_audit_against_brute_force(spark, monkeypatch, gathered):
    monkeypatch.setattr(source_audit, "GATHERED", gathered)
    rows = audited_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("shard", F.lit(1)).repartition(3)
    got = source_audit.audit(df)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    found = sorted(map(tuple, got.collect()))
    assert found == source_truth(rows)
    assert {r[2] for r in found} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in found)


def test_source_audit_of_many_terms_and_of_none(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = [(" ".join(make() for _ in range(60)), "en", f"s{k % 4}") for k in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    found = sorted(map(tuple, source_audit.audit(df).collect()))
    assert found == source_truth(rows) and max(r[5] for r in found if r[2] == "term") == 50
    assert source_audit.audit(df.limit(0)).collect() == []


def filter_truth(rows, labels):
    """Rows (doc_id, text, source) and (doc_id, quality, toxic): each order's filters applied one after the other."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > firsts[t]), strict=True) if x}
        docs.append((s or "", fails, i is not None and i in good, i is not None and i in toxic))
    out, shapley = [], Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                failing = [d for d in own if f in d[1]]
                out.append([part, order, step, len(kept), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)])
                left = kept
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\n", "One two #", "A B C D", "x " * 60, "é日本 " * 49, " ".join(map(str, range(50))), " ".join(map(str, range(49))), "w v " * 70, "same " * 51, "Z" * 300, "  lead " + " ".join(f"t{k}" for k in range(80)), "long " + " ".join(f"u{k}" for k in range(9000))]
    rows = [(k if rng.random() < 0.9 else None, rng.choice(texts), rng.choice(["s1", "s1", "s2", None, ""])) for k in range(150)]
    rows += [(200, "twice " * 3, "s1")] * 3 + [(200, "twice  " * 3, "s1"), (200, "twice " * 3, "s2"), (7, "other", "s1"), (-4, "Z" * 300, "s9"), (None, "only null", "s9"), (None, "only null", "s9")]
    labels = [(k, rng.choice((0, 1, None)), rng.choice((0, 1))) for k in range(0, 150, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("words", F.lit("clash")).withColumn("n", F.lit(5)).repartition(4)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit("clash"))
    got = filter_audit.audit(docs, known)
    assert [k for _, k in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert sorted(map(tuple, got.collect())) == filter_truth(rows, labels)
    assert filter_audit.audit(docs.limit(0), known).collect() == []
    none = sorted(map(tuple, filter_audit.audit(docs, known.limit(0)).collect()))
    assert none == filter_truth(rows, [])


def test_words_of_a_text_are_counted_where_it_is(spark):
    """One shuffle deals texts; none deals words."""
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id bigint, text string")
    plan = filter_audit.word_counts(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_paths_are_a_complete_prefix_code():
    rng = np.random.default_rng(0)
    for weights in (rng.integers(1, 10_000, 300), np.ones(7, np.int64), 2 ** np.arange(20), np.array([5, 1])):
        start, nodes, bits = context_mixing.tree(weights)
        paths = [tuple(zip(nodes[a:b], bits[a:b], strict=True)) for a, b in zip(start[:-1], start[1:], strict=True)]
        assert sum(2.0 ** -len(p) for p in paths) == 1 and len(set(paths)) == len(weights)
        assert all(p[0][0] == 0 for p in paths) and set(nodes) == set(range(len(weights) - 1))
        size, total = np.diff(start), weights.sum()
        assert (weights * size).sum() <= (-weights * np.log2(weights / total)).sum() + total


def decisions(model, text):
    """Each decision of one text in order: its symbol's place, cells of the tables, bit, level, own counter."""
    c = model.coding
    known = {int(h): k for k, h in enumerate(c.hashes)}
    tokens = words(text)
    hashes = [int(Words(pa.array([w])).hash[0]) for w in tokens]
    short = lambda *parts: int(mix(np.array([sum(parts) % 2**64], np.uint64))[0]) >> 32
    odd = int(context_mixing._STEP)
    symbols = []
    h1 = h2 = t1 = t2 = 0
    for k in range(len(tokens) + 1):
        h = [short(h1 + 1), short((t1 | t2 << 16) + (2 << 40)), short(h1 * odd + h2 + 3)]
        if k == len(tokens):
            symbols.append((c.escape + 1, h))
            break
        symbol = known.get(hashes[k], c.escape)
        symbols.append((symbol, h))
        raw = tokens[k].encode()
        if symbol == c.escape:
            for j in range(len(raw) + 1):
                back = [raw[j - m] if j >= m else 256 for m in (1, 2, 3, 4)]
                seen = [sum(b << 9 * i for i, b in enumerate(back[:n])) for n in (2, 3, 4)]
                symbols.append((c.escape + 2 + (raw[j] if j < len(raw) else 256), [short(x + (4 + i << 40)) for i, x in enumerate(seen)]))
        h1, h2, t1, t2 = hashes[k], h1, raw[-1] | (raw[-2] << 8 if len(raw) > 1 else 0), t1
    out = []
    for at, (symbol, h) in enumerate(symbols):
        for i in range(c.start[symbol], c.start[symbol + 1]):
            node = int(c.nodes[i])
            slots = [((x ^ node * 0x9E3779B1 % 2**32) * 0x85EBCA6B % 2**32) >> (32 - context_mixing.SLOT_BITS) for x in h]
            out.append((at, slots, int(c.bits[i]), int(c.level[i]), int(c.own[i])))
    return out


def plain_log(model, text):
    """The logarithm of a text's probability, one decision after the other."""
    cm = context_mixing
    found = decisions(model, text)
    edges = set(cm._edges(found[-1][0] + 1).tolist())
    drift, own = np.zeros(cm.INPUTS), defaultdict(lambda: [0, 0])
    start = [1 / (1 + math.exp(-(k / 2 - cm.CELLS // 4))) for k in range(cm.CELLS)]
    seen = [[(1 - s) * cm.STEADY, s * cm.STEADY] for s in start]
    held, total, at = [], 0.0, -1
    for k, (symbol, cells, bit, level, counter) in [*enumerate(found), (0, (-1, None, 0, 0, 0))]:
        if symbol != at and (symbol == -1 or symbol in edges) and held:
            rate = cm.RATE / (1 + len(held) / cm.ENOUGH)
            drift = drift + rate * sum(x * (y - p) for x, y, p, _, _ in held)
            for _, y, _, cell, n in held:
                seen[cell][y] += 1
                if n < cm.OWN:
                    own[n][y] += 1
            held = []
        at = symbol
        if symbol == -1:
            return total
        x = [int(t[c]) / cm.SCALE for t, c in zip(model.tables, cells, strict=True)]
        x.append(math.log((own[counter][1] + cm.PRIOR) / (own[counter][0] + cm.PRIOR)) if counter < cm.OWN else 0.0)
        x = np.array(x)
        gate = level + 2 * (x[2] != 0) + (x[0] != 0)
        odds = min(11.5, max(-11.5, float((model.weights[gate] + drift) @ x)))
        p = 1 / (1 + math.exp(-odds))
        cell = min(cm.CELLS - 1, max(0, int(odds * 2 + cm.CELLS // 2 + 0.5)))
        final = (p + seen[cell][1] / sum(seen[cell])) / 2
        total += math.log(final if bit else 1 - final)
        held.append((x, bit, p, cell, counter))


@pytest.fixture(scope="module")
def trained(spark):
    texts = [(t or "",) for _, t in corpus(4)]
    df = spark.createDataFrame(texts, "text string").repartition(5)
    return texts, context_mixing.train(df, Workspace(spark, "test"))


def test_tables_hold_the_counts_of_all_texts(trained):
    texts, t = trained
    counts = [Counter() for _ in t.model.tables]
    for (text,) in texts:
        for _, cells, bit, _, _ in decisions(t.model, text):
            for k, c in enumerate(cells):
                counts[k][c, bit] += 1
    for table, own in zip(t.model.tables, counts, strict=True):
        want = np.zeros(len(table))
        for c in {c for c, _ in own}:
            want[c] = 16 * math.log((own[c, 1] + 0.4) / (own[c, 0] + 0.4))
        assert np.abs(np.clip(want, -127, 127) - table).max() <= 0.5 + 1e-6


def test_scores_against_one_decision_after_the_other(trained):
    texts, t = trained
    some = [x[0] for x in texts if len(x[0]) < 4000][:25] + ["never seen Wörter 日本 zzzz", "", "one two", " ".join(f"w{k % 37} new{k}" for k in range(300))]
    s = context_mixing.symbols(pa.array(some), t.model.coding)
    got = context_mixing.bits(s, t.model)
    want = [plain_log(t.model, x) for x in some]
    assert np.allclose(got, want, rtol=2e-3, atol=1e-2)
    # what else is in the slice doesn't matter
    alone = [context_mixing.bits(context_mixing.symbols(pa.array([x]), t.model.coding), t.model)[0] for x in some]
    assert np.allclose(got, alone, rtol=1e-6)


def test_equal_symbols_in_equal_contexts_are_walked_once(trained, monkeypatch):
    """Copies add no path to those walked to count cells, and counts don't depend on how many words and pairs are gathered first."""
    texts, t = trained
    cm, coding = context_mixing, t.model.coding
    shared, walked, walk = SimpleNamespace(value=coding.packed()), [], cm.steps
    monkeypatch.setattr(cm, "steps", lambda symbol, coding: (walked.append(len(symbol)), walk(symbol, coding))[1])
    once = [x for (x,) in texts[:40]]
    batches = lambda some: iter([pa.record_batch([pa.array(some[k : k + 7], pa.string())], ["text"]) for k in range(0, len(some), 7)])

    def cells(some):
        walked.clear()
        return {part: c.astype(np.int64) for part, c in cm._unpacked(cm._count_cells(shared, True)(batches(some)))}, sum(walked)

    def counted(some):
        found = Counter()
        for b in cm._count_words(batches(some)):
            for h, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found[h] += n
        return found

    one, paths = cells(once)
    symbols = sum(len(cm.symbols(pa.array([x]), coding).symbol) for x in once)
    assert 0 < paths < cm.HASHED * symbols
    assert sum(int(c.sum()) for c in one.values()) == cm.HASHED * sum(len(decisions(t.model, x)) for x in once)
    ten, again = cells(once * 10)
    assert again == paths and all((ten[k] == 10 * c).all() for k, c in one.items())
    words_of_ten = counted(once * 10)
    monkeypatch.setattr(cm, "PAIRS", 300)
    monkeypatch.setattr(cm, "GATHERED", 100)
    few, more = cells(once * 10)
    assert more > paths and all((few[k] == c).all() for k, c in ten.items())
    assert counted(once * 10) == words_of_ten
    want = Counter(w for x in once * 10 for w in words(x))
    got = {w: words_of_ten[int(Words(pa.array([w])).hash.view(np.int64)[0])] for w in want}
    assert got == want and words_of_ten[int(np.array([cm._END]).view(np.int64)[0])] == 400


def test_lm_scores_against_brute_force(spark):
    rows = [(i, t) for i, t in corpus(2)] + [(None, "a null id"), (None, None), (5000, "W1 w1 W1"), (5000, "W1 w1 W1"), (5001, "only\there " + "y" * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit("clash")).withColumn("h", F.lit(1)).repartition(4)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = context_mixing.score(df, ~F.coalesce(held, F.lit(False))).collect()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(x for i, t in rows if not is_held(i) for x in [*words(t), None])
    n = sum(c.values())
    log = lambda x: math.log10((c[x] + 0.5) / (n + 0.5 * (len(c) + 1)))
    want = []
    for i, t in rows:
        w = [*words(t), None]
        want.append((i, is_held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(map(log, w)), 6)))
    order = lambda r: (r[0] is not None, *r[:1], *r[2:]) if r[0] is not None else (False, *r[2:])
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=order) == sorted(want, key=order)
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in got)
    twice = [(r.base_score, r.score) for r in got if r.doc_id == 5000]
    assert len(twice) == 2 and twice[0] == twice[1]
    # known passages cost less than words of the same length that were never seen
    long = [r for r in got if r.n_tokens > 20]
    assert np.mean([r.score / r.n_tokens for r in long if not r.held_out]) > np.mean([r.base_score / r.n_tokens for r in long if not r.held_out])


def test_lm_scores_without_training_rows(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in context_mixing.score(df, F.lit(False)).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score < got[2].score < 0
    assert context_mixing.score(df.limit(0), F.lit(True)).collect() == []


def met(coding, tables, text):
    """For each decision of one text: gate, inputs as levels, bit. What a block adds to the text's own counts holds from the next one on."""
    cm = context_mixing
    found = decisions(SimpleNamespace(coding=coding), text)
    edges, own, held, at = set(cm._edges(found[-1][0] + 1).tolist()), defaultdict(lambda: [0, 0]), [], -1
    for symbol, cells, bit, level, counter in found:
        if symbol != at and symbol in edges:
            for n, y in held:
                own[n][y] += 1
            held = []
        at = symbol
        odds = [int(t[c]) for t, c in zip(tables, cells, strict=True)]
        x = [(1 if v > 0 else -1) * max(1, round(abs(v) * cm.FINE / 127)) * 127 / cm.FINE / cm.SCALE if v else 0.0 for v in odds]
        mine = math.log((own[counter][1] + cm.PRIOR) / (own[counter][0] + cm.PRIOR)) if counter < cm.OWN else 0.0
        x.append(min(cm.COARSE, max(-cm.COARSE, round(mine * 1.25))) / 1.25)
        held.append((counter, bit))
        yield level + 2 * (odds[2] != 0) + (odds[0] != 0), x, bit


def test_lm_weights_and_spelling_come_from_all_texts(spark):
    """More distinct texts than any sample of a thousand: the paths of bytes follow the bytes of all, the gates' weights the decisions of all, each half of the texts against the other's counts."""
    cm = context_mixing
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'abcdefgh'[k % 8]}{k}" for k in rng.zipf(1.4, size=2 + i % 4) % 300) + f" only{i}" for i in range(1500)]
    texts += [" ".join(f"w{k}" for k in rng.zipf(1.3, size=120) % 50) for _ in range(10)] + [texts[0]] * 3 + [""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))).collect()
    t = cm.train(spark.createDataFrame([(x,) for x in texts], "text string").repartition(5), Workspace(spark, "test"))
    c = t.model.coding

    spelled = np.zeros(257, np.int64)
    for x in texts:
        for w in words(x):
            for b in w.encode():
                spelled[b] += 1
            spelled[256] += 1
    start, nodes, bits = cm.tree(spelled + 1)
    words_end = int(c.start[c.escape + 2])
    assert np.array_equal(np.diff(c.start[c.escape + 2 :]), np.diff(start))
    assert np.array_equal(c.nodes[words_end:], nodes) and np.array_equal(c.bits[words_end:], bits)

    tables = []
    for half in range(2):
        counts = [np.zeros((1 << cm.SLOT_BITS, 2)) for _ in range(cm.HASHED)]
        for r in rows:
            if r.half == half:
                for _, cells, bit, _, _ in decisions(t.model, r.text):
                    for k, cell in enumerate(cells):
                        counts[k][cell, bit] += 1
        tables.append([np.frombuffer(cm._odds(x.ravel()), np.int8) for x in counts])
    gates, x, y = (np.array(v) for v in zip(*[d for r in rows for d in met(c, tables[1 - r.half], r.text)], strict=True))
    assert t.decided == len(y)
    want = np.full((cm.GATES, cm.INPUTS), 0.3)
    for _ in range(cm.NEWTON):
        p = 1 / (1 + np.exp(-np.clip((want[gates] * x).sum(axis=1), -11.5, 11.5)))
        for g in np.unique(gates):
            own = gates == g
            curve = (x[own].T * (p * (1 - p))[own]) @ x[own] + np.eye(cm.INPUTS)
            want[g] = np.clip(want[g] + np.linalg.solve(curve, x[own].T @ (y - p)[own] - (want[g] - 0.3)), -1, 2)
    assert len(np.unique(gates)) > 8 and np.allclose(t.model.weights, want, atol=1e-3)
