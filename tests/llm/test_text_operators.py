"""n-gram join, substring removal, BPE, language ID, fingerprints and mixing against brute force and edge cases."""

import hashlib
import math
import random
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import blocks, bpe, fingerprint, langid, mixing, ngram_join, substring

from .helpers import components, corpus, words

DOCS = "doc_id bigint, text string"


def shingles(text, k):
    w = [x.translate(blocks._LOWER.tobytes()) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def join_truth(rows, k, num, den):
    s = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j])]
    c = components([d for d, _ in rows], links)
    return sorted(((d, len(x), y) for (d, _), x, y in zip(rows, s, c, strict=True)), key=str)


def test_words_are_those_of_the_rule():
    texts = [None, "", " a\tb\x0b\x0cc\r\nd ", "é\u00a0è x\u2003y", "x" * 1000 + " y", "\x00 \x1f\x85"]
    w = blocks.Words(pa.array(texts))
    got = [[w.data[w.start[k] : w.end[k]].tobytes() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [words(t) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert len(set(w.hash.tolist())) == len(set(flat))
    sliced = blocks.Words(pa.array(["zz", *texts]).slice(1))
    assert sliced.hash.tolist() == w.hash.tolist()


@pytest.mark.parametrize(("k", "num", "block", "seed"), [(4, 85, ngram_join.BLOCK, 0), (5, 80, 300, 1), (3, 60, 40, 2)])
def test_ngram_join(spark, k, num, block, seed):
    rows = corpus(seed) + [(7, "one two"), (None, "one two"), (None, "quite alone here")]
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({"n": F.lit(1), "entity": F.lit("x")})
    got = ngram_join.near_duplicates(df, k, num, 100, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == join_truth(rows, k, num, 100)


def test_ngram_join_of_a_large_near_copy_group(spark, monkeypatch):
    from pulsegrid.llm import shared

    monkeypatch.setattr(shared, "HOT", 8)
    monkeypatch.setattr(shared, "TURN", 500)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        c = list(base)
        c[rng.randrange(60)] = f"u{i}"
        rows.append((i, " ".join(c)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), 4, 85, 100)
    assert sorted(map(tuple, got.collect()), key=str) == join_truth(rows, 4, 85, 100)


def test_a_chain_of_rows_that_share_but_do_not_link(spark):
    part = lambda i: [f"w{i}x{j}" for j in range(20)]
    rows = [(i, " ".join(part(i) + part(i + 1))) for i in range(400)]
    rows += [(1000 + i, " ".join(part(i) + part(i + 1) + ["end"])) for i in (0, 200)]
    # all in one group by way of each other, which has more entries than a block may
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = ngram_join.near_duplicates(df, 5, 80, 100, block=2000)
    assert sorted(map(tuple, got.collect()), key=str) == join_truth(rows, 5, 80, 100)


def test_block_products_against_all_pairs():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(2, 40)
        block = np.sort([rng.randrange(4) for _ in range(n)])
        block = np.unique(block, return_inverse=True)[1]
        own = np.array([rng.randrange(2) for _ in range(n)])
        apart = np.array([b == 0 for b in block])
        sets = [set(rng.sample(range(12), rng.randrange(1, 10))) for _ in range(n)]
        label = np.array([rng.randrange(100 * int(b), 100 * int(b) + 30) for b in block])
        tokens = np.array([t for s in sets for t in sorted(s)], np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        sizes = np.array([len(s) for s in sets])
        got = ngram_join.linked_classes(block, own, apart, label, sizes, tokens, offsets, 60, 100)
        pairs = [(i, j) for i in range(n) for j in range(i) if block[i] == block[j] and not (apart[i] and own[i] == own[j]) and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])]
        names = sorted(set(label.tolist()))
        at = {x: k for k, x in enumerate(names)}
        joined = lambda links: components(names, [(at[a], at[b]) for a, b in links])
        assert joined(got) == joined([(label[i], label[j]) for i, j in pairs])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string, lang string")
    assert ngram_join.near_duplicates(none).count() == 0
    assert ngram_join.keep_one(none).count() == 0
    assert substring.remove(none).count() == 0
    assert fingerprint.fingerprints(none).count() == 0
    assert mixing.copies(none).count() == 0 and mixing.mix(none).count() == 0
    assert langid.learn(none) == {} and langid.identify(none, {}).count() == 0
    assert bpe.encode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d e f g h", "x"), (1, "a b c d e f g h", "y"), (1, "a b c d e f g h", "z"), (2, "quite another text", "x"), (4, None, "x"), (5, "", "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, DOCS + ", source string")
    got = sorted(map(tuple, ngram_join.keep_one(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f g h", "y"), (2, "quite another text", "x"), (4, None, "x"), (5, "", "x"), (4, None, "x")], key=str)


def removal_truth(rows, w):
    first = {}
    for d, t in rows:
        x = words(t)
        for i in range(len(x) - w + 1):
            key = tuple(x[i : i + w])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        x = words(t)
        gone = set()
        for i in range(len(x) - w + 1):
            if d is not None and first[tuple(x[i : i + w])] < d:
                gone |= set(range(i, i + w))
        kept = b" ".join(v for i, v in enumerate(x) if i not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("w", "split", "seed"), [(13, 256, 0), (13, 1, 1), (4, 2, 2), (6, 256, 3)])
def test_substring_removal(spark, monkeypatch, w, split, seed):
    monkeypatch.setattr(substring, "SPLIT", split)
    rows = corpus(seed)
    rows += [(rows[20][0], rows[21][1]), rows[30], (None, rows[22][1]), (None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("spans", F.lit(1))
    got = substring.remove(df, w, keep_text=False, shard_words=200).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == removal_truth(rows, w)


def test_substring_text_and_clashing_columns(spark):
    p = " ".join(f"p{i}" for i in range(15))
    df = spark.createDataFrame([(1, f"x\n{p}", 5), (2, f"start {p}  end", 6), (3, "as\tit  was", 7), (4, None, 8)], DOCS + ", n_words bigint")
    got = substring.remove(df, 13, prefix="__s_").orderBy("doc_id").collect()
    assert [(r.text, r.n_words, r["__s_n_removed"]) for r in got] == [(f"x\n{p}", 5, 0), ("start end", 6, 15), ("as\tit  was", 7, 0), (None, 8, 0)]


def test_suffix_automaton_finds_the_first_document():
    rng = random.Random(5)
    seqs = sorted((rng.randrange(50), [rng.randrange(4) for _ in range(rng.randrange(1, 30))]) for _ in range(60))
    a, w, seen = substring.SuffixAutomaton(), 4, {}
    for doc, s in seqs:
        want = [seen.get(tuple(s[i : i + w]), doc) for i in range(len(s) - w + 1)]
        assert a.firsts(s, w, doc) == want
        a.add(s, doc)
        for i in range(len(s) - w + 1):
            seen.setdefault(tuple(s[i : i + w]), doc)


def test_bpe_is_that_of_the_ranks(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    pieces = bpe.read_ranks(path)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={p: k for k, p in enumerate(pieces)}, special_tokens={})
    texts = [None, "", "  a\n\n b ", "It's ▁x ▁ \x00 é漢字😀", "<|endoftext|> <unk>", "ab" * 20_000, "ΑΒΓ 123 ½", *[x for _, x in corpus(1, 20)]]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit("clash"))
    got = bpe.encode(df, path, P.PATTERN).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        ids = t.encode_ordinary(text or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == (text or "")
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert len(set(bpe.byte_characters())) == 256


def test_bpe_cache_starts_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    pieces = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    c = bpe.ByteBpe(pieces, P.PATTERN)
    for text in ("one two three four", "five six one", "one two three four"):
        assert c.decode(c.encode(text)) == text.encode()


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    assert langid.learn(docs.repartition(7).where(~langid.held_out())) == model
    got = langid.identify(docs, model, keep=("lang",)).withColumn("held", langid.held_out())
    right = got.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert got.where("score < 0 OR score > 1").isEmpty()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "the and of " * 9000), (4, "the and of " * 9000)], DOCS).withColumn("score", F.lit("x"))
    r = sorted(map(tuple, langid.identify(odd, model).select("doc_id", "lang_pred", "rejected").collect()))
    assert r == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False)]
    assert langid.identify(odd, {}).where("lang_pred <> 'und'").isEmpty()
    assert langid.identify(odd, {"xx": b"some text"}).where("doc_id = 4").first().lang_pred == "xx"


def test_language_id_against_plain_compression(spark):
    import regex
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = docs.where(~langid.held_out()).where("lang IS NOT NULL AND length(text) > 0")
    # the sample: of each hash cell the row of least hash, whole texts in that order
    rows = known.select("lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text").collect()
    least = {}
    for r in rows:
        key = (r.lang, r.h % langid.CELLS)
        least[key] = min(least.get(key, r), r, key=lambda x: x.h)
    count = {}
    for r in rows:
        count[r.lang] = count.get(r.lang, 0) + 1
    content = {x: b"".join(r.text.lower().encode() for r in sorted((v for (l, _), v in least.items() if l == x), key=lambda v: v.h))[: langid.DICTIONARY] for x in sorted(count, key=lambda x: (-count[x], x))}
    model = langid.learn(docs.where(~langid.held_out()))
    assert model == content and list(model) == list(content)

    def size(data, dictionary):
        p = zstandard.ZstdCompressionParameters.from_level(6, strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, source_size=8192, dict_size=len(dictionary), write_content_size=0, write_checksum=0, write_dict_id=0)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
        return sum(len(c.compress(data[i : i + 8192])) for i in range(0, len(data), 8192))

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    texts |= {-1: "½ ②", -2: "Ⅳ", -3: "naïve  ½", -4: "日本 語"}
    odd = spark.createDataFrame(list(texts.items()), DOCS).repartition(3)
    for r in langid.identify(odd, model).collect():
        text = texts[r.doc_id]
        if not text or not regex.search(r"\p{L}", text):
            assert (r.lang_pred, r.score, r.margin, r.rejected) == ("und", 0.0, 0.0, True)
            continue
        sizes = {x: size(text.lower().encode(), d) for x, d in content.items()}
        (first, a), (_, b) = sorted(sizes.items(), key=lambda x: (x[1], list(content).index(x[0])))[:2]
        assert (r.lang_pred, r.margin, r.rejected) == (first, (b - a) / a, (b - a) / a < langid.MIN_MARGIN)
        assert r.score == pytest.approx(1 - 0.5 / (1 + 10 * (b - a) / a))


def test_language_id_learns_every_language(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"l{i:02}" for i in range(70)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(40)] for x in names}
    text = lambda x: " ".join(rng.choice(words[x]) for _ in range(200))
    # the first ones are rarer
    rows = [(f"{x}-{i}", x, text(x)) for k, x in enumerate(names) for i in range(1 if k < 10 else 3)]
    rows += [(f"e{i}", "l00", "") for i in range(20)] + [("none", "only empty", "")]
    df = spark.createDataFrame(rows, "doc_id string, lang string, text string")
    model = langid.learn(df)
    assert sorted(model) == names and list(model)[-10:] == names[:10]
    assert langid.learn(df.repartition(5)) == model
    fresh = spark.createDataFrame([(x, text(x)) for x in names], "doc_id string, text string")
    assert langid.identify(fresh, model).where("doc_id <> lang_pred OR rejected").isEmpty()
    # together they have what FULL_LANGS languages of full size would have
    monkeypatch.setattr(langid, "DICTIONARY", 1000)
    assert {len(x) for x in langid.learn(df).values()} == {1000 * 64 // 70}
    assert {len(x) for x in langid.learn(df.where("lang < 'l40'")).values()} == {1000}
    monkeypatch.setattr(langid, "MAX_LANGS", 69)
    with pytest.raises(ValueError, match="languages"):
        langid.learn(df)


def test_fingerprints(spark):
    rows = [(d, t) for d, t in corpus(4, 30)]
    rows += [(5, "tie b"), (5, "tie a"), (None, "first of all")]
    df = spark.createDataFrame(rows, DOCS).repartition(6).withColumn("range", F.lit("clash"))
    got = sorted(map(tuple, fingerprint.fingerprints(df).collect()), key=str)
    tie = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = sorted(((-math.inf if d is None else d), tie(t or ""), t or "", d) for d, t in rows)
    want = []
    for k, (*_, t, d) in enumerate(order):
        e = fingerprint.edit(t, order[(k + 1) % len(order)][2])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(want, key=str) == sorted((g[:3] for g in got), key=str)
    by_text = {}
    texts = dict(rows)
    for g in got:
        if g[0] is not None and g[0] != 5:
            assert by_text.setdefault(texts[g[0]], g[3]) == g[3]
        assert 0 <= g[5] <= 1 and 0 <= g[6] <= 1
    assert len({g[3] for g in got}) > 40
    alone = fingerprint.fingerprints(spark.createDataFrame([(1, "only one")], DOCS)).first()
    assert alone.near_next == 1.0


def plain_signature(text, k=fingerprint.K):
    """Consistent weighted samples of one text, term by term, with nothing of the operator's but its rule."""
    m64 = (1 << 64) - 1
    f32 = np.float32

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    def word_hash(w):
        if len(w) > 256:
            return xxhash.xxh3_64_intdigest(w)
        h = mixed(int.from_bytes(w[:8], "little") ^ (len(w) * 0x9E3779B97F4A7C15 & m64))
        for i in range(8, len(w), 8):
            h = mixed((h * 0x9E3779B97F4A7C15 & m64) ^ int.from_bytes(w[i : i + 8], "little"))
        return h

    counts = {}
    for w in words(text):
        h = word_hash(w)
        counts[h] = counts.get(h, 0) + 1
    gamma = fingerprint._gamma2()
    out = []
    for j in range(1, k + 1):
        salt = mixed(j * 0x9E3779B97F4A7C15 & m64)
        least = None
        for h, n in counts.items():
            m = mixed(h ^ salt)
            r, beta = f32(gamma[m & 0xFFFF]), f32((m >> 32) & 0xFFFF) * f32(1 / 65536)
            t = np.floor(f32(math.log(n)) / r + beta) if n > 1 else f32(0)
            a = f32(math.log(gamma[(m >> 16) & 0xFFFF])) - r * f32((f32(1) - beta) + t)
            least = a if least is None else min(least, a)
        out.append(0 if least is None else mixed(int(np.array(least, f32).view(np.uint32))) % 65535 + 1)
    return np.array(out, np.uint16)


def test_fingerprints_against_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(x for x in corpus(6, 12) if len(x[1] or "") < 3000)] + [(900, "one " * 40 + "two"), (901, "w " * 3 + "é " * 2)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    order = [t or "" for _, t in sorted(rows)]
    got = fingerprint.fingerprints(df).orderBy("doc_id").collect()
    for k, r in enumerate(got):
        following = order[(k + 1) % len(order)]
        own, other, after = (plain_signature(t) for t in (order[k], fingerprint.edit(order[k], following), following))
        assert r.fingerprint == own.astype(">u2").tobytes().hex() and r.edited_fingerprint == other.astype(">u2").tobytes().hex()
        assert r.near_edited == (own == other).mean() and r.near_next == (own == after).mean()


def test_fingerprints_of_long_texts_come_in_pieces(monkeypatch):
    texts = ["", *[t or "" for _, t in corpus(7, 20)], "z" * 5000, " ".join(f"w{i % 700}" for i in range(9000))]
    want = fingerprint.Sampler().signatures(texts)
    monkeypatch.setattr(fingerprint, "CHUNK", 1000)
    monkeypatch.setattr(fingerprint, "SLICE", 16)
    assert (fingerprint.Sampler().signatures(texts) == want).all()


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(0)
    s = fingerprint.Sampler(512)
    for _ in range(6):
        pool = [f"t{i}" for i in range(80)]
        a, b = ([x for x in rng.sample(pool, 40) for _ in range(rng.choice((1, 1, 2, 5)))] for _ in range(2))
        terms = set(a) | set(b)
        truth = sum(min(a.count(t), b.count(t)) for t in terms) / sum(max(a.count(t), b.count(t)) for t in terms)
        x, y = s.signatures([" ".join(a), " ".join(b)])
        assert (x == y).mean() == pytest.approx(truth, abs=4 * math.sqrt(truth * (1 - truth) / 512) + 0.01)
    e = s.signatures(["", " ", "x"])
    assert (e[0] == e[1]).all() and not (e[0] == e[2]).any()


def mix_targets(sizes, weights, budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), budget * sum(sizes.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
            free.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.choice((0, 1)) for _ in range(rng.randrange(60))) if i % 17 else None, rng.choice(("a", "b", "Z", "é", None)) if i % 3 else "hot") for i in range(3000)]
    rows += [rows[5], rows[5], (None, "x y z", "a"), (9001, "", "empty"), (9002, None, "empty")]
    df = spark.createDataFrame(rows, DOCS + ", source string").withColumn("target", F.lit("clash"))
    got = mixing.copies(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = mix_targets(sizes, mixing.WEIGHTS)
    taken = {}
    for r in got:
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(rate) <= r.copies <= math.ceil(rate)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 60)
    again = mixing.copies(df.repartition(9))
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got) and mixed.where("target <> 'clash'").isEmpty()


def test_mixing_one_source(spark):
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(10)], DOCS + ", source string")
    assert mixing.copies(df).agg(F.sum("taken")).first()[0] in (45, 42, 48)


def test_u64_signed_round_trip():
    x = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert blocks.signed(x).view(np.uint64).tolist() == x.tolist()
