"""WARC, chat, URL filter, vectors, components, the registered queries and the pipeline."""

import hashlib
import importlib.util
import math
import random
import unicodedata
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from pulsegrid.llm import chat, embed_dedup, langid, queries, url_filter, warc
from pulsegrid.llm.components import components as connect
from pulsegrid.llm.ranges import range_bounds, range_of
from pulsegrid.llm.workspace import Workspace

from .helpers import components

DIR = "/root/testdata/sf0.001"


def warc_truth(rows):
    top = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            top[b] = max(top.get(b, p), p)
    out, seen = [], set()
    for p, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (h or "").encode()
        to = top.get(b) if len(b) >= 1000 else None
        again = to is not None and (p != to or (p, b) in seen)
        seen.add((p, b))
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def pages():
    big, other = "é" * 700, "<p>\r\n\r\n" * 300
    rows = [(i, f"http://h{i}.org/a", big if i % 3 == 0 else other if i % 3 == 1 else f"small {i % 2}") for i in range(40)]
    return [*rows, (50, None, None), (51, "http://x/\r\nEvil: 1", ""), (39, "http://again.org/", big), (39, "http://again.org/", big), (None, "http://none.org/", big), (60, "u", "z" * 999), (61, "u", "z" * 999), (62, "u", "y" * 1000)]


def test_warc_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("shard", F.lit("clash"))
    sums = []
    for parts in (1, 5):
        out = f"file://{tmp_path}/w{parts}"
        manifest = warc.write(df.repartition(parts), out, shards=3, file_bytes=4000)
        assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 3
        sums.append(sorted((r.file, r.sha1, r.bytes) for r in manifest.collect()))
        got = warc.read(spark, out, payloads=True)
        keys = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, keys), key=str) == warc_truth(rows)
        for r in got.where("record_type = 'response'").collect():
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
        assert got.where("url LIKE '%Evil%'").first().url == "http://x/%0D%0AEvil: 1"
    assert sums[0] == sums[1]  # deterministic, whatever the input's partitions
    assert not list(Path(f"{tmp_path}/w5").glob("_temporary*"))
    empty = f"file://{tmp_path}/none"
    assert warc.write(df.where("false"), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_warc_ranges_and_second_attempts(spark, tmp_path):
    # one id and null ids with most rows: payloads deal them to several shards
    rows = [(7 if i % 2 else None, f"u{i}", f"{i} " * 300) for i in range(300)] + [(i, "u", "x") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = f"file://{tmp_path}/w"
    manifest = warc.write(df, out, shards=6)
    per = {r.shard: r.n for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()}
    assert len(per) == 6 and max(per.values()) < 90
    assert sorted(map(tuple, warc.read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == warc_truth(rows)
    # again into the same folder, as a second attempt would, with leftovers of one that failed
    before = {p.name: p.read_bytes() for p in Path(f"{tmp_path}/w").glob("*.gz")}
    (tmp_path / "w" / "_temporary-old").write_bytes(b"half a file")
    warc.write(df.repartition(3), out, shards=6)
    assert {p.name: p.read_bytes() for p in Path(f"{tmp_path}/w").glob("*.gz")} == before
    assert not list((tmp_path / "w").glob("_temporary*"))


def test_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.xxhash64("id").alias("t"), F.when(F.col("id") % 7 == 3, 20).otherwise(1).alias("w"))
    bounds = range_bounds(df, F.col("k"), F.col("t"), F.col("w"), 10)
    dealt = df.withColumn("r", range_of(F.col("k"), F.col("t"), bounds)).cache()
    at = lambda k, t: sum((k, t) >= b for b in bounds)
    assert all(r.r == at(r.k, r.t) for r in dealt.collect())
    sums = [r.w for r in dealt.groupBy("r").agg(F.sum("w").alias("w")).collect()]
    assert len(sums) == 10 and max(sums) < 1.3 * min(sums)
    assert range_bounds(df.where("false"), F.col("k"), F.col("t"), F.col("w"), 10) == []
    many = [(k, 0) for k in range(20_000)]
    got = spark.range(200).select("id", range_of(F.col("id") * 100 + 5, F.lit(-1).cast("bigint"), many).alias("r")).collect()
    assert all(r.r == min(r.id * 100 + 5, 20_000) for r in got)


def test_warc_notices_damage(spark, tmp_path):
    out = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), out)
    data = next(warc.members(iter([next(Path(f"{tmp_path}/w").glob("*.gz")).read_bytes()])))
    assert warc.parse(data)["payload"] == b"text"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data.replace(b"text\r\n\r\n", b"tExt\r\n\r\n"))


def test_warc_replaces_other_bytes_and_holds_files_to_the_manifest(spark, tmp_path):
    kind, out = "page_id bigint, url string, html string", tmp_path / "w"
    df = spark.createDataFrame([(i, "u", f"text {i}") for i in range(30)], kind)
    names = {r.file: r for r in warc.write(df, f"file://{out}", shards=2).collect()}
    whole = {n: (out / n).read_bytes() for n in names}
    # another run's file of the same name and size: its bytes must go
    for n, data in whole.items():
        (out / n).write_bytes(bytes(len(data)))
    warc.write(df, f"file://{out}", shards=2)
    assert {n: (out / n).read_bytes() for n in names} == whole and warc.read(spark, f"file://{out}").count() == 30
    # whole records, but not the ones listed: one too many, then another file's
    first, second = sorted(names)
    for data in (whole[first] * 2, whole[second]):
        (out / first).write_bytes(data)
        with pytest.raises(Exception, match="differs from the manifest"):
            warc.read(spark, f"file://{out}").collect()


def test_chat_reconstruction(spark):
    events = [
        ("c", 1, 1, "message", "user", "hi"),
        ("c", 2, 2, "delta", "assistant", "Hel"),
        ("c", 3, 2, "delta", None, "lo"),
        ("c", 4, 1, "edit", "user", "hi!"),
        ("c", 5, 3, "message", "user", "more"),
        ("c", 6, 2, "regenerate", None, None),
        ("c", 7, 2, "delta", None, "Good "),
        ("c", 8, 2, "delta", None, "day"),
        ("c", 9, 3, "message", "user", "thanks"),
        (None, 1, 1, "message", None, None),
    ]
    df = spark.createDataFrame(events, "conv_id string, seq bigint, msg bigint, kind string, role string, text string").repartition(4)
    got = sorted(map(tuple, chat.reconstruct(df).collect()), key=str)
    assert got == sorted([("c", 1, "user", "hi!"), ("c", 2, "assistant", "Good day"), ("c", 3, "user", "thanks"), (None, 1, "", "")], key=str)
    cut = chat.reconstruct(df.where("seq <= 6"))
    assert sorted((r.msg, r.text) for r in cut.where("conv_id = 'c'").collect()) == [(1, "hi!"), (2, "")]


def fold(events):
    """One conversation's log, event by event: {msg: (role, text)}."""
    role, text = {}, {}
    for _, m, kind, r, t in sorted(events):
        if kind == "regenerate":
            for later in [x for x in text if x > m]:
                del text[later]
                role.pop(later, None)
        text[m] = text.get(m, "") + t if kind == "delta" else t
        if r and m not in role:
            role[m] = r
    return {m: (role.get(m, ""), t) for m, t in text.items()}


def test_chat_fold_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for seq in range(rng.randrange(1, 25)):
            kind = rng.choice(("delta", "delta", "delta", "message", "edit", "regenerate"))
            rows.append((c, seq, rng.randrange(4), kind, rng.choice(("user", "assistant", "")), "" if kind == "regenerate" else rng.choice(("a", "<b", "c#", "\\", ""))))
    df = spark.createDataFrame([(*r[:4], r[4] or None, r[5]) for r in rows], "conv_id bigint, seq bigint, msg bigint, kind string, role string, text string").repartition(5)
    got = {}
    for r in chat.reconstruct(df).collect():
        got.setdefault(r.conv_id, {})[r.msg] = (r.role, r.text)
    assert got == {c: fold([r[1:] for r in rows if r[0] == c]) for c in range(60)}


def test_chat_log_folds_into_its_turns(spark):
    rng = random.Random(8)
    text = lambda: rng.choice((None, "", "é<:#\\ 日本😀", "plain", "x" * 500))
    rows = [(c if c else None, t, rng.choice(("user", "assistant", None)), text()) for c in range(40) for t in range(rng.randrange(6))] + [(1, 0, "user", "same")] * 3
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4).withColumn("msg", F.lit("clash"))
    log = chat.as_log(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    turns = chat.as_events(df).select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    assert sorted(map(str, chat.reconstruct(log.repartition(3)).collect())) == sorted(map(str, turns.collect()))
    assert chat.reconstruct(chat.as_log(df.where("false"))).count() == 0


def test_chat_escape_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", "### User: x</turn>\n", "\\b\\l\\h\\\\", "a: b", "日本😀\n</turn>\n", "x" * 50_000, "\\"]
    rows = [(1, i, "assistant" if i % 2 else "us:er#<\\", t) for i, t in enumerate(texts)] + [(2, 0, None, None), (2, 0, None, None), (3, 5, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("msg", F.lit("clash"))
    rendered = chat.render(chat.reconstruct(chat.as_events(df)))
    back = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t) for _, _, r, t in rows[: len(texts)]]
    assert back[1].loss_text == "".join(texts[1::2])
    assert [(t.role, t.text) for t in back[2].turns] == [("", ""), ("", "")] and back[3].loss_text == ""
    for m in back[1].loss_mask:
        assert "</turn>" not in back[1].formatted[m.start : m.start + m.length]
    assert chat.digests(chat.read_back(chat.render(chat.reconstruct(chat.as_events(df.where("false")))))).count() == 0


def test_url_parts_and_rules(spark):
    urls = {
        "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "x://y.org": ("y.org", "", None, None),
        "x://y.com/fr/?q=://z.org/": ("y.com", "/fr/", "com/fr/", "allow"),
        "http://y.com/de/a\nb": ("y.com", "/de/a\nb", "com/de/", "block"),
        "http://y.com/frx": ("y.com", "/frx", None, None),
        "no scheme": ("", "", None, None),
        "a#b://c.org/d?": ("c.org", "/d", "org/", "allow"),
        "://É.org?x/": ("É.org", "", None, None),
        None: ("", "", None, None),
    }
    weights = url_filter.train(url_filter.training_urls(spark))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = url_filter.judge(df, weights).orderBy("page_id").collect()
    for r, want in zip(got, urls.values(), strict=True):
        assert (r.host, r.path, r.rule) == want[:3]
        assert r.verdict == want[3] if want[3] else r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert url_filter.judge(df.where("false"), weights).count() == 0
    assert url_filter.judge(df, weights, rules=()).where("rule IS NOT NULL").isEmpty()


def buckets_of(host, path):
    """The hashed n-grams of one URL, by Spark's hash of two strings: the first one's is the seed of the second."""
    out = set()
    for mark, part in (("h", host), ("p", path)):
        text = f"^{part}$"
        for i in range(max(len(text) - 3, 1)):
            h = xxhash.xxh64_intdigest(text[i : i + 4].encode(), xxhash.xxh64_intdigest(mark.encode(), 42))
            out.add((h - (h >> 63 << 64)) % url_filter.BUCKETS)
    return out


def split_url(url):
    _, mark, rest = (url or "").partition("://")
    k = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[k:]
    for c in "?#":
        path = path.partition(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    return (host, path) if mark else ("", "")


def test_url_query_against_brute_force(spark):
    import duckdb

    weights = url_filter.train(url_filter.training_urls(spark))
    urls = dict(duckdb.sql(f"SELECT page_id, url FROM '{DIR}/pages.parquet'").fetchall())
    got = queries.op8_url_filters(spark, DIR).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split_url(urls[r.page_id])
        fits = [(x, v) for x, v in url_filter.RULES if (host == x.partition("/")[0] or host.endswith("." + x.partition("/")[0])) and path.startswith("/" + x.partition("/")[2])]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        x = buckets_of(host, path)
        z = sum(weights[k] for k in x) / math.sqrt(len(x)) + weights[-1]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(z) < 1e-9 or r.verdict == (verdict or ("block" if z >= 0 else "allow"))
    # the same parts and rules in SQL
    rule = "CASE " + " ".join(f"WHEN (h = '{x.partition('/')[0]}' OR ends_with(h, '.{x.partition('/')[0]}')) AND starts_with(p, '/{x.partition('/')[2]}') THEN '{x}'" for x, _ in sorted(url_filter.RULES, key=lambda x: -len(x[0]))) + " END"
    sql = rf"""SELECT page_id, h, p, {rule} FROM (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS p FROM '{DIR}/pages.parquet')"""
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in got) == sorted(duckdb.sql(sql).fetchall())


def test_url_model_on_hosts_that_it_has_not_seen(spark):
    table = url_filter.training_urls(spark)
    right = total = 0
    for fold in range(4):
        w = url_filter.train(table.where(F.crc32("host") % 4 != fold))
        held = table.where(F.crc32("host") % 4 == fold).withColumn("s", url_filter.score(url_filter.host(F.col("url")), url_filter.path(F.col("url")), w))
        r = held.agg(F.count("*").alias("n"), F.count_if((F.col("s") >= 0.5) == (F.col("label") == 1)).alias("k")).first()
        right, total = right + r.k, total + r.n
    print(f"held-out hosts: {right} of {total}")
    assert right / total > 0.9
    assert url_filter.train(table) == url_filter.train(table.repartition(3))
    assert set(url_filter.train(table.where("false"))) == {0.0}
    # no host of the table is one that is judged
    judged = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(url_filter.host(F.col("url")).alias("host"))
    assert table.join(judged, "host").isEmpty()


def test_url_model_is_trained_without_rows_on_the_driver(spark, monkeypatch):
    table = url_filter.training_urls(spark).select("url", "label").union(spark.createDataFrame([(None, 1), ("http://a.org/", None)], "url string, label int"))
    x = url_filter.features(url_filter.host(F.col("url")), url_filter.path(F.col("url")))
    rows = [(sorted(r.x), r.label) for r in table.where("url IS NOT NULL AND label IS NOT NULL").select(x.alias("x"), "label").collect()]
    # the same gradient steps in NumPy
    m, y = np.zeros((len(rows), url_filter.BUCKETS)), np.array([label for _, label in rows], float)
    for k, (buckets, _) in enumerate(rows):
        m[k, np.array(buckets) - 1] = 1 / math.sqrt(len(buckets))
    w, b = np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(20):
        d = 1 / (1 + np.exp(-(m @ w + b))) - y
        w, b = w - 2.0 * (m.T @ d / len(rows) + 1e-3 * w), b - 2.0 * d.mean()
    most, whole = [0], type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda self: (out := whole(self), most.append(len(out)))[0])
    assert url_filter.train(table, steps=20) == pytest.approx([*w, b], rel=1e-9, abs=1e-12)
    assert max(most) <= 1
    monkeypatch.setattr(url_filter, "MAX_LABELS", len(rows) - 1)
    with pytest.raises(ValueError, match="labelled URLs"):
        url_filter.train(table)


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((60, 16))
    rows = [base[i % 60] + rng.standard_normal(16) * (0.12 if i >= 60 else 0) for i in range(200)]
    hot = rng.standard_normal(16)
    rows += [hot + rng.standard_normal(16) * 0.05 for _ in range(80)] + [hot, hot, hot * 2]
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    bad = [None, [], [0.0] * 16, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0, 2.0], [2.0, 4.0]]
    out += [(1000 + i, v) for i, v in enumerate(bad)] + [(None, [float(x) for x in base[3]]), (5, [float(x) for x in base[5]])]
    return out


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 16])
def test_vectors_against_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5).withColumn("entity", F.lit("clash"))
    got = sorted(map(tuple, embed_dedup.near_duplicates(df, 0.9, block=block).collect()), key=str)
    unit = []
    for _, v in rows:
        x = np.array([np.nan if y is None else y for y in v or []], float)
        unit.append(x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0 else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    c = components([d for d, _ in rows], links)
    want = sorted(((d, k, x, d == x) for (d, _), k, x in zip(rows, n, c, strict=True)), key=str)
    assert got == want  # at this size every pair is found


def test_filters_find_nine_in_ten_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    for n in (5_000, 500_000):
        x = rng.standard_normal((1500, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        p = rng.standard_normal(x.shape)
        p -= (p * x).sum(1, keepdims=True) * x
        p /= np.linalg.norm(p, axis=1, keepdims=True)
        y = 0.9 * x + math.sqrt(1 - 0.81) * p
        c = embed_dedup.code_size(n, 64)
        met = np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(embed_dedup.decode(x, c), embed_dedup.decode(y, c), strict=True)])
        assert met >= 0.93


def test_recall_at_the_threshold_holds_as_tables_grow():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = rng.standard_normal(x.shape)
    p -= (p * x).sum(1, keepdims=True) * x
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    y = 0.9 * x + math.sqrt(1 - 0.81) * p
    for n, pairs in ((5_000_000, 800), (50_000_000, 800), (1_000_000_000, 300)):
        c = embed_dedup.code_size(n, 64)
        a, b = embed_dedup.decode(x[:pairs], c), embed_dedup.decode(y[:pairs], c)
        assert np.mean([len(np.intersect1d(f, g)) > 0 for f, g in zip(a, b, strict=True)]) >= 0.95
        assert all((np.diff(f) > 0).all() for f in a)


def at_the_threshold(rng, rows, dim):
    x = rng.standard_normal((rows, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = rng.standard_normal(x.shape)
    p -= (p * x).sum(1, keepdims=True) * x
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    return x, 0.9 * x + math.sqrt(1 - 0.81) * p


@pytest.mark.parametrize("dim", [2, 3, 5, 8, 10, 12, 16, 20, 32])
def test_recall_holds_with_few_dimensions(dim):
    x, y = at_the_threshold(np.random.default_rng(dim), 500, dim)
    for n, pairs in ((500_000, 500), (50_000_000, 200)):
        c = embed_dedup.code_size(n, dim)
        a, b = embed_dedup.decode(x[:pairs], c), embed_dedup.decode(y[:pairs], c)
        assert np.mean([len(np.intersect1d(f, g)) > 0 for f, g in zip(a, b, strict=True)]) >= 0.94


def test_many_short_vectors_against_brute_force(spark):
    """Some thousand vectors of eight dimensions and one of its near copies' cluster, in small blocks: links of each row."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((2500, 8)), rng.standard_normal(8) + 0.02 * rng.standard_normal((500, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, 0.9, block=256).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_vectors_under_several_codes(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "code_count", lambda c, dim: 3)
    test_vectors_against_brute_force(spark, 16)


def test_sketches_of_near_vectors_are_near():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200_000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = rng.standard_normal(x.shape)
    p -= (p * x).sum(1, keepdims=True) * x
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    differ = np.bitwise_count(embed_dedup.sketch(x) ^ embed_dedup.sketch(0.9 * x + math.sqrt(1 - 0.81) * p)).sum(axis=1)
    limit = embed_dedup.sketch_limit(0.9)
    assert (differ > limit).mean() < 2e-4 and limit < 0.24 * embed_dedup.BITS
    assert embed_dedup.sketch_limit(1.0) == 0 and embed_dedup.sketch_limit(-1.0) == embed_dedup.BITS


def test_only_rows_with_a_near_sketch_fetch_vectors(spark, monkeypatch):
    saved, save = {}, Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(600)]
    rows += [(1000 + i, (np.array(v) + 0.01).tolist()) for i, v in rows[:20]]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert got.where("n_links = 1").count() == 40
    assert saved["active"].select("entity").distinct().count() < 0.2 * saved["listed"].select("entity").distinct().count()
    assert "unit" not in saved["listed"].columns


def test_vectors_of_no_use(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert embed_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    bad = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (None, None)], kind)
    assert sorted(map(tuple, embed_dedup.near_duplicates(bad).collect()), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)]


def test_list_decoding_finds_all_filters():
    x = np.random.default_rng(1).standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = 40
    left, right = embed_dedup.codes(10, c)
    scores = (x[:, :5] @ left.T)[:, :, None] + (x[:, 5:] @ right.T)[:, None, :]
    for k, found in enumerate(embed_dedup.decode(x, c)):
        order = np.argsort(-scores[k].ravel(), kind="stable")
        assert set(found) == set(order[: len(found)].tolist()) and len(found) >= embed_dedup.LEAST


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(200)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None), (7, 7)], "a bigint, b bigint")
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    want = components(nodes, [(at[a], at[b]) for a, b in edges if a != b])
    got = {r.id: r.root for r in connect(df, Workspace(spark, "t")).collect()}
    assert got == dict(zip(nodes, want, strict=True))
    assert connect(df.where("false"), Workspace(spark, "t")).count() == 0


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    df = queries.queries()[name](spark, DIR)
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(norm, r)) for r in df.select(*names).collect()) == sorted(tuple(map(norm, r)) for r in cur.fetchall())


def test_no_other_module_imports_this_subpackage():
    root = Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    from pulsegrid.llm import bpe

    from .helpers import words
    from .test_text_operators import join_truth, removal_truth

    ws = Workspace(spark, "t")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before, seen = docs, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        after = ws.save(stage(spark, before, DIR), f"s{k}")
        seen.append((name, before, after))
        before = after
    assert [x.count() for _, _, x in seen][-1] == seen[3][2].count()
    for _, _, after in seen[:-1]:
        assert after.columns == docs.columns
    # near copies: one of each group, the least id
    rows = [(r.doc_id, r.text) for r in seen[1][1].collect()]
    assert {r.doc_id for r in seen[1][2].collect()} == {d for d, _, c in join_truth(rows, 5, 80, 100) if d == c}
    # passages: the words that are left
    rows = [(r.doc_id, r.text) for r in seen[2][1].collect()]
    want = {d: (n, g, h) for d, n, g, h in removal_truth(rows, 13)}
    got = {r.doc_id: r for r in seen[2][2].collect()}
    assert set(got) == {d for d, (n, g, _) in want.items() if g < n or not n}
    for d, r in got.items():
        assert hashlib.sha256(b" ".join(words(r.text))).hexdigest() == want[d][2]
        assert r.n_chars == len(r.text)
    # the mix: every row as often as its step along its source crosses an integer
    rows = [(r.doc_id, r.text, r.source) for r in seen[3][1].collect()]
    want = {d: n for d, n in copies_truth(rows).items() if n}
    assert {r.doc_id: r["count"] for r in seen[3][2].groupBy("doc_id").count().collect()} == want
    assert seen[3][2].select("doc_id", "text").distinct().join(seen[3][1], ["doc_id", "text"], "left_anti").isEmpty()
    import public_tokenizers as P

    codec = bpe.ByteBpe(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    texts = {r.doc_id: r.text for r in seen[3][2].collect()}
    for r in seen[4][2].collect():
        assert codec.decode(np.array(r.ids, np.uint32).tobytes()).decode() == texts[r.doc_id]
    # language ID: what plain compression with the learned dictionaries is sure of
    model = langid.learn(docs.where(~langid.held_out()))
    sure = {r.doc_id for r in docs.select("doc_id", "text").collect() if language_truth(r.text, model)}
    assert {r.doc_id for r in seen[0][2].collect()} == sure and len(sure) > 0.97 * docs.count()


def language_truth(text, model):
    """Whether the best language is ahead by the least margin."""
    if not text or not any(unicodedata.category(c)[0] == "L" for c in text):
        return False
    data, sizes = text.lower().encode(), []
    for dictionary in model.values():
        p = zstandard.ZstdCompressionParameters.from_level(6, strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, source_size=8192, dict_size=len(dictionary), write_content_size=0, write_checksum=0, write_dict_id=0)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
        sizes.append(sum(len(c.compress(data[i : i + 8192])) for i in range(0, len(data), 8192)))
    first, second = sorted(sizes)[:2]
    return (second - first) / first >= 0.002


def copies_truth(rows):
    """How often the mix takes each document."""
    from .helpers import words
    from .test_text_operators import mix_targets

    head = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    size = {d: len(words(t)) for d, t, _ in rows}
    total = {}
    for d, _, s in rows:
        total[s] = total.get(s, 0) + size[d]
    target, parts, out = mix_targets(total, (5.0, 2.0, 1.0)), max(16, math.ceil(math.sqrt(len(rows)) / 4)), {}
    for source in total:
        at = head(f"mix|{source or ''}|{'true' if source is None else 'false'}") / 2**32
        rate = target[source] / total[source] if total[source] else 0.0
        key = lambda d: (len(str(size[d])) * 10 + int(str(size[d])[0]), head(str(d)) % parts, size[d], d)
        for k, d in enumerate(sorted((d for d, _, s in rows if s == source), key=key), 1):
            out[d] = math.floor(at + rate * k) - math.floor(at + rate * (k - 1))
    return out


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    bare = docs.limit(5).drop("n_chars")
    assert pipeline.substring_dedup(spark, bare, DIR).columns == bare.columns
