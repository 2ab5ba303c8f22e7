"""The data source of signal files against arrays made for it."""

import numpy as np
import pytest
from pyspark.sql import types as T

from pulsegrid.sources import files, signals

FULL = signals.SCHEMA


def load(spark, path, **options):
    signals.register(spark)
    return spark.read.format(signals.NAME).options(path=str(path), **options).load()


def npy_folder(path):
    rng = np.random.default_rng(0)
    made = {}
    for k, n in (("a", 5001), ("b", 300), ("c", 0)):
        for c, kind in (("fhr", np.float32), ("uc", np.float64)):
            x = rng.normal(100, 10, n + (7 if c == "uc" else 0)).astype(kind)
            x[3:5] = np.nan
            np.save(path / f"{k}_{c}.npy", x)
            made[k, c] = x
    np.save(path / "ints_fhr.npy", np.arange(10, dtype=np.int16))
    np.save(path / "flat_fhr.npy", np.zeros((2, 2)))
    (path / "bad_fhr.npy").write_bytes(b"no array")
    good = (path / "a_fhr.npy").read_bytes()
    (path / "cut_fhr.npy").write_bytes(good[:-100])
    return made


def same(got, want):
    return len(got) == len(want) and all((g is None and w != w) or g == pytest.approx(w) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_numpy_files_in_pieces(spark, tmp_path, piece):
    made = npy_folder(tmp_path)
    df = load(spark, tmp_path, pieceSamples=piece, partitionBytes=4096)
    rows = df.collect()
    if piece == 64:
        assert df.rdd.getNumPartitions() > 10 and max(len(r.x or []) for r in rows) == 64
    assert {r.record for r in rows if r.error} == {"bad", "cut", "flat"} and all(r.x is None and r.start is None for r in rows if r.error)
    for (k, c), x in made.items():
        got = [v for r in sorted((r for r in rows if (r.record, r.channel) == (k, c)), key=lambda r: r.start) for v in r.x]
        assert same(got, x)
    both = {r.record: r for r in signals.whole(df).collect()}
    assert len(both["a"].fhr) == len(both["a"].uc) == 5001 and same(both["b"].uc, made["b", "uc"][:300])
    assert both["ints"].fhr == [float(k) for k in range(10)] and both["ints"].uc is None and both["bad"].error


def test_filters_open_their_files_alone(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    npy_folder(tmp_path)
    reader = signals.SignalReader(FULL, {"path": str(tmp_path)})
    left = list(reader.pushFilters([In(("record",), ("a", "zz")), EqualTo(("channel",), "uc"), GreaterThan(("start",), 5)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert {p.path for part in reader.partitions() for p in part.pieces} == {str(tmp_path / "a_uc.npy")} == set(reader.opened)
    df = load(spark, tmp_path).where("record = 'b' AND channel = 'fhr'")
    (tmp_path / "a_fhr.npy").write_bytes(b"")
    assert [(r.record, r.channel, len(r.x)) for r in df.collect()] == [("b", "fhr", 300)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "= b" not in plan and "= fhr" not in plan  # nothing is left of them for Spark


def test_heads_alone_without_samples(spark, tmp_path):
    npy_folder(tmp_path)
    signals.register(spark)
    df = spark.read.format(signals.NAME).schema("record string, channel string, error string").options(path=str(tmp_path), pieceSamples=64).load()
    assert df.where("record = 'a'").count() == 2
    reader = signals.SignalReader(T.StructType([FULL["record"], FULL["start"]]), {"path": str(tmp_path)})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert all(b.schema.names == ["record", "start"] for b in batches)


def pack(form, values):
    v = np.asarray(values).ravel().astype(np.int64)
    if form == "212":
        v = np.append(v, 0) if len(v) % 2 else v
        a, b = v[::2] & 0xFFF, v[1::2] & 0xFFF
        return np.stack([a & 255, (a >> 8) | (b >> 8) << 4, b & 255], 1).astype(np.uint8).tobytes()
    if form == "80":
        return (v + 128).astype(np.uint8).tobytes()
    size = {"16": 2, "24": 3, "32": 4}[form]
    return v.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


@pytest.mark.parametrize("form", ["16", "24", "32", "80", "212"])
@pytest.mark.parametrize("width", [1, 2, 3])
def test_wfdb_formats(spark, tmp_path, form, width):
    rng = np.random.default_rng(int(form) + width)
    raw = rng.integers(-100, 100, (1001, width))
    raw[7, 0] = signals.CODECS[form].missing
    (tmp_path / "r.dat").write_bytes(b"#" * 5 + pack(form, raw))
    names = ["my FHR", "UC", "other"][:width]
    lines = [f"r.dat {form}+5 2.5({10 * k})/bpm 12 0 0 0 0 {n}" for k, n in enumerate(names)]
    (tmp_path / "r.hea").write_text("\n".join([f"r {width} 4 1001", *lines, "#pH 7.1"]))
    reader = signals.SignalReader(FULL, {"path": str(tmp_path), "kind": "wfdb", "piecesamples": "101"})
    got = {c: [] for c in signals.CHANNELS}
    for part in reader.partitions():
        for batch in reader.read(part):
            for r in batch.to_pylist():
                assert r["error"] is None and r["fs"] == 4 and r["start"] == len(got[r["channel"]])
                got[r["channel"]] += r["x"]
    for k, c in enumerate(signals.CHANNELS[: min(width, 2)]):
        want = np.where(raw[:, k] == signals.CODECS[form].missing, np.nan, (raw[:, k] - 10 * k) / 2.5)
        assert same(got[c], want)
    if width == 1:
        assert got["uc"] == []


def test_wfdb_records_agree_with_the_reader_of_whole_files(spark, tmp_path):
    raw = np.array([[14000, 50], [-32768, 100], [14200, -32768]], "<i2")
    for k, names in (("a", ("FHR", "UC")), ("b", ("x", "y"))):
        (tmp_path / f"{k}.dat").write_bytes(raw.tobytes())
        (tmp_path / f"{k}.hea").write_text(f"{k} 2 4 3\n{k}.dat 16 100(0)/bpm 12 0 14000 0 0 {names[0]}\n{k}.dat 16 10/nd 12 50 0 0 0 {names[1]}\n")
    (tmp_path / "c.hea").write_text("c 1 4 3\nc.dat 311 100/bpm 12 0 0 0 0 FHR\n")
    (tmp_path / "d.hea").write_text("d 1 4 3\nd.dat 16 100/bpm 12 0 0 0 0 FHR\n")
    got = {r.record: r for r in signals.whole(load(spark, tmp_path, kind="wfdb")).collect()}
    want = {r.record: r for r in files.read_wfdb(spark, str(tmp_path)).where("record = 'a'").collect()}
    assert (got["a"].fhr, got["a"].uc, got["a"].fs) == (want["a"].fhr, want["a"].uc, want["a"].fs)
    assert "b" not in got and "format" in got["c"].error and "no file" in got["d"].error
    placed = {r.record: r for r in signals.whole(load(spark, tmp_path, kind="wfdb", channels="position")).collect()}
    assert placed["b"].fhr == got["a"].fhr and placed["b"].uc == got["a"].uc


def test_a_file_larger_than_a_row_can_be(tmp_path):
    """Sparse, 2^31 bytes and more: only its pieces are ever read."""
    n = (1 << 29) + 1000
    with open(tmp_path / "big_fhr.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (n,)})
        at = f.tell()
        f.seek(at + 4 * (n - 1))
        f.write(np.float32(7).tobytes())
    reader = signals.SignalReader(FULL, {"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) > 30 and sum(p.count for x in parts for p in x.pieces) == n
    last = list(reader.read(signals.Pieces(parts[-1].pieces[-1:])))[0].to_pylist()[0]
    assert last["x"][-1] == 7.0 and last["x"][0] == 0.0


def test_options_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        signals.SignalReader(FULL, {})
    with pytest.raises(ValueError):
        signals.SignalReader(FULL, {"path": str(tmp_path), "kind": "edf"})
    assert load(spark, tmp_path).collect() == []
