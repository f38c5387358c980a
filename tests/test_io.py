import io
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec import spectral as S
from loomvec.sources import readers as R
from loomvec.sources import sinks as W
from loomvec.stages import Runner
from loomvec.streaming.windows import sessions, tumbling


def wav(y: np.ndarray, rate: int = 16_000, width: int = 2, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        scaled = np.clip(np.round(y * (1 << (8 * width - 1))), -(1 << (8 * width - 1)), (1 << (8 * width - 1)) - 1).astype(np.int64)
        raw = (scaled + 128).astype(np.uint8).tobytes() if width == 1 else scaled.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        f.writeframes(raw)
    return out.getvalue()


def tone(hz: float, seconds: float = 1.0, rate: int = 16_000) -> np.ndarray:
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_decode(width):
    y = tone(440)
    got, rate = S.decode_wav(wav(y, width=width))
    assert rate == 16_000 and np.abs(got - y).max() < (0.01 if width == 1 else 1e-3)


def test_resample_keeps_a_tone():
    got = S.resample(tone(440, rate=22_050).astype(np.float32), 22_050, 16_000)
    want = tone(440)
    assert len(got) == 16_000 and np.abs(got - want)[500:-500].max() < 5e-3


def test_spectrum_peaks_at_the_tone():
    spec = S.log_spectrum(tone(1000).astype(np.float32))
    assert spec.shape == (513,) and int(spec.argmax()) == 64
    assert S.SpectralConfig().band == (6, 481)
    assert int(S.natural_spectrum(tone(1000)).argmax()) == 64
    for bad in ({"n_fft": 3}, {"hop": 2048}, {"high_hz": 9000.0}, {"blocks": 3}, {"seeds": (1, 1)}, {"seeds": ()}):
        with pytest.raises(ValueError):
            S.SpectralConfig(**bad)


def plain_spectrum(y, cfg):
    """One frame after the other."""
    y = [float(v) - float(np.mean(y)) for v in y] + [0.0] * max(0, cfg.n_fft - len(y))
    pieces = [np.array(y[i : i + cfg.n_fft]) for i in range(0, len(y) - cfg.n_fft + 1, cfg.hop)]
    rms = [math.sqrt(float(np.mean(x * x))) for x in pieces]
    db = [20 * math.log10(r + 1e-12) for r in rms]
    cut = max(float(np.quantile(db, cfg.reference_percentile / 100)) - cfg.top_db, cfg.floor_db)
    on = [i for i, v in enumerate(db) if v >= cut]
    if len(on) < cfg.min_active:
        on = sorted(range(len(db)), key=lambda i: (rms[i], i))[-cfg.min_active :]
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / cfg.n_fft) for k in range(cfg.n_fft)])
    rows = [10 * np.log10(np.abs(np.fft.rfft(pieces[i] * window)) ** 2 / (window**2).sum() + cfg.epsilon) for i in on]
    return np.median(rows, axis=0), len(on) / len(pieces)


@pytest.mark.parametrize("n", [300, 1024, 1500, 9000])
def test_spectrum_as_plain_version(n):
    rng, cfg = np.random.default_rng(n), S.SpectralConfig()
    y = (rng.normal(size=n) * np.linspace(0, 1, n) ** 6).astype(np.float32)
    want, share = plain_spectrum(y, cfg)
    assert S.log_spectrum(y, cfg) == pytest.approx(want, abs=2e-3)
    assert S.loud_starts((y - y.mean(dtype=np.float64)).astype(np.float32), cfg)[1] == pytest.approx(share)


def test_extraction_and_residuals(spark, tmp_path):
    for name, y in (("f", tone(1000)), ("r", tone(500)), ("s", tone(500, 0.2))):
        (tmp_path / f"{name}.wav").write_bytes(wav(y))
    (tmp_path / "broken.wav").write_bytes(b"no audio")
    spectra = S.extract(R.audio_files(spark, str(tmp_path))).withColumn("path", R.from_path(F.col("path"), -1)).cache()
    status = {r.path: (r.status, r.qc_status, r.exclusion_reason) for r in S.qc(spectra).collect()}
    assert status["f.wav"] == ("ok", "ok", "") and status["broken.wav"][0] == "fail" and "load_error" in status["broken.wav"][2] and status["s.wav"][2] == "too_short"
    pairs = spark.createDataFrame([("p1", "f.wav", "r.wav"), ("p2", "f.wav", "broken.wav")], "pair_id string, fake_path string, real_path string")
    got = {r.pair_id: r for r in S.pair_residuals(pairs, spectra).collect()}
    assert got["p2"].status == "fail" and got["p1"].status == "ok"
    assert np.median(got["p1"].r[6:487]) == pytest.approx(0.0, abs=1e-4)


def test_readers_and_sinks(spark, tmp_path):
    d = tmp_path / "fake" / "en" / "gen1"
    d.mkdir(parents=True)
    (d / "meta.csv").write_text('a.wav|o.wav|en|True|1.5|x|m|arch|he said "hi"\nb.wav|p.wav|de|False|2|x|m|arch|t\n')
    meta = R.meta_csv(spark, str(tmp_path / "fake/*/*/meta.csv"))
    assert sorted((r.path, r.lang_folder, r.generator_dir, r.is_original_language) for r in meta.collect()) == [("a.wav", "en", "gen1", True), ("b.wav", "en", "gen1", False)]
    assert R.mixed_languages(meta).count() == 1 and R.meta_csv(spark, str(tmp_path / "fake/*/*/meta.csv"), True).count() == 1
    (tmp_path / "log.jsonl").write_text('{"k": 1, "s": 1, "v": "a"}\nbroken\n{"k": 1, "s": 2, "v": "b"}\n')
    assert [r.v for r in R.json_lines(spark, str(tmp_path / "log.jsonl"), "k int, s int, v string", ["s"], ["k"]).collect()] == ["b"]
    np.save(tmp_path / "m.npy", np.eye(3, dtype=np.float32))
    assert sorted((r.row, tuple(r.r)) for r in R.npy(spark, str(tmp_path / "m.npy")).collect()) == [(i, tuple(np.eye(3)[i])) for i in range(3)]
    assert [r.row for r in R.npy(spark, str(tmp_path / "m.npy"), spark.range(2, 9).withColumnRenamed("id", "row")).collect()] == [2]
    np.savez(tmp_path / "b.npz", generator_ids=np.array(["g"]), block_ids=np.arange(2), block_vectors=np.ones((1, 2, 3)), block_counts=np.array([[4, 0]]))
    assert R.block_npz(spark, str(tmp_path / "b.npz")).count() == 1
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    W.write_split(df, {str(tmp_path / "one"): F.col("a") == 1, str(tmp_path / "all"): F.lit(True)})
    assert R.row_count(spark, str(tmp_path / "one")) == 1 and R.parquet(spark, str(tmp_path / "all"), "b").columns == ["b"]
    W.write_csv(df, str(tmp_path / "csv"))
    assert R.csv_with_header(spark, str(tmp_path / "csv"), "a", "b").count() == 2
    W.report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "report"))
    report = R.json_report(spark, str(tmp_path / "report"))
    assert report == {"a": 1, "b": None} and R.find_key({"x": {"a": 2}, "a": 1}, "a") == 1
    with pytest.raises(KeyError):
        R.find_key(report, "none")
    W.append_json_lines(df, str(tmp_path / "lines"))
    W.append_json_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    (tmp_path / "a.txt").write_text("hi")
    assert len(W.bundle(spark, str(tmp_path / "z.zip"), str(tmp_path / "a.txt"), str(tmp_path / "none"))) == 1
    assert R.zip_member(spark, str(tmp_path / "z.zip"), ".txt") == b"hi"
    with pytest.raises(Exception, match="0 members"):
        R.zip_member(spark, str(tmp_path / "z.zip"), ".csv")
    assert R.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "a.txt")).endswith("a.txt")
    with pytest.raises(FileNotFoundError):
        R.first_existing(spark, str(tmp_path / "none"))
    assert json.dumps({}) and W.config_digest({"b": 1, "a": 2}) == W.config_digest({"a": 2, "b": 1})


def test_stages_resume_by_configuration(spark, tmp_path):
    def build(seed):
        r = Runner(spark, str(tmp_path / "stages"), {"seed": seed})
        r.add("base", lambda s, c: s.range(c["seed"]))
        r.add("sum", lambda s, c, base: base.agg(F.sum("id").alias("n")), "base")
        return r

    first, again, other = build(4), build(4), build(5)
    assert first.table("sum").first().n == 6 and first.ran == ["base", "sum"]
    assert again.table("sum").first().n == 6 and again.ran == []
    assert other.table("sum").first().n == 10 and other.ran == ["base", "sum"]


def test_windows_on_a_stream_as_on_a_table(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    table.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = tumbling(stream, "ts", "1 day", "value", "event_type").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.window_start.replace(tzinfo=None), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("w")) == key(tumbling(table, "ts", "1 day", "value", "event_type"))
    assert sessions(table, "ts", "30 minutes", "user_id").agg(F.sum("n")).first()[0] == table.count()


def test_locked_schema_csv_and_arrays(spark, tmp_path):
    from pyspark.sql import types as T

    from loomvec.operators.manifest import GuardError

    df = spark.createDataFrame([(1, "x, \u00e9"), (2, None)], "a long, b string")
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.IntegerType())])
    W.write_locked(df, str(tmp_path / "locked"), schema)
    assert spark.read.parquet(str(tmp_path / "locked")).dtypes == [("b", "string"), ("a", "int")]
    with pytest.raises(GuardError):
        W.write_locked(df.drop("a"), str(tmp_path / "no"), schema)
    for bom, start in ((True, b"\xef\xbb\xbfa,b\n"), (False, b"a,b\n")):
        W.write_csv_file(df.orderBy("a"), str(tmp_path / "t.csv"), bom=bom)
        assert (tmp_path / "t.csv").read_bytes() == start + '1,"x, \u00e9"\n2,\n'.encode()
    with pytest.raises(GuardError):
        W.write_csv_file(df, str(tmp_path / "t.csv"), most=1)
    blocks = spark.createDataFrame([("g", 1, 4, [1.0, 2.0]), ("h", 0, 3, [5.0, 6.0])], "generator string, block int, n int, r array<double>")
    W.write_arrays(spark, str(tmp_path / "b.npz"), **W.block_arrays(blocks))
    assert sorted(map(tuple, R.block_npz(spark, str(tmp_path / "b.npz")).select("generator", "block", "n").collect())) == [("g", 1, 4), ("h", 0, 3)]
    W.write_arrays(spark, str(tmp_path / "null.npy"), null=np.arange(5.0))
    assert np.load(tmp_path / "null.npy").tolist() == [0, 1, 2, 3, 4]
    assert [W.tick(x) for x in (0.5, -0.25, -0.0001, 12.0, 0)] == ["0.5", "\u22120.25", "0", "12", "0"]


def test_digests_and_signatures(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / name).write_bytes(name.encode() * 1000)
    got = {r.path[-1]: (r.length, r.sha256) for r in R.file_digests(spark, str(tmp_path / "in")).collect()}
    assert got == {x: (1000, hashlib.sha256(x.encode() * 1000).hexdigest()) for x in "ab"}
    one = R.input_signature(spark, str(tmp_path / "in"))
    assert one == R.input_signature(spark, str(tmp_path / "in"))
    (tmp_path / "in" / "b").write_bytes(b"longer" * 1000)
    assert one != R.input_signature(spark, str(tmp_path / "in"))


def test_command(spark, sf_dir, tmp_path, capsys):
    from loomvec.__main__ import QUICK, main

    args = ["--tables", sf_dir, "--output", str(tmp_path / "out"), "--cores", "4"]
    assert main([*args, "footer_counts", "label_map"]) == ["footer_counts", "label_map"]
    assert main([*args, "footer_counts"]) == [] and main([*args, "--force", "footer_counts"]) == ["footer_counts"]
    assert main(["--list", "--mode", "quick"]) == [] and capsys.readouterr().out.split() == list(QUICK)
    for bad in (["--tables", "x"], [*args, "nothing"]):
        with pytest.raises(SystemExit):
            main(bad)
    assert len(list((tmp_path / "out").glob("run-*.json"))) >= 1
