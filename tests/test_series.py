"""Chunked series operators against the whole series in memory, with chunks so small that every border is crossed."""

import random

import duckdb
import plain
import pytest
from pyspark.sql import functions as F

from condense.functions.doubles import two_places
from condense.operators import motion
from condense.operators.ranks import brackets, percentiles, pick_ranks, value_counts
from condense.operators.series import attach, div, running, with_halo, with_position

CHUNKS = [3, 8, 65_536]


def series(seed, cases=60, longest=40, values=None):
    rnd = random.Random(seed)
    values = values or (lambda: float(rnd.choice([0, 1, 2, 3, 5, 8, 20])))
    return {f"f{c}": [values() for _ in range(rnd.randint(1, longest))] for c in range(cases)}


def energies(spark, data):
    rows = [(f, k, x) for f, xs in data.items() for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, "file_id string, k long, energy double")


def by_file(rows, *cols):
    out = {}
    for r in sorted(rows, key=lambda r: (r["file_id"], r[cols[0]])):
        out.setdefault(r["file_id"], []).append(tuple(r[c] for c in cols[1:]) if len(cols) > 2 else r[cols[1]])
    return out


@pytest.mark.parametrize("chunk", CHUNKS)
def test_position_and_running(spark, chunk):
    data = series(1)
    df = energies(spark, data)
    slot = div(F.col("k"), chunk)
    numbered = with_position(df, ["file_id"], ["k"], slot, "pos").collect()
    assert all(r["pos"] == r["k"] for r in numbered)
    got = running(df, ["file_id"], ["k"], slot, {"top": ("max", F.col("energy"))}, reverse=True).collect()
    for r in got:
        later = data[r["file_id"]][r["k"] + 1 :]
        assert r["top"] == (max(later) if later else None)


@pytest.mark.parametrize("chunk", [3, 65_536])
def test_rows_without_an_order_value_are_kept(spark, chunk):
    df = spark.createDataFrame([("a", None), ("a", 9), ("a", 1)], "file_id string, t long")
    slot = div(F.col("t"), chunk)
    got = {r["t"]: r["pos"] for r in with_position(df, ["file_id"], ["t"], slot, "pos").collect()}
    assert got == {None: 0, 1: 1, 9: 2}


@pytest.mark.parametrize("chunk", CHUNKS)
def test_running_median(spark, chunk):
    data = series(2)
    got = by_file(motion.running_median(energies(spark, data), 7, chunk).collect(), "k", "energy")
    assert got == {f: plain.median(xs, 7) for f, xs in data.items()}


def test_even_median_window_is_refused(spark):
    with pytest.raises(ValueError):
        motion.running_median(energies(spark, {"a": [1.0]}), 4)


@pytest.mark.parametrize("chunk", [5, 8, 65_536])
def test_early_end(spark, chunk):
    data = series(3)
    data["exact"] = [1.0] * 4  # the window is reached at the last energy
    got = by_file(motion.cut_quiet_tail(energies(spark, data), 4, 6.0, chunk).collect(), "k", "energy")
    assert got == {f: plain.early(xs, 4, 6.0) for f, xs in data.items()}
    assert got["exact"] == [1.0] * 4 + [0.0]


def test_percentiles_and_ranks(spark):
    data = series(4, values=None) | {"hot": [7.0] * 500, "one": [2.5]}
    df = energies(spark, data)
    for r in percentiles(df, ["file_id"], "energy", {"p5": 0.05, "p20": 0.2}).collect():
        xs = data[r["file_id"]]
        assert r["n"] == len(xs)
        assert r["p5"] == pytest.approx(plain.percentile(xs, 0.05), abs=1e-12)
        assert r["p20"] == pytest.approx(plain.percentile(xs, 0.2), abs=1e-12)
    middle = {"mid": (0.5, lambda n: F.floor(n / 2).cast("long"))}
    for accuracy in (10, 100, 10_000):
        for r in pick_ranks(df, ["file_id"], "energy", middle, accuracy).collect():
            xs = sorted(data[r["file_id"]])
            assert r["mid"] == xs[len(xs) // 2]


def test_percentiles_to_the_last_bit(spark):
    con = duckdb.connect()
    dice = random.Random(11)
    data = {str(n): [round(dice.expovariate(0.02), 2) for _ in range(n)] for n in range(1, 130)} | {"tied": [0.1] * 30 + [0.7] * 47}
    data["huge"], data["endless"] = [x * 1e303 for x in data["90"]], [*data["9"], float("inf")]
    got = percentiles(energies(spark, data), ["file_id"], "energy", {"p5": 0.05, "p20": 0.2}).collect()
    for r in got:
        want = con.execute("SELECT quantile_cont(x, 0.05), quantile_cont(x, 0.2) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [data[r["file_id"]]])
        close = pytest.approx if r["file_id"] == "huge" else (lambda v: v)
        assert (r["p5"], r["p20"]) == close(want.fetchone()), r["file_id"]
    assert len(got) == len(data)


def test_two_places_as_c_writes_them(spark):
    values = [i / 1000 + w for i in range(0, 2000, 5) for w in (0.0, 64660.0)] + [-0.004, -1.255, 59.995, 59.9999, 99_999.995, 1e15]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_places(F.col("v")).alias("t"), two_places(F.col("v"), 5).alias("w"))
    for r in rows.collect():
        assert (r["t"], r["w"]) == (f"{r['v']:.2f}", f"{r['v']:.2f}".rjust(5, "0") if r["v"] >= 0 else r["w"])


def test_ranks_whatever_the_spacing(spark):
    n = 1_000_000
    place = F.pmod(F.col("id") * 7_919, F.lit(n))
    shapes = {
        "close": place * 1e-9,
        "far": (place - n / 2) * 1e12,
        "twin": F.when(place < n // 3, -5.0).otherwise(place.cast("double")),
    }
    df = spark.range(n).select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("v")) for k, v in shapes.items()])).alias("r")).select("r.*")
    expected = {"close": lambda i: i * 1e-9, "far": lambda i: (i - n / 2) * 1e12, "twin": lambda i: -5.0 if i < n // 3 else float(i)}
    wanted = {"first": (0.0, lambda n: F.lit(0)), "some": (0.2, lambda n: F.floor(n * 0.2)), "mid": (0.5, lambda n: F.floor(n / 2)), "last": (1.0, lambda n: n - 1)}
    for r in pick_ranks(df, ["key"], "v", wanted).collect():
        got = [r[c] for c in wanted]
        assert got == [pytest.approx(expected[r["key"]](i), rel=1e-12) for i in (0, n // 5, n // 2, n - 1)]
    counted = value_counts(df, ["key"], "v")
    ends = brackets(df, counted, ["key"], "v", wanted)
    for name in wanted:
        held = counted.join(ends, "key").where(F.col("_v").between(F.col(f"_from_{name}"), F.col(f"_to_{name}")))
        most = held.groupBy("key").count().agg(F.max("count"), F.count(F.lit(1))).first()
        assert most[1] == 3 and most[0] <= n * 8 / 10_000, name


def test_a_bracket_that_misses_its_rank_is_opened(spark):
    df = spark.range(5_000).select(F.lit("a").alias("key"), F.col("id").cast("double").alias("v"))
    wrong = {"last": (0.1, lambda n: n - 1)}  # the share says another place than the rank
    assert pick_ranks(df, ["key"], "v", wrong, 100).first()["last"] == 4_999.0


@pytest.mark.parametrize("chunk", CHUNKS)
def test_threshold_and_smoothing(spark, chunk):
    data = series(5, cases=120) | {"one": [4.0], "flat": [3.0] * 9}
    df = energies(spark, data)
    thresholds = motion.noise_threshold(df)
    states = {r["file_id"]: r for r in thresholds.collect()}
    assert states["one"]["analysis_status"] == "FAILED"
    assert states["flat"]["threshold"] == 3.5
    labels = motion.raw_labels(df, thresholds, chunk)
    raw = by_file(labels.collect(), "i", "is_motion")
    want = {
        f: [False] + [x > states[f]["threshold"] for x in xs] for f, xs in data.items() if len(xs) > 1
    }
    assert raw == want
    runs = motion.label_runs(labels, 3, 5, 2, chunk)
    smoothed = {f: plain.smooth(flags, 3, 5, 2) for f, flags in want.items()}
    assert by_file(runs.collect(), "first_i", "first_i", "last_i", "is_motion") == {
        f: plain.runs(flags) for f, flags in smoothed.items()
    }
    assert by_file(motion.smooth_labels(labels, chunk_rows=chunk).collect(), "i", "is_motion") == smoothed
    ratios = {r["file_id"]: r for r in motion.motion_ratio(runs).collect()}
    for f, flags in smoothed.items():
        assert ratios[f]["motion_labels"] == sum(flags) and ratios[f]["labels"] == len(flags)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_smoothing_of_random_labels(spark, chunk):
    rnd = random.Random(6)
    data = {f"f{c}": [rnd.random() < rnd.choice([0.2, 0.5, 0.8]) for _ in range(rnd.randint(1, 60))] for c in range(300)}
    for n, flags in enumerate(([True] * 3, [False] * 2, [True] * 2, [False], [False] * 5 + [True] * 3 + [False] * 4)):
        data[f"edge{n}"] = flags
    rows = [(f, i, m, 1.0) for f, flags in data.items() for i, m in enumerate(flags)]
    labels = spark.createDataFrame(rows, "file_id string, i long, is_motion boolean, energy double")
    runs = motion.label_runs(labels, 3, 5, 2, chunk)
    got = by_file(runs.collect(), "first_i", "first_i", "last_i", "is_motion")
    assert got == {f: plain.runs(plain.smooth(flags, 3, 5, 2)) for f, flags in data.items()}
    rows = by_file(motion.smooth_labels(labels, chunk_rows=chunk).collect(), "i", "is_motion")
    assert rows == {f: plain.smooth(flags, 3, 5, 2) for f, flags in data.items()}


def test_energy_equal_to_the_threshold_is_no_motion(spark):
    data = {"a": [1.0] * 30 + [1.5]}
    df = energies(spark, data)
    labels = motion.raw_labels(df, motion.noise_threshold(df))
    assert labels.where("is_motion").count() == 0


def test_label_times_of_the_whole_chain(spark):
    data = {"quiet": [1.0] * 40, "busy": [1.0, 30.0] * 20}
    files = spark.createDataFrame([("quiet", 100.0, 50.0), ("busy", 41.0, 0.0)], "file_id string, duration double, offset double")
    runs = motion.analyze(energies(spark, data), early_window=5, early_threshold=2.0, files=files, chunk_rows=8).collect()
    last = max((r for r in runs if r["file_id"] == "quiet"), key=lambda r: r["last_i"])
    assert last["last_i"] == 6 and last["end_time"] == 150.0  # 5 energies, one zero, one leading label
    last = max((r for r in runs if r["file_id"] == "busy"), key=lambda r: r["last_i"])
    assert last["last_i"] == 40 and last["end_time"] == pytest.approx(40.0)


def test_rates_and_strides(spark):
    df = spark.createDataFrame([(0.0, 25.0), (120.0, 25.0), (600.0, 0.0), (601.0, 29.97)], "d double, fps double")
    rows = df.select(motion.sampling_rate(F.col("d")).alias("r"), "fps").select("r", motion.frame_stride(F.col("fps"), F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [(5.0, 5), (5.0, 5), (2.0, 15), (1.0, 30)]


@pytest.mark.parametrize("chunk", [2, 65_536])
def test_a_null_key_is_refused(spark, chunk):
    rows = spark.createDataFrame([("a", 0), ("a", 1), (None, 0), (None, 1), (None, 2)], "file_id string, k long")
    ones = {"before": ("sum", F.lit(1))}
    with pytest.raises(Exception, match="NULL in its key"):
        running(rows, ["file_id"], ["k"], div(F.col("k"), chunk), ones).collect()
    last = spark.createDataFrame([("a", 1), (None, 2)], "file_id string, last_k long")
    assert attach(rows, last, ["file_id"], "k", F.col("last_k"), chunk).count() == 2


@pytest.mark.parametrize("size", [None, 0, -3, 2.5, True])
def test_chunks_need_a_whole_number_of_rows(spark, size):
    rows = spark.range(3).withColumn("file_id", F.lit("a"))
    with pytest.raises(ValueError):
        div(F.col("id"), size)
    with pytest.raises(ValueError):
        with_halo(rows, ["file_id"], "id", before=1, chunk_rows=size)
