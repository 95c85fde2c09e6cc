"""The rules of the data model on hand-made rows."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sitecast.functions import clock
from sitecast.functions import values as V
from sitecast.functions.draws import bucket, uniform
from sitecast.operators import forecast as FC
from sitecast.operators import grid as G
from sitecast.operators import metrics as M
from sitecast.operators import scaling as SC
from sitecast.operators import segments as SG
from sitecast.operators import sequences as SQ
from sitecast.operators import sites as ST
from sitecast.operators.chunks import attach_by_site, running
from sitecast.plans import prepare
from sitecast.schema import TARGET, WEATHER


def frame(spark, values, site=1):
    rows = [(site, i, len(values), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"campus_key int, row_idx bigint, n_rows bigint, {TARGET} double")


def test_unknown_and_null_sites_drop_out_of_scaling(spark):
    df = spark.createDataFrame(
        [(1, 4.0), (2, 4.0), (None, 4.0)], f"campus_key int, {TARGET} double"
    )
    stats = spark.createDataFrame([("1", 2.0, 4.0)], f"campus_key string, {TARGET}_mean double, {TARGET}_std double")
    assert SC.scale_by_site(df, stats, [TARGET]).collect() == [Row(campus_key=1, SolarGeneration=0.5)]


def test_two_kinds_of_zero(spark):
    """Missing weather is raw 0 before scaling; a missing target stays missing."""
    cols = [WEATHER[0], TARGET]
    df = spark.createDataFrame([(1, None, None)], f"campus_key int, {cols[0]} double, {TARGET} double")
    stats = spark.createDataFrame(
        [("1", 10.0, 5.0, 3.0, 2.0)],
        f"campus_key string, {cols[0]}_mean double, {cols[0]}_std double, {TARGET}_mean double, {TARGET}_std double",
    )
    out = SC.scale_by_site(df, stats, cols).first()
    assert (out[cols[0]], out[TARGET]) == (-2.0, None)


def test_zscore_leaves_flat_or_absent_features_raw(spark):
    df = spark.createDataFrame([(7.0, 5.0, 1e-9), (7.0, None, None), (7.0, 5.0, 2.0)], "x double, m double, s double")
    got = [r[0] for r in df.select(V.zscore(F.col("x"), F.col("m"), F.col("s"))).collect()]
    assert got == [7.0, 7.0, 1.0]


def test_unscale_defaults_and_clip(spark):
    df = spark.createDataFrame([(1, -2.0), (9, -2.0), (9, None)], "campus_key int, yhat double")
    stats = spark.createDataFrame([(1, 10.0, 3.0)], f"campus_key int, {TARGET}_mean double, {TARGET}_std double")
    raw = SC.unscale(df, stats, "yhat")
    got = raw.select("campus_key", V.clip_nonneg(F.col("yhat")).alias("y")).collect()
    assert sorted((r.campus_key, r.y) for r in got if r.y is not None) == [(1, 4.0), (9, 0.0)]
    assert [r.campus_key for r in got if r.y is None] == [9]


def test_unscale_undoes_scale(spark):
    df = spark.createDataFrame([(1, 3.25), (1, -8.0)], f"campus_key int, {TARGET} double")
    stats = spark.createDataFrame([(1, 10.0, 3.0)], f"campus_key int, {TARGET}_mean double, {TARGET}_std double")
    back = SC.unscale(SC.scale_by_site(df, stats, [TARGET]), stats, TARGET)
    assert sorted(r[TARGET] for r in back.collect()) == pytest.approx([-8.0, 3.25])


def test_missing_spellings(spark):
    df = spark.createDataFrame([("1.5",), ("",), (" NaN",), ("n/a",), ("NULL",), ("-nan",), (None,)], "t string")
    got = [r[0] for r in df.select(V.parse_number(F.col("t"))).collect()]
    assert got == [1.5] + [None] * 6


def test_sentinel_roundtrip(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "y double")
    coded = V.to_sentinel(F.col("y"), -10.0)
    got = df.select(coded.alias("c"), V.from_sentinel(coded, -10.0).alias("d")).collect()
    assert got == [Row(c=1.0, d=1.0), Row(c=-10.0, d=None)]


def test_sequence_counts(spark):
    df = spark.createDataFrame([(1, 115), (2, 116), (3, 117), (4, 5)], "campus_key int, n_rows bigint")
    got = {r.campus_key: r.n_sequences for r in SQ.sequence_counts(df).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0}


def test_numbering_follows_site_order_with_gaps_in_the_keys(spark):
    counts = spark.createDataFrame([(70000, 4), (3, 2), (5, 0), (900, 7)], "campus_key int, n_sequences bigint")
    got = {r.campus_key: r.offset for r in SQ.series_offsets(counts).collect()}
    assert got == {3: 0, 5: 2, 900: 2, 70000: 9}


@pytest.mark.parametrize("hole", [95, 96, 115])
def test_seed_shift_and_export_around_a_missing_row(spark, hole):
    from sitecast.schema import TIME

    values = [float(i) for i in range(116)]
    values[hole] = None
    df = frame(spark, values)
    sample = SQ.samples(df).first()
    assert sample.seed == (0.0 if hole == 95 else 95.0)
    cells = sorted(SQ.cells(SQ.samples(df)).collect(), key=lambda r: r.step)
    assert [c.prev for c in cells] == [0.0 if j == hole else float(j) for j in range(95, 115)]
    assert [c.y for c in cells] == values[96:]
    for c in [*WEATHER, *TIME]:
        df = df.withColumn(c, F.lit(None).cast("double"))
    out = SQ.export_sequences(df).first()
    assert out.tgt_out == [-999.0 if v is None else v for v in values[96:]]
    assert [r[4] for r in out.tgt_in] == [c.prev for c in cells]
    assert out.tgt_in[0][0] is None
    assert [r[9] for r in out.src] == [0.0 if v is None else v for v in values[:96]]
    assert out.src_mask == [v is None for v in values[:96]]
    assert out.tgt_mask == [v is None for v in values[96:]]


PATTERN = "1111101111100110"


def slow_segments(valid, m):
    """Loop form: mark m rows forward from every row that closes a run of m."""
    marked = [False] * len(valid)
    for i in range(len(valid)):
        if i >= m - 1 and all(valid[i - m + 1 : i + 1]):
            for j in range(i, min(i + m, len(valid))):
                marked[j] = True
    return [a and b for a, b in zip(marked, valid)]


@pytest.mark.parametrize("m", [3, 5])
@pytest.mark.parametrize("width", [16, 8])
def test_segments_reference(spark, m, width):
    valid = [c == "1" for c in PATTERN]
    df = frame(spark, [1.0 if v else None for v in valid])
    out = SG.continuous_segments(df, m, width=width).orderBy("row_idx").collect()
    assert [r.in_segment for r in out] == slow_segments(valid, m)


def test_segments_run(spark):
    df = frame(spark, [1.0 if c == "1" else None for c in PATTERN])
    out = SG.continuous_segments(df, 3, mode="run", width=4).orderBy("row_idx").collect()
    assert "".join("x" if r.in_segment else "." for r in out) == "xxxxx.xxxxx....."


def test_gap_fill_modes(spark):
    """y0 - - y3 - : reference writes a missing output onto the input of the same step."""
    horizon = 5
    rows = [10.0] * 96 + [1.0, None, None, 4.0, None]
    df = frame(spark, rows).withColumns({"a": F.lit(1.0), "b": F.lit(0.5)})
    sample = SG.gap_samples(df, keep=["a", "b"], horizon=horizon)
    assert sample.first().gap_count == 3
    ranked = sample.withColumn("rounds", F.col("gap_count"))
    ref = sorted(FC.fill_gaps_reference(ranked).collect(), key=lambda r: r.step)
    assert [r.ordinal for r in ref] == [None, 1, 2, None, 3]
    # inputs 10, 1, 0, 0, 4; gaps 1 and 2 are filled from their own inputs, the third never
    assert [r.filled for r in ref] == [10.0, 1.5, 1.0, 0.0, 4.0]
    ali = sorted(FC.fill_gaps_aligned(FC.aligned_samples(df, keep=["a", "b"], horizon=horizon)).collect(), key=lambda r: r.step)
    assert [r.filled for r in ali] == [1.0, 1.5, 1.75, 4.0, 3.0]


def test_hybrid_is_guided_first(spark):
    df = spark.createDataFrame(
        [(k, 0.3, 0.9, 2.0, float(k)) for k in range(20)], "step int, a double, b double, seed double, prev double"
    )
    out = df.select("step", FC.guided().alias("g"), FC.autoregressive().alias("r"), FC.hybrid(5).alias("h")).collect()
    assert all(r.h == (r.g if r.step < 5 else r.r) for r in out)


def test_mix_rates_and_modes(spark):
    assert [FC.usage_rate(e, 10) for e in (0, 1, 9)] == pytest.approx([0.1, 0.2, 1.0])
    cached = [float(100 + k) for k in range(4)]
    rows = [(1, 0, k, y, float(k), pm, cached) for k, (y, pm) in enumerate([(None, False), (1.0, True), (None, False), (2.0, True)])]
    df = spark.createDataFrame(
        rows, "campus_key int, start_idx bigint, step int, y double, prev double, prev_missing boolean, cached array<double>"
    )
    full = sorted(FC.scheduled_mix(df, 9, 10, "x").collect(), key=lambda r: r.step)
    assert [r.mixed for r in full] == cached
    shifted = sorted(FC.scheduled_mix(df, 9, 10, "x", "aligned").collect(), key=lambda r: r.step)
    assert [r.mixed for r in shifted] == [0.0, 100.0, 101.0, 102.0]
    low = sorted(FC.scheduled_mix(df, 0, 10, "x").collect(), key=lambda r: r.step)
    assert low[0].taken and low[2].taken


def test_cache_skips_unknown_samples(spark):
    sample = spark.createDataFrame([(1, 0), (1, 1)], "campus_key int, start_idx bigint")
    cache = spark.createDataFrame([(1, 1, [5.0])], "campus_key int, start_idx bigint, cached array<double>")
    assert [r.start_idx for r in FC.join_cache(sample, cache).collect()] == [1]


@pytest.mark.parametrize(
    "cells, r2",
    [
        ([(2.0, 2.0), (2.0, 2.0)], 1.0),
        ([(2.0, 2.0), (2.0, 3.0)], 0.0),
        ([(2.0, 2.0)], None),
        ([(None, 2.0)], None),
        ([(1.0, 1.0), (3.0, 2.0), (None, 9.0)], 0.5),
    ],
)
def test_r2_edges(spark, cells, r2):
    df = spark.createDataFrame([("d", 0, y, p) for y, p in cells], "dataset string, step int, y double, yhat double")
    assert M.scores(df, ["dataset"]).first().r2 == r2
    both = {r.scope: r for r in M.evaluation_scores(df).collect()}
    assert both["overall"].r2 == r2 and both["step"].r2 == r2
    if cells[0][0] is None:
        assert both["overall"].rmse is None and both["overall"].n_valid == 0


def test_batch_means_and_losses(spark):
    """65 samples in batches of 32, 32 and 1; the middle batch has no truth."""
    rows = [(i, None if 32 <= i < 64 else 0.0, 3.0 if i < 32 else 1.0) for i in range(65)]
    df = SQ.with_batch(spark.createDataFrame(rows, "sample_id bigint, y double, yhat double"))
    out = M.batch_mean_rmse(df).first()
    assert (out.n_batches, out.yhat) == (3, pytest.approx(4 / 3))
    batches = df.groupBy("batch_id").agg(F.avg(F.pow(F.col("yhat") - F.col("y"), F.lit(2.0))).alias("loss"))
    loss = M.epoch_loss(batches).first()
    assert (loss.n_defined, loss.loss_lenient, loss.loss_strict) == (2, pytest.approx(10 / 3), None)


def test_blended_loss(spark):
    rows = [(0, 0.0, 1.0, False), (0, 0.0, 3.0, True), (1, 0.0, 2.0, False), (2, None, 2.0, False)]
    df = spark.createDataFrame(rows, "batch_id int, y double, yhat double, in_segment boolean")
    got = {r.batch_id: r.loss for r in M.blended_loss(df, 20).collect()}
    assert got == {0: pytest.approx(5 * 0.5 + 9 * 0.5), 1: 4.0, 2: 0.0}
    assert [M.blend_weight(e) for e in (0, 1, 9, 30)] == pytest.approx([0.0, 0.05, 0.45, 0.5])


def test_metric_stall(spark):
    history = [5.0, 4.0, 4.0, None, 6.0, 3.0]
    df = spark.createDataFrame([(1, e, v) for e, v in enumerate(history)], "campus_key int, epoch bigint, rmse double")
    out = M.metric_stall(df, 3).orderBy("epoch").collect()
    assert [r.improved for r in out] == [True, True, False, False, False, True]
    assert [r.best for r in out] == [5.0, 4.0, 4.0, 4.0, 4.0, 3.0]
    assert [r.epochs_since_best for r in out] == [0, 0, 1, 2, 3, 0]
    assert [r.stopped for r in out] == [False] * 4 + [True] * 2


def test_night_gaps_only(spark):
    df = spark.createDataFrame([(None, 95.0), (None, 50.0), (2.0, 95.0)], f"{TARGET} double, z double")
    assert [r[TARGET] for r in SC.fill_night(df, F.col("z")).collect()] == [0.0, None, 2.0]


def test_grid_averages_completes_and_keeps_bounds(spark):
    rows = [(1, "2024-03-10 02:01:00", 1.0), (1, "2024-03-10 02:14:59", 3.0), (1, "2024-03-11 00:00:00", 7.0), (None, "2024-03-10 02:01:00", 9.0)]
    df = spark.createDataFrame(rows, "campus_key int, t string, SolarGeneration double").select(
        "campus_key", F.col("t").cast("timestamp_ntz").alias("ts"), TARGET
    )
    out = G.to_grid(df, [TARGET]).collect()
    assert len(out) == 89 and {r.n_rows for r in out} == {89}
    known = {(r.row_idx, str(r.ts)): r[TARGET] for r in out if r[TARGET] is not None}
    assert known == {(0, "2024-03-10 02:00:00"): 2.0, (88, "2024-03-11 00:00:00"): 7.0}
    slots = df.filter("campus_key is not null").select("campus_key", clock.slot_floor(clock.micros(F.col("ts"))).alias("slot"))
    assert [r.n_rows for r in G.site_bounds(slots, align=96).collect()] == [192]
    gone = df.withColumn("ts", F.when(F.col(TARGET) < 5, F.col("ts")))
    with pytest.raises(Exception, match="no timestamp"):
        G.to_grid(gone, [TARGET]).collect()
    day = [F.lit(d).cast("timestamp_ntz") for d in ("2024-03-10", "2024-03-11")]
    sites = df.filter("campus_key is not null")
    fixed = G.to_grid(df, [TARGET], G.fixed_bounds(sites, *day)).collect()
    assert len(fixed) == 96 and sum(r[TARGET] is not None for r in fixed) == 1


def test_asof_takes_latest_known_update(spark):
    grid = spark.createDataFrame([(1, i, 4) for i in range(4)], "campus_key int, row_idx bigint, n_rows bigint")
    grid = grid.withColumn("ts", clock.slot_start(F.col("row_idx") + 100))
    at = lambda slot, extra: (100 + slot) * 900_000_000 + extra
    updates = spark.createDataFrame(
        [(1, at(-300, 5), 1, 7.0), (1, at(1, 0), 2, 1.0), (1, at(1, 0), 3, 2.0), (1, at(2, 1), 4, 3.0), (2, at(0, 0), 5, 9.0)],
        "campus_key int, us bigint, tie int, g double",
    )
    out = G.asof_hourly(grid, updates, ["g"]).orderBy("row_idx").collect()
    assert [r.g for r in out] == [7.0, 2.0, 2.0, 3.0]
    age = G.asof_hourly(grid, updates, ["g"]).select("row_idx", G.minutes_since(F.col("ts"), F.col("g_us")).alias("m"))
    assert [r.m for r in age.orderBy("row_idx").collect()][1:] == [0.0, 15.0, 14.0]


def test_moments_ignore_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS ts, timestamp_ntz'1969-12-31 23:59:59' AS old")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = df.select(clock.micros(F.col("ts")).alias("a"), clock.micros(F.col("old")).alias("b")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (got.a, got.b) == (1710037800123456, -1_000_000)


def test_sun_is_high_at_noon_and_below_the_horizon_at_midnight(spark):
    df = spark.sql("SELECT 1 AS campus_key, explode(array(timestamp_ntz'2024-03-20 12:00:00', timestamp_ntz'2024-03-20 00:00:00')) AS ts")
    sites = spark.createDataFrame([(1, 0.0, 0.0)], "campus_key int, lat double, lon double")
    noon, night = prepare.sun_angles(df, sites).orderBy(F.col("ts").desc()).collect()
    assert noon.zenith < 3 and night.zenith > 177


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20000).withColumn("u", uniform("k", F.col("id")))
    first = df.agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert 0.49 < first[0] < 0.51 and first[1] >= 0 and first[2] < 1
    again = df.repartition(7).agg(F.min("u"), F.max("u")).first()
    assert (first[1], first[2]) == (again[0], again[1])
    shares = {r.b: r["count"] for r in df.groupBy(bucket(F.col("u"), {"x": 3, "y": 1}).alias("b")).count().collect()}
    assert math.isclose(shares["x"] / 20000, 0.75, abs_tol=0.02)


def test_split_windows_do_not_leak(spark):
    df = spark.range(3000).select(F.lit(1).alias("campus_key"), F.col("id").alias("start_idx"))
    out = SQ.split_windows(df, {"train": 1, "test": 1}, "s").collect()
    rows = {}
    for r in out:
        if r.split != "purged":
            for i in range(r.start_idx, r.start_idx + 116):
                assert rows.setdefault(i, r.split) == r.split
    assert {r.split for r in out} == {"train", "test", "purged"}


def test_window_sample_is_bounded_and_complete(spark):
    df = spark.createDataFrame([("a", 1, i) for i in range(80)] + [("b", 1, i) for i in range(9)], "dataset string, campus_key int, start_idx bigint")
    out = SQ.sample_windows(df, 50, "s").collect()
    assert sorted((d, sum(r.dataset == d for r in out)) for d in "ab") == [("a", 50), ("b", 9)]
    assert len({(r.dataset, r.start_idx) for r in out}) == 59


def test_many_picks_find_the_same_rows(spark, monkeypatch):
    df = frame(spark, [float(i) for i in range(300)]).withColumn("dataset", F.lit("d"))
    keys = ("dataset", "campus_key")
    picks = SQ.sample_windows(SQ.sample_keys(df, keys=keys), 4, "s").cache()
    few = SQ.picked_rows(df, picks, keys=keys)
    monkeypatch.setattr(SQ, "MAX_SENT_PICKS", 3)
    many = SQ.picked_rows(df, picks, keys=keys)
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (few, many)]
    assert "strategy=broadcast" in plans[0] and "strategy=merge" in plans[1]
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() > 116
    sample = SQ.samples(many, keys=keys)
    assert SQ.with_picks(sample, picks, keys).count() == 4


def test_running_folds_on_sparse_rows(spark):
    values = {0: 3.0, 7: None, 8: 2.0, 40: 5.0, 41: None, 300: 1.0}
    df = spark.createDataFrame([(1, i, v) for i, v in values.items()], "campus_key int, row_idx bigint, v double")
    out = running(df, {"l": ("v", "last"), "m": ("v", "min"), "x": ("v", "max"), "s": ("v", "sum")}, width=4, levels=2)
    got = [(r.row_idx, r.l, r.m, r.x, r.s) for r in out.orderBy("row_idx").collect()]
    assert got == [
        (0, 3.0, 3.0, 3.0, 3.0), (7, 3.0, 3.0, 3.0, 3.0), (8, 2.0, 2.0, 3.0, 5.0),
        (40, 5.0, 2.0, 5.0, 10.0), (41, 5.0, 2.0, 5.0, 10.0), (300, 1.0, 1.0, 5.0, 11.0),
    ]


def test_site_lookup_survives_without_broadcast(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("campus_key"), "id")
    sites = spark.createDataFrame([("0", 1.0), ("2", 3.0)], "campus_key string, v double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
        assert attach_by_site(df, sites).count() == 667
        assert attach_by_site(df, sites, how="left").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_a_hot_slot_and_a_hot_site(spark):
    """A third of all readings in one slot of one site, far from the rest."""
    n = 30_000
    ids = spark.range(n)
    at = F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 96)
    df = ids.select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(1 + F.col("id") % 50).cast("int").alias("campus_key"),
        clock.slot_start(at).alias("ts"),
        F.col("id").cast("double").alias(TARGET),
    )
    out = G.to_grid(df, [TARGET]).cache()
    hot = out.filter("campus_key = 1").orderBy(F.desc("row_idx")).first()
    first = min(i % 96 for i in range(0, n, 50) if i % 3)
    assert hot.n_rows == hot.row_idx + 1 == 501 - first
    assert hot[TARGET] == pytest.approx(sum(range(0, n, 3)) / (n / 3))
    assert out.filter("campus_key = 1").count() == hot.n_rows
    others = out.filter("campus_key <> 1").groupBy("campus_key").agg(F.max("n_rows").alias("n")).collect()
    assert len(others) == 49 and all(80 < r.n <= 96 for r in others)
    wide = SQ.samples(out, width=120)
    assert wide.count() == hot.n_rows - 115


def test_cross_scores_keep_their_digits_on_series_that_hardly_vary(spark):
    """Against regr_r2-like sums in numpy about exact means, for both scopes."""
    import numpy as np

    rng = np.random.default_rng(5)
    data = {(c, s): 19.9999 + 1e-6 * rng.standard_normal(80) for c, s in ((1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6))}
    rows = [(c, s, i, float(v)) for (c, s), y in data.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, f"city int, campus_key int, row_idx bigint, {TARGET} double")

    def score(a, b, chosen):
        y = np.concatenate([data[k][1:] for k in chosen]) - 19.9999
        x = np.concatenate([data[k][:-1] for k in chosen]) - 19.9999
        left = ((y - a - b * x) ** 2).sum()
        return 1 - left / ((y - y.mean()) ** 2).sum(), (left / len(y)) ** 0.5

    for scope in ("within", "across"):
        for r in ST.cross_site_scores(df, scope=scope).collect():
            me = (r.city, r.campus_key)
            others = [k for k in data if (k[0] == r.city and k != me if scope == "within" else k[0] != r.city)]
            x, y = data[me][:-1] - 19.9999, data[me][1:] - 19.9999
            b = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
            a = y.mean() - b * x.mean()
            assert r.own_r2 == pytest.approx(score(a, b, [me])[0], abs=1e-6)
            assert r.n_cross == 79 * len(others)
            if others:
                r2, rmse = score(a, b, others)
                assert r.cross_r2 == pytest.approx(r2, abs=1e-5)
                assert r.cross_rmse == pytest.approx(rmse, rel=1e-5)


def test_reading_order_is_restored(spark):
    df = spark.createDataFrame([(2, 0), (1, 10), (1, 9), (2, 1)], "campus_key int, row_idx bigint").repartition(4)
    assert [tuple(r) for r in SC.ordered(df).collect()] == [(1, 9), (1, 10), (2, 0), (2, 1)]
