"""Chunked against whole, closed form against loop, pooled model against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitecast.operators import forecast as FC
from sitecast.operators import metrics as M
from sitecast.operators import models as MD
from sitecast.operators import scaling as SC
from sitecast.operators import segments as SG
from sitecast.operators import sequences as SQ
from sitecast.operators import sites as ST
from sitecast.plans.refine import refine
from sitecast.schema import ENCODER, TARGET, TIME, WEATHER

WHOLE = 10_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def featured(series):
    """The series with made-up but distinct values in the other features."""
    cols = [c for c in ENCODER if c != TARGET]
    return series.withColumns(
        {
            c: F.when((F.col("row_idx") + i) % 7 != 0, F.sin(F.col("row_idx") * (i + 1) / 10.0))
            for i, c in enumerate(cols)
        }
    )


def test_samples_do_not_depend_on_the_chunk(series):
    cells = lambda width: SQ.cells(SQ.samples(series, width=width)).select("campus_key", "start_idx", "step", "y", "prev")
    small = rows(cells(48))
    assert small == rows(cells(WHOLE)) and len(small) == (185 + 1) * 20


def test_sequence_index_does_not_depend_on_the_chunk(series):
    index = lambda width: SQ.sequence_index(series.withColumn("ts", F.col("row_idx")), width=width)
    assert rows(index(120)) == rows(index(WHOLE))


def test_samples_against_a_loop(series, plain):
    got = {(r.campus_key, r.start_idx): r for r in SQ.samples(series, width=64).collect()}
    want = [(s, i) for s, ys in plain.items() for i in range(len(ys) - 115)]
    assert sorted(got) == want
    for (site, start), r in got.items():
        ys = plain[site]
        assert [c.y for c in r.ahead] == ys[start + 96 : start + 116]
        assert r.seed == (ys[start + 95] or 0.0)


@pytest.mark.parametrize("width", [96, 192])
def test_window_summary_against_a_loop(series, width):
    df = featured(series)
    table = {(r.campus_key, r.row_idx): r for r in df.collect()}
    got = SQ.encoder_summary(df, width=width).collect()
    assert len(got) == (300 - 95) + (116 - 95) + (115 - 95)
    for r in got:
        for c in ENCODER:
            raw = [table[(r.campus_key, i)][c] for i in range(r.row_idx - 95, r.row_idx + 1)]
            seen = [0.0 if v is None else v for v in raw]
            assert r[f"{c}_avg"] == pytest.approx(sum(seen) / 96)
            assert (r[f"{c}_min"], r[f"{c}_max"], r[f"{c}_last"]) == (min(seen), max(seen), seen[-1])
            assert r[f"{c}_valid"] == sum(v is not None for v in raw)


def test_export_does_not_depend_on_the_chunk(series):
    df = featured(series)
    small, whole = (SQ.export_sequences(df, width=w) for w in (120, WHOLE))
    assert rows(small) == rows(whole)
    assert small.count() == 186
    assert small.filter((F.size("src") != 96) | (F.size("tgt_in") != 20)).isEmpty()


@pytest.mark.parametrize("mode", ["reference", "run"])
def test_segments_do_not_depend_on_the_chunk(series, mode):
    out = lambda w: SG.continuous_segments(series, 3, mode, width=w)
    assert rows(out(16)) == rows(out(WHOLE))
    assert out(16).filter(F.col("in_segment") & F.col(TARGET).isNull()).isEmpty()


def test_gap_ordinals_against_a_loop(series, plain):
    for r in SG.gap_ordinals(SG.gap_samples(series, width=40)).collect():
        ahead = plain[r.campus_key][r.start_idx + 96 : r.start_idx + 116]
        assert r.gap_count == sum(y is None for y in ahead)
        want = sum(y is None for y in ahead[: r.step + 1]) if ahead[r.step] is None else None
        assert r.ordinal == want


def test_round_by_round_gap_fill(series):
    """The single pass gives what K rounds of guided passes over the batch give."""
    a, b = 0.7, -0.4
    df = series.withColumns({"a": F.lit(a), "b": F.lit(b)})
    sample = SG.gap_samples(df, keep=["a", "b"])
    offsets = SQ.series_offsets(SQ.sequence_counts(series))
    sample = SG.with_rounds(SQ.with_batch(SQ.number_samples(sample, offsets), 32))
    batches = {}
    for r in FC.fill_gaps_reference(sample).collect():
        batches.setdefault(r.batch_id, {}).setdefault(r.sample_id, {})[r.step] = r
    assert len(batches) == 6
    for samples in batches.values():
        most = max(sum(c.y is None for c in steps.values()) for steps in samples.values())
        for steps in samples.values():
            work = [steps[j].prev for j in range(20)]
            for k in range(most - 1):
                out = [a + b * x for x in work]
                gone = [j for j in range(20) if steps[j].y is None]
                if k < len(gone):
                    work[gone[k]] = out[gone[k]]
            assert [steps[j].filled for j in range(20)] == pytest.approx(work)


def test_aligned_gap_fill_against_a_loop(series, plain):
    a, b = 0.7, -0.4
    df = series.withColumns({"a": F.lit(a), "b": F.lit(b)})
    got = {(r.campus_key, r.start_idx, r.step): r.filled for r in FC.fill_gaps_aligned(FC.aligned_samples(df, keep=["a", "b"], width=50)).collect()}
    for (site, start, step), value in got.items():
        ys, last = plain[site], plain[site][start + 95] or 0.0
        for j in range(step + 1):
            y = ys[start + 96 + j]
            last = a + b * last if y is None else y
        assert value == pytest.approx(last)


def test_blend_segments_stay_inside_the_sample(series, plain):
    from tests.test_rules import slow_segments

    m = 5
    sample = SQ.samples(series, extra=["run_end"], derive=lambda f, w: SG.mark_run_ends(f, w, m), before=SG.run_reach(m), width=30)
    flag = SG.in_segment(F.col("y"), F.col("run_end"), F.col("start_idx") + 96, m)
    for r in SQ.cells(sample, ["run_end"]).withColumn("f", flag).collect():
        valid = [y is not None for y in plain[r.campus_key][r.start_idx + 96 : r.start_idx + 116]]
        assert r.f == slow_segments(valid, m)[r.step]


@pytest.mark.parametrize("b", [0.5, -0.9, 1.0, 0.0])
def test_closed_form_equals_rolling(spark, b):
    df = spark.range(20).select(F.col("id").cast("int").alias("step"), F.lit(0.3).alias("a"), F.lit(b).alias("b"), F.lit(2.0).alias("seed"))
    args = [F.col(c) for c in ("a", "b", "seed", "step")]
    rolled = F.aggregate(F.sequence(F.lit(0), F.col("step")), F.col("seed"), lambda acc, _: F.col("a") + F.col("b") * acc)
    for r in df.select(MD.closed_ar1(*args).alias("c"), rolled.alias("r")).collect():
        assert r.c == pytest.approx(r.r)


def test_one_pass_fit_equals_fit_on_scaled(series):
    stats = SC.fit_stats(series, [TARGET])
    two = {r.campus_key: r for r in MD.fit_ar1(SC.scale_by_site(series, stats, [TARGET])).collect()}
    for r in MD.fit_scaled_ar1(series).collect():
        assert (r.a, r.b, r.n_pairs) == (pytest.approx(two[r.campus_key].a), pytest.approx(two[r.campus_key].b), two[r.campus_key].n_pairs)


def test_one_pass_fit_of_a_flat_and_an_empty_site(spark):
    data = [(1, i, 5, 4.0) for i in range(5)] + [(2, i, 5, None) for i in range(5)]
    df = spark.createDataFrame(data, f"campus_key int, row_idx bigint, n_rows bigint, {TARGET} double")
    got = {r.campus_key: (r.a, r.b) for r in MD.fit_scaled_ar1(df).collect()}
    assert got == {1: (4.0, 0.0), 2: (0.0, 0.0)}


def with_inputs(series):
    """Time features as sines, weather as cosines of the row number; one row in seven without."""
    time = {c: F.sin(F.col("row_idx") * (i + 1) / 9.0) for i, c in enumerate(TIME)}
    seen = F.col("row_idx") % 7 != 3
    weather = {c: F.when(seen, F.cos(F.col("row_idx") * F.col("row_idx") * (i + 1) / 31.0)) for i, c in enumerate(WEATHER)}
    return series.withColumns(time | weather)


def weather_levels(first, last):
    """Means of the weather over the rows `first` .. `last` - 1, missing = 0."""
    return [sum(np.cos(t * t * (i + 1) / 31.0) for t in range(first, last) if t % 7 != 3) / 96 for i in range(len(WEATHER))]


def test_arx_rollout_against_a_loop(series, plain):
    """The pooled model's roll-out, step by step, with given weights."""
    weights = dict(intercept=0.2, prev=0.6, window_avg=0.3, window_share=-0.5, **{c: 0.1 * (i + 1) for i, c in enumerate(TIME)})
    weights |= {f"{c}_level": 0.7 - i for i, c in enumerate(WEATHER)}
    df = with_inputs(series)
    out = MD.arx_forecast(df, weights).collect()
    assert len(out) == 186 * 20
    for r in out[::37]:
        ys = plain[r.campus_key]
        back = ys[r.start_idx : r.start_idx + 96]
        level = 0.2 + 0.3 * sum(y or 0.0 for y in back) / 96 - 0.5 * sum(y is not None for y in back) / 96
        level += sum((0.7 - i) * v for i, v in enumerate(weather_levels(r.start_idx, r.start_idx + 96)))
        value = back[-1] or 0.0
        for k in range(r.step + 1):
            t = r.start_idx + 96 + k
            value = level + 0.6 * value + sum(0.1 * (i + 1) * np.sin(t * (i + 1) / 9.0) for i in range(4))
        assert r.yhat == pytest.approx(value)
        assert r.y == ys[r.start_idx + 96 + r.step]


def test_arx_fit_against_least_squares(series, plain):
    weights = MD.arx_weights(MD.fit_arx(MD.arx_rows(with_inputs(series))))
    x, y = [], []
    for ys in plain.values():
        for t in range(96, len(ys)):
            if ys[t] is not None:
                back = ys[t - 96 : t]
                x.append([1.0, back[-1] or 0.0, *[np.sin(t * (i + 1) / 9.0) for i in range(4)], *weather_levels(t - 96, t),
                          sum(v or 0.0 for v in back) / 96, sum(v is not None for v in back) / 96])
                y.append(ys[t])
    want = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0]
    assert list(weights.values()) == pytest.approx(list(want), rel=1e-5, abs=1e-6)


def test_direct_models_against_numpy(series):
    cell = SQ.cells(SQ.samples(series.filter("campus_key = 1")))
    lines = {r.step: r for r in MD.fit_direct(cell).collect()}
    data = {}
    for r in cell.collect():
        if r.y is not None:
            data.setdefault(r.step, []).append((r.seed, r.y))
    assert sorted(lines) == list(range(20))
    for step, pairs in data.items():
        slope, level = np.polyfit(*zip(*pairs), 1)
        assert (lines[step].a, lines[step].b) == (pytest.approx(level), pytest.approx(slope))


def test_cross_site_scores_against_pairs(series, plain):
    df = series.withColumn("city", F.lit(7))
    got = {r.campus_key: r for r in ST.cross_site_scores(df).collect()}
    pairs = {s: [(x, y) for x, y in zip(ys, ys[1:]) if x is not None and y is not None] for s, ys in plain.items()}
    for site, own in pairs.items():
        b, a = np.polyfit(*zip(*own), 1)
        other = np.array([p for s, ps in pairs.items() if s != site for p in ps])
        err = other[:, 1] - (a + b * other[:, 0])
        r2 = 1 - (err**2).sum() / ((other[:, 1] - other[:, 1].mean()) ** 2).sum()
        assert got[site].cross_rmse == pytest.approx(np.sqrt((err**2).mean()))
        assert got[site].cross_r2 == pytest.approx(r2)
        assert got[site].n_cross == len(other)
    best = max(got.values(), key=lambda r: r.cross_r2).campus_key
    assert [r.campus_key for r in ST.choose_sites(ST.cross_site_scores(df)).collect()] == [best]


def test_refinement_keeps_the_best_model(spark, series, tmp_path):
    from sitecast.sources.files import load_model

    data = series.filter("campus_key = 1").withColumns({"a": F.lit(1.0), "b": F.lit(0.8)})
    both = data.withColumn("dataset", F.explode(F.array(F.lit("train"), F.lit("validation"))))
    path = str(tmp_path / "best")
    out = refine(both, epochs=3, save_to=path).collect()
    assert [r.epoch for r in out] == [0, 1, 2] and out[0].improved
    assert [r.best for r in out] == [min(q.ar_rmse for q in out[: i + 1]) for i in range(3)]
    model = load_model(spark, path).first()
    cell = SQ.cells(SQ.samples(data.withColumns({"a": F.lit(model.a), "b": F.lit(model.b)}), keep=["a", "b"]))
    numbered = SQ.with_batch(cell.withColumn("sample_id", F.col("start_idx")))
    again = M.batch_mean_rmse(FC.forecast_ar(numbered)).first().yhat
    assert again == pytest.approx(out[-1].best)


@pytest.fixture
def two_sets(series):
    data = series.filter("campus_key = 1").withColumns({"a": F.lit(1.0), "b": F.lit(0.8)})
    return data.withColumn("dataset", F.explode(F.array(F.lit("train"), F.lit("validation"))))


def test_refinement_goes_on_where_it_stopped(spark, two_sets, tmp_path, monkeypatch):
    from sitecast.plans import refine as R
    from sitecast.sources.files import load_model

    whole = refine(two_sets, epochs=5, patience=5, save_to=str(tmp_path / "a")).collect()
    score, calls = R.ar_error, []

    def lost(sample):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the driver is gone")
        return score(sample)

    state, best = str(tmp_path / "state"), str(tmp_path / "b")
    monkeypatch.setattr(R, "ar_error", lost)
    with pytest.raises(RuntimeError):
        refine(two_sets, epochs=5, patience=5, save_to=best, state=state)
    again = refine(two_sets.limit(0), epochs=5, patience=5, save_to=best, state=state).collect()
    assert again == whole and len(calls) == 6  # epochs 0, 1, the lost 2, then 2, 3, 4
    assert load_model(spark, best).collect() == load_model(spark, str(tmp_path / "a")).collect()
    assert refine(two_sets, epochs=5, patience=5, state=state).collect() == whole and len(calls) == 6
    with pytest.raises(ValueError):
        refine(two_sets, epochs=6, patience=5, state=state)


def test_refinement_keeps_only_the_last_state(spark, two_sets, tmp_path):
    import glob
    import os

    state, shared = str(tmp_path / "state"), spark.sparkContext.getCheckpointDir()
    refine(two_sets, epochs=3, state=state)
    for part in ("inputs", "cache", "epochs"):
        assert len(glob.glob(f"{state}/{part}/v-*")) == 1
    refine(two_sets, epochs=2)
    assert not glob.glob(os.path.join(shared.removeprefix("file:"), "refine-*"))
