"""Files: readings, scaler statistics, results, models, checkpoints."""

import json

import pytest
from pyspark.sql import functions as F

from sitecast.operators import models as MD
from sitecast.operators import scaling as SC
from sitecast.plans.evaluate import evaluate_files
from sitecast.schema import ENCODER, SITE, TARGET, TIME, WEATHER
from sitecast.sources import checkpoints, files

SCALER = {
    "1": {
        "AirTemperature": {"mean": 11.25, "std": 4.5},
        "SolarGeneration": {"mean": 2.75, "std": 3.125},
    },
    "2": {"AirTemperature": {"mean": 9.0, "std": 2.0625}},
}


def write_csv(path, rows):
    header = ["CampusKey", "ts", "note", *ENCODER]
    path.write_text("\n".join([",".join(header), *[",".join(map(str, r)) for r in rows]]) + "\n")
    return str(path)


def reading(site, minute, target):
    return [site, f"2024-01-01 00:{minute:02d}:00", "x", *range(1, 10), target]


def test_read_readings(spark, tmp_path):
    path = write_csv(tmp_path / "r.csv", [reading(1, 0, 2.5), reading(1, 15, ""), reading(2, 0, "NaN"), reading("", 0, 1)])
    df = files.read_readings(spark, path)
    assert df.columns == [SITE, "ts", *ENCODER]
    assert dict(df.dtypes)["ts"] == "timestamp_ntz"
    got = sorted(((r.campus_key, str(r.ts), r[TARGET]) for r in df.collect()), key=str)
    assert got == [(1, "2024-01-01 00:00:00", 2.5), (1, "2024-01-01 00:15:00", None), (2, "2024-01-01 00:00:00", None), (None, "2024-01-01 00:00:00", 1.0)]


def test_read_readings_names_absent_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text("CampusKey,ts\n1,2024-01-01 00:00:00\n")
    with pytest.raises(ValueError, match="AirTemperature"):
        files.read_readings(spark, str(tmp_path / "r.csv"))


def test_files_whose_headers_differ_do_not_swap_columns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("CampusKey,ts,A,B\n1,2024-01-01 00:00:00,1,2\n")
    (tmp_path / "in" / "b.csv").write_text("CampusKey,ts,B,A\n1,2024-01-01 00:15:00,2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_readings(spark, str(tmp_path / "in"), features=["A", "B"]).collect()
    (tmp_path / "in" / "b.csv").write_text("CampusKey,ts,A,B\n1,2024-01-01 00:15:00,3,4\n")
    got = files.read_readings(spark, str(tmp_path / "in"), features=["B", "A"]).collect()
    assert sorted((r.A, r.B) for r in got) == [(1.0, 2.0), (3.0, 4.0)]


def test_stats_roundtrip(spark, tmp_path):
    (tmp_path / "scale.txt").write_text(json.dumps(SCALER, indent=4))
    long = files.read_stats(spark, str(tmp_path / "scale.txt"))
    flat = {(r.campus_key, r.feature): (r["mean"], r["std"]) for r in long.collect()}
    want = {(s, f): (m["mean"], m["std"]) for s, fs in SCALER.items() for f, m in fs.items()}
    assert flat == want
    out = str(tmp_path / "out")
    files.write_stats(long, out)
    back = files.read_stats(spark, out, lines=True)
    assert {(r.campus_key, r.feature): (r["mean"], r["std"]) for r in back.collect()} == want


def test_wide_and_long_stats(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, None)], f"campus_key int, AirTemperature double, {TARGET} double")
    wide = SC.fit_stats(df, ["AirTemperature", TARGET])
    again = SC.stats_wide(SC.stats_long(wide, ["AirTemperature", TARGET]), ["AirTemperature", TARGET])
    assert wide.collect() == again.collect()
    assert wide.first().AirTemperature_std == pytest.approx(2**0.5)
    assert SC.fit_stats(df, ["AirTemperature"], ddof=0).first().AirTemperature_std == 1.0


def test_load_datasets(spark, tmp_path):
    path = write_csv(tmp_path / "v.csv", [reading(1, 0, 2.5), reading(3, 0, 2.5)])
    stats = spark.createDataFrame([("1", 0.5, 2.0)], f"campus_key string, {TARGET}_mean double, {TARGET}_std double")
    with pytest.warns(UserWarning, match="test"):
        df = files.load_datasets(spark, {"validation": path, "test": str(tmp_path / "no.csv")}, stats, cols=[TARGET])
    known = df.filter(F.col(TARGET).isNotNull())
    assert [(r.dataset, r.campus_key, r.row_idx, r[TARGET]) for r in known.collect()] == [("validation", 1, 0, 1.0)]
    assert df.count() == 1
    with pytest.raises(FileNotFoundError):
        files.load_datasets(spark, {"test": str(tmp_path / "no.csv")}, stats, required=["test"])
    with pytest.raises(FileNotFoundError):
        files.read_stats(spark, str(tmp_path / "no.txt"))
    other = stats.withColumn(SITE, F.lit("8"))
    with pytest.raises(ValueError, match="no rows"):
        files.load_datasets(spark, {"validation": path}, other, cols=[TARGET])


def test_results_are_kept_apart_by_dataset(spark, tmp_path):
    df = spark.createDataFrame([("validation", 1, 0.5), ("test", 1, 0.7)], "dataset string, campus_key int, rmse double")
    files.write_results(df, str(tmp_path / "res"))
    assert sorted(p.name for p in (tmp_path / "res").glob("dataset=*")) == ["dataset=test", "dataset=validation"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "res")).select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_models_are_reloaded_equal(spark, series, tmp_path):
    table = MD.fit_ar1(series)
    files.save_model(table, str(tmp_path / "ar1"))
    assert sorted(files.load_model(spark, str(tmp_path / "ar1")).collect()) == sorted(table.collect())
    df = series.withColumns({c: F.sin(F.col("row_idx") * (i + 1) / 9.0) for i, c in enumerate(TIME + WEATHER)})
    fitted = MD.fit_arx(MD.arx_rows(df))
    files.save_model(fitted, str(tmp_path / "arx"))
    assert MD.arx_weights(files.load_model(spark, str(tmp_path / "arx"))) == MD.arx_weights(fitted)
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, str(tmp_path / "none"))


def test_checkpoints_go_to_the_shared_folder(spark):
    wanted = spark.conf.get("spark.checkpoint.dir")
    assert wanted in checkpoints.checkpoint_dir(spark)
    stored = checkpoints.cut(spark.range(5))
    assert stored.count() == 5
    assert "Scan ExistingRDD" in stored._jdf.queryExecution().executedPlan().toString()


def test_evaluation_of_files(spark, tmp_path):
    """120 readings from six in the morning, a scaler file and a stored model to a report."""
    n = 120
    at = [(i + 24, "" if i == 100 else i % 5) for i in range(n)]
    rows = [[1, f"2024-01-0{1 + k // 96} {k % 96 // 4:02d}:{k % 4 * 15:02d}:00", "x", *range(1, 10), y] for k, y in at]
    path = write_csv(tmp_path / "v.csv", rows)
    (tmp_path / "scale.txt").write_text(json.dumps({"1": {TARGET: {"mean": 2.0, "std": 2.0}}}))
    model = spark.createDataFrame([(1, 0.1, 0.5)], "campus_key int, a double, b double")
    files.save_model(model, str(tmp_path / "m"))
    report = evaluate_files(spark, {"validation": path}, str(tmp_path / "scale.txt"), str(tmp_path / "m"), str(tmp_path / "out"))
    z = [None if i == 100 else (i % 5 - 2.0) / 2.0 for i in range(n)]
    errors = []
    for start in range(n - 115):
        value = z[start + 95] if z[start + 95] is not None else 0.0
        for k in range(20):
            value = 0.1 + 0.5 * value
            truth = z[start + 96 + k]
            if truth is not None:
                errors.append((max(value * 2 + 2, 0.0) - (truth * 2 + 2)) ** 2)
    overall = report.filter("scope = 'overall'").first()
    assert overall.n_valid == len(errors)
    assert overall.rmse == pytest.approx((sum(errors) / len(errors)) ** 0.5)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 21


def test_a_failed_save_leaves_the_best_model(spark, tmp_path):
    path = str(tmp_path / "best")
    tables = [spark.createDataFrame([(i, float(i))], "campus_key int, a double") for i in range(6)]
    files.save_model(tables[0], path)
    broken = tables[1].withColumn("a", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception):
        files.save_model(broken, path)
    assert files.load_model(spark, path).first().a == 0.0
    # A write that ends before the pointer moves counts as not done either.
    tables[2].write.parquet(f"{path}/v-halfway")
    (tmp_path / "best" / "notes.txt").write_text("mine")
    assert files.load_model(spark, path).first().a == 0.0
    for table in tables[1:]:
        files.save_model(table, path, keep=3)
    assert [files.load_model(spark, path, back).first().a for back in range(3)] == [5.0, 4.0, 3.0]
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, path, 3)
    kept = sorted(p.name for p in (tmp_path / "best").iterdir() if not p.name.endswith(".crc"))
    assert len([n for n in kept if n.startswith("v-")]) == 3 and "v-halfway" not in kept and "notes.txt" in kept


def test_models_without_versions_are_still_read(spark, tmp_path):
    table = spark.createDataFrame([(1, 0.5)], "campus_key int, a double")
    table.write.parquet(str(tmp_path / "old"))
    assert files.load_model(spark, str(tmp_path / "old")).collect() == table.collect()


def test_bad_rows_are_kept_apart_and_counted(spark, tmp_path):
    header = "note,CampusKey,ts,A,B"
    good = ["x,1,2024-01-01 00:00:00,1.5,2", "x,1.0,2024-01-01 00:15:00,NaN, ", "x,,,1,1", '"a,b",2,2024-01-01 00:00:00,-1e3,n/a']
    bad = {
        "x,1,2024-01-01 00:00:00,1": ["number of fields"],
        "x,1,2024-01-01 00:00:00,1,2,3": ["number of fields"],
        "x,1,2024-01-01 00:00:00,1,2,": ["number of fields"],
        "x,one,2024-01-01 00:00:00,1,2": ["CampusKey"],
        "x,1.5,2024-01-01 00:00:00,1,2": ["CampusKey"],
        "x,99999999999,2024-01-01 00:00:00,1,2": ["CampusKey"],
        "x,1,yesterday,1,2": ["ts"],
        "x,1,,1,2": ["ts"],
        "x,1,2024-01-01 00:00:00,1 kW,about": ["A", "B"],
    }
    (tmp_path / "r.csv").write_text("\n".join([header, *good, *bad]) + "\n")
    found = files.read_checked(spark, str(tmp_path / "r.csv"), features=["B", "A"])
    rows = sorted(((r[SITE], str(r.ts), r.A, r.B) for r in found.readings.collect()), key=str)
    assert rows == [
        (1, "2024-01-01 00:00:00", 1.5, 2.0),
        (1, "2024-01-01 00:15:00", None, None),
        (2, "2024-01-01 00:00:00", -1000.0, None),
        (None, "None", 1.0, 1.0),
    ]
    rejects = {r.line: sorted(r.reasons) for r in found.rejects.collect()}
    assert rejects == bad and all(r.file.endswith("r.csv") for r in found.rejects.collect())
    assert found.counts == {"lines": 13, "rejected": 9, "without_site": 1, "missing_B": 2, "missing_A": 1}
    (tmp_path / "r.csv").write_text(header + "\n")
    empty = files.read_checked(spark, str(tmp_path / "r.csv"), features=["A"])
    assert empty.readings.count() == empty.rejects.count() == empty.counts["lines"] == 0


def test_load_reports_what_each_file_lost(spark, tmp_path, monkeypatch):
    rows = [reading(1, 0, 2.5), reading(3, 0, 2.5), reading(3, 15, 1.0), reading("", 0, 1), reading(1, 15, "much")]
    path = write_csv(tmp_path / "v.csv", rows)
    stats = spark.createDataFrame([("1", 0.5, 2.0)], f"campus_key string, {TARGET}_mean double, {TARGET}_std double")
    report = {}
    with pytest.warns(UserWarning, match="1 of 5 rows"):
        df = files.load_datasets(spark, {"validation": path}, stats, cols=[TARGET], report=report)
    got = report["validation"]
    assert (got["lines"], got["rejected"], got["without_site"]) == (5, 1, 1)
    assert (got["unknown_sites"], got["unknown_site_rows"], got[f"missing_{TARGET}"]) == (1, 2, 0)
    assert [r.reasons for r in got["rejects"].collect()] == [[TARGET]]
    # What follows reads the stored rows: the file itself is read in one pass only.
    assert "csv" not in df._jdf.queryExecution().executedPlan().toString().lower()
    assert [r[TARGET] for r in df.collect()] == [1.0]
