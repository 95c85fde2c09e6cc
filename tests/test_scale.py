"""What a task holds must not grow with the input, and samples are not moved whole."""

import pytest
from pyspark.sql import functions as F

from sitecast.operators import grid as G
from sitecast.operators import sequences as SQ
from sitecast.schema import BATCH, SITE, TARGET, TIME, WEATHER
from sitecast.sources import shards


def test_empty_grid_is_unfolded_by_as_many_tasks_as_the_session_sets(spark):
    slots = spark.createDataFrame([(1, 0, 1.0), (1, 40 * 960 - 1, 2.0)], f"{SITE} int, slot bigint, {TARGET} double")
    bounds = G.site_bounds(slots)
    full = G.complete_grid(slots, bounds, {TARGET: F.avg(TARGET)})
    assert full.count() == 40 * 960
    # Merged by size, 40 blocks of some bytes would all be unfolded in one task.
    plan = full._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "block" in x]
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert dealt and all("REPARTITION_BY_NUM" in x and f", {tasks})" in x for x in dealt)


@pytest.fixture(scope="module")
def readings(series):
    return series.withColumns({c: F.sin(F.col("row_idx") * (i + 1) / 9.0) for i, c in enumerate([*TIME, *WEATHER])})


def test_samples_are_slices_of_packed_chunks(spark, readings, plain):
    packed = SQ.packed_sequences(readings, width=160).cache()
    assert packed.count() == 3  # of 186 samples
    out = SQ.unfold_sequences(packed, keep=["chunk_id"])
    # Nothing is worked out again for every sample.
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    rows = out.collect()
    assert len(rows) == 186
    for r in rows:
        y = plain[r[SITE]][r["start_idx"] : r["start_idx"] + 116]
        assert [s[-1] for s in r["src"]] == [v or 0.0 for v in y[:96]]
        assert [t[-1] for t in r["tgt_in"]] == [v or 0.0 for v in y[95:115]]
        assert r["tgt_out"] == [-999.0 if v is None else v for v in y[96:]]
        assert [*r["src_mask"], *r["tgt_mask"]] == [v is None for v in y]


def test_packed_rows_are_cut_at_the_bounds_of_files(spark, readings, series, tmp_path):
    offsets = SQ.series_offsets(SQ.sequence_counts(series))
    whole = SQ.with_batch(SQ.number_samples(SQ.export_sequences(readings), offsets))
    packed = SQ.packed_sequences(readings)
    packed = SQ.number_samples(packed.withColumn("start_idx", F.col("lo")), offsets).drop("start_idx")
    unfold = lambda rows: SQ.unfold_sequences(rows, keep=["offset"])
    shards.write_packed_shards(packed, unfold, str(tmp_path / "out"), batches_per_file=2)
    found = shards.read_places(spark, str(tmp_path / "out"))
    assert found.filter("sample_id - first_sample != place").count() == 0
    listed = shards.read_manifest(spark, str(tmp_path / "out")).collect()
    assert sorted(r["batch_id"] for r in listed) == list(range(-(-186 // BATCH))) and len({r["file"] for r in listed}) > 1
    columns = whole.columns
    got = sorted(found.select(*columns).collect(), key=lambda r: r["sample_id"])
    assert got == sorted(whole.collect(), key=lambda r: r["sample_id"])
    shards.write_packed_shards(packed.limit(0), unfold, str(tmp_path / "none"))
    assert shards.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_manifest_is_never_sent_to_every_task(spark, tmp_path):
    """Nor unfolded to a row per sample. Batches of any length are found, over blocks of rows too."""
    sizes = [5, 40, 1, 70, BATCH, 3, 2 * BATCH]
    rows = [(b, i) for i, b in enumerate(b for b, n in enumerate(sizes) for _ in range(n))]
    sample = spark.createDataFrame(rows, "batch_id bigint, sample_id bigint")
    shards.write_shards(sample, str(tmp_path / "out"), batches_per_file=4)
    found = shards.read_places(spark, str(tmp_path / "out"))
    got = sorted(tuple(r) for r in found.select("batch_id", "sample_id", "place", "first_sample", "last_sample").collect())
    first = [sum(sizes[:b]) for b in range(len(sizes))]
    assert got == [(b, i, i - first[b], first[b], first[b] + sizes[b] - 1) for b, i in rows]
    assert len({r["file"] for r in found.select("file").collect()}) > 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "posexplode" not in plan
