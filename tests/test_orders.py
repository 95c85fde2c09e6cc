"""Epoch orders and exported batches."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sitecast.operators import orders as ORD
from sitecast.operators import sequences as SQ
from sitecast.schema import TIME, WEATHER
from sitecast.sources import shards


def plain(number, size, of, keys):
    bits = size.bit_length() - 1
    h, low, p = 1 << bits, 1 << ((bits + 1) // 2), ORD.PRIME
    for i, rounds in enumerate(keys):
        start = size - h if i % 2 else 0
        if not start <= number < start + h:
            continue
        a, b = divmod(number - start, low)
        for j, (m, mul, c) in enumerate(rounds):
            mixed = (((b, a)[j % 2] + of * m) % p * mul + c) % p
            mixed = mixed * mixed % p >> 9
            if j % 2:
                b ^= mixed & (low - 1)
            else:
                a ^= mixed & (h // low - 1)
        number = start + a * low + b
    return number


@pytest.mark.parametrize("total, block", [(1, 4), (3, 4), (4, 4), (64, 8), (1000, 64), (1023, 1), (997, 2000), (5000, 4096)])
def test_positions_are_a_permutation_that_can_be_undone(spark, total, block):
    order = ORD.EpochOrder(total, "s", 2, block)
    ids = spark.range(total).withColumnRenamed("id", "sample_id")
    df = order.with_sample(order.with_position(ids), name="back")
    got = {r["sample_id"]: (r["position"], r["back"]) for r in df.collect()}
    assert sorted(at for at, _ in got.values()) == list(range(total))
    assert all(back == i for i, (_, back) in got.items())
    for i, (at, _) in list(got.items())[:: max(1, total // 50)]:
        b, full = i // block, total // block
        moved = plain(b, full, 0, order.outer) if b < full else b
        size = block if b < full else total - full * block
        assert at == moved * block + plain(i % block, size, b, order.inner)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    nothing = order.with_position(spark.createDataFrame([(None,)], "sample_id bigint"))
    assert nothing.first()["position"] is None


def test_epochs_differ_and_neighbours_part(spark):
    ids = spark.range(4096).withColumnRenamed("id", "sample_id")
    places = []
    for epoch in (0, 1, 0):
        rows = ORD.EpochOrder(4096, "s", epoch, 256).with_position(ids).collect()
        places.append([r["position"] for r in sorted(rows)])
    assert places[0] == places[2] != places[1]
    apart = sum(abs(a - b) == 1 for a, b in zip(places[0], places[0][1:]))
    fixed = sum(i == at for i, at in enumerate(places[0]))
    assert apart < 100 and fixed < 30
    # Inside a block every place is about as likely for the first half as for the second.
    half = sum(at % 256 < 128 for at in places[0][:128])
    assert 30 < half < 98


@pytest.fixture(scope="module")
def exported(series):
    df = series.withColumns({c: F.sin(F.col("row_idx") * (i + 1) / 9.0) for i, c in enumerate([*TIME, *WEATHER])})
    sample = SQ.export_sequences(df)
    offsets = SQ.series_offsets(SQ.sequence_counts(series))
    return SQ.with_batch(SQ.number_samples(sample, offsets), 8).cache()


def test_batches_are_found_through_the_manifest(spark, exported, tmp_path):
    folder = shards.write_shards(exported, str(tmp_path / "out"), batches_per_file=5)
    want = {}
    for r in exported.collect():
        want.setdefault(r["batch_id"], []).append(r)
    listed = {r["batch_id"]: r for r in shards.read_manifest(spark, str(tmp_path / "out")).collect()}
    assert set(listed) == set(want) and len({r["file"] for r in listed.values()}) > 3
    for batch, rows in want.items():
        rows.sort(key=lambda r: r["sample_id"])
        place = listed[batch]
        assert (place["n_rows"], place["first_sample"], place["last_sample"]) == (len(rows), rows[0]["sample_id"], rows[-1]["sample_id"])
        # As an outside loader would: the file, and the rows from the place on.
        table = pq.read_table(f"{folder}/{shards.DATA}/{place['file']}", columns=["sample_id", "tgt_out"])
        part = table.slice(place["first_row"], place["n_rows"]).to_pylist()
        assert [p["sample_id"] for p in part] == [r["sample_id"] for r in rows]
        assert [p["tgt_out"] for p in part] == [r["tgt_out"] for r in rows]
    some = shards.read_batch(spark, str(tmp_path / "out"), 3)
    assert sorted(r["sample_id"] for r in some.collect()) == [r["sample_id"] for r in want[3]]
    assert shards.read_batch(spark, str(tmp_path / "out"), 10_000).count() == 0
    again = shards.read_places(spark, str(tmp_path / "out"))
    assert again.filter("sample_id - first_sample != place").count() == 0 and again.count() == exported.count()


def test_shards_of_nothing(spark, exported, tmp_path):
    shards.write_shards(exported.limit(0), str(tmp_path / "none"))
    assert shards.read_manifest(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        shards.read_manifest(spark, str(tmp_path / "other"))
