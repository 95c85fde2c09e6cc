"""Staged refinement: forecast, mix the forecasts into the inputs, refit, score, repeat."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.operators.chunks import attach_by_site
from sitecast.operators.forecast import (
    autoregressive,
    build_cache,
    join_cache,
    scheduled_mix,
    usage_rate,
)
from sitecast.operators.metrics import batch_mean_rmse
from sitecast.operators.models import regression
from sitecast.operators.sequences import (
    cells,
    number_samples,
    samples,
    sequence_counts,
    series_offsets,
    with_batch,
)
from sitecast.schema import SITE, TARGET
from sitecast.sources import versions
from sitecast.sources.buckets import bucket_count, forget, read_bucketed, write_bucketed
from sitecast.sources.checkpoints import checkpoint_dir
from sitecast.sources.files import save_model


def ar_error(sample: DataFrame) -> float | None:
    """Batch-mean error of the autoregressive forecast of numbered samples with `a` and `b`."""
    cell = cells(with_batch(sample)).withColumn("yhat", autoregressive())
    return batch_mean_rmse(cell).first()["yhat"]


PLACE = [SITE, "start_idx"]


def _prepare(series: DataFrame, state: str) -> None:
    """Stores the samples of both data sets, those for training in buckets, and the first model."""
    spark = series.sparkSession

    def write(folder: str) -> dict:
        lean = series.select("dataset", SITE, "row_idx", "n_rows", TARGET, "a", "b")
        lean.write.parquet(f"{folder}/series")
        read = spark.read.parquet(f"{folder}/series")
        train, validation = (
            read.filter(F.col("dataset") == name).drop("dataset", "a", "b") for name in ("train", "validation")
        )
        offsets = series_offsets(sequence_counts(validation))
        number_samples(samples(validation), offsets).write.parquet(f"{folder}/held")
        n_rows = sequence_counts(train).agg(F.sum("n_sequences")).first()[0] or 0
        buckets = bucket_count(spark, n_rows)
        dealt = samples(train).repartition(buckets, *PLACE)
        write_bucketed(dealt, f"{folder}/sample", PLACE, buckets)
        first = read.groupBy(SITE).agg(F.first("a").alias("a"), F.first("b").alias("b"))
        first.write.parquet(f"{folder}/model")
        return {"buckets": buckets}

    versions.commit(spark, f"{state}/inputs", write, keep=1)


def refine(
    series: DataFrame,
    epochs: int = 10,
    patience: int = 3,
    seed: str = "mix",
    mode: str = "reference",
    save_to: str | None = None,
    state: str | None = None,
) -> DataFrame:
    """Refit the site models on inputs that hold more and more of their own forecasts.

    `series` holds the scaled data sets `train` and `validation` with the first `a` and `b`
    of every site. The samples of both are built and stored once. Each epoch stores the
    forecasts of the training samples as a cache that takes the place of the one before, mixes
    them into the inputs, refits, and scores the validation samples; the driver sees one error
    per epoch. Returns the history; the model with the smallest error goes to `save_to`.

    `state` names a folder that keeps the samples, and after each epoch its model together with
    the history so far. A call that finds such a folder goes on after the last whole epoch, and
    reads its samples instead of `series`; the settings must be the same. Without `state` the
    files go to the shared folder and are removed at the end.
    """
    spark = series.sparkSession
    own = state is None
    state = state or f"{checkpoint_dir(spark)}/refine-{uuid.uuid4().hex}"
    settings = {"epochs": epochs, "patience": patience, "seed": seed, "mode": mode}
    found = versions.manifest(spark, f"{state}/epochs")
    notes = found["notes"] if found else {"settings": settings, "history": []}
    if notes["settings"] != settings:
        raise ValueError(f"{state} was begun with {notes['settings']}")
    if versions.current(spark, f"{state}/inputs") is None:
        _prepare(series, state)
    inputs = versions.current(spark, f"{state}/inputs")
    buckets = versions.manifest(spark, f"{state}/inputs")["notes"]["buckets"]
    held = spark.read.parquet(f"{inputs}/held")
    sample = read_bucketed(spark, f"{inputs}/sample", PLACE, buckets)
    model = spark.read.parquet(versions.current(spark, f"{state}/epochs") or f"{inputs}/model")
    models = spark.read.schema(model.schema)
    history = [tuple(h) for h in notes["history"]]

    def waited() -> int:
        return len(history) - 1 - max((i for i, h in enumerate(history) if h[-1]), default=-1)

    while len(history) < epochs and waited() < patience:
        epoch = len(history)
        best = history[-1][3] if history else None
        made = build_cache(attach_by_site(sample, model))
        folder = versions.commit(
            spark, f"{state}/cache", lambda path, made=made: write_bucketed(made, path, PLACE, buckets), keep=1
        )
        # Samples and cache lie by the same buckets, so the join moves neither.
        cache = read_bucketed(spark, folder, PLACE, buckets, made.schema)
        mixed = scheduled_mix(cells(join_cache(sample, cache)), epoch, epochs, seed, mode)
        fitted = mixed.groupBy(SITE).agg(*regression("y", "mixed")).select(SITE, "a", "b")

        def write(folder: str, fitted=fitted, epoch=epoch, best=best) -> dict:
            fitted.write.parquet(folder)
            stored = models.parquet(folder)
            error = ar_error(attach_by_site(held, stored))
            better = error is not None and (best is None or error < best)
            if better and save_to:
                save_model(stored, save_to)
            history.append((epoch, usage_rate(epoch, epochs), error, error if better else best, better))
            return {"settings": settings, "history": history}

        model = models.parquet(versions.commit(spark, f"{state}/epochs", write, keep=1))
        forget(cache)
    forget(sample)
    if own:
        versions.remove(spark, state)
    return spark.createDataFrame(
        history, "epoch int, rate double, ar_rmse double, best double, improved boolean"
    )
