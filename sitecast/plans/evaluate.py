"""The evaluation job: forecast every window of every data set and score it."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.functions import values as V
from sitecast.operators.chunks import attach_by_site
from sitecast.operators.forecast import autoregressive
from sitecast.operators.metrics import evaluation_scores
from sitecast.operators.models import attach_model, fit_scaled_ar1, model_columns
from sitecast.operators.scaling import stats_wide
from sitecast.operators.sequences import cells, samples, split_by_time
from sitecast.schema import SITE, TARGET
from sitecast.sources.files import load_datasets, load_model, read_stats, write_results

# Consecutive shares of every series, out of 100.
SHARES = {"train": (0, 70), "validation": (70, 85), "test": (85, 100)}


def in_train() -> Column:
    return F.col("row_idx") < F.expr(f"n_rows * {SHARES['train'][1]} div 100")


def with_site_models(series: DataFrame) -> DataFrame:
    """Scaled target beside the site's statistics and AR(1) coefficients, both fitted on the
    training rows of the series itself."""
    lean = series.select(SITE, "row_idx", "n_rows", TARGET)
    return attach_model(lean, fit_scaled_ar1(lean, train=in_train()))


def in_kilowatts(cell: DataFrame) -> DataFrame:
    """Scaled `y` and `yhat` back to kW, the forecast clipped at 0 and the truth left alone."""
    mean, std = F.col(f"{TARGET}_mean"), F.col(f"{TARGET}_std")
    return cell.withColumns(
        {
            "y": V.undo_zscore(F.col("y"), mean, std),
            "yhat": V.clip_nonneg(V.undo_zscore(F.col("yhat"), mean, std)),
        }
    )


def forecast_cells(modelled: DataFrame) -> DataFrame:
    """Autoregressive forecasts beside the truth, in kW, for every window of every `dataset`."""
    cell = cells(samples(modelled, keep=model_columns(), keys=("dataset", SITE)))
    return in_kilowatts(cell.withColumn("yhat", autoregressive())).select(
        "dataset", SITE, "start_idx", "step", "y", "yhat"
    )


def forecast_truth(series: DataFrame) -> DataFrame:
    """The same for a single series table: models from its training share, windows from all."""
    return forecast_cells(split_by_time(with_site_models(series), SHARES, 100))


def evaluate(series: DataFrame) -> DataFrame:
    """Overall and per-step RMSE and R2 per data set."""
    return evaluation_scores(forecast_truth(series))


def evaluate_files(
    spark: SparkSession, paths: dict[str, str], stats_path: str, model_path: str, out: str, **columns
) -> DataFrame:
    """Evaluation from files: readings CSVs by data set name, scaler JSON, coefficient table.

    Data sets whose file is absent are skipped with a warning. The report is stored and
    returned as stored.
    """
    stats = stats_wide(read_stats(spark, stats_path))
    scaled = load_datasets(spark, paths, stats, **columns)
    target = stats.select(SITE, f"{TARGET}_mean", f"{TARGET}_std")
    known = attach_by_site(scaled.select("dataset", SITE, "row_idx", "n_rows", TARGET), target)
    model = load_model(spark, model_path).select(SITE, "a", "b")
    write_results(evaluation_scores(forecast_cells(attach_by_site(known, model))), out)
    return spark.read.parquet(out)
