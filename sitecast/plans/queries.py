"""The registered queries: each applies one operator to the readings of a data directory."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.functions import values as V
from sitecast.operators import forecast as FC
from sitecast.operators import joint as J
from sitecast.operators import metrics as M
from sitecast.operators import models as MD
from sitecast.operators import moments as MO
from sitecast.operators import orders as ORD
from sitecast.operators import scaling as SC
from sitecast.operators import segments as SG
from sitecast.operators import sequences as SQ
from sitecast.operators import sites as ST
from sitecast.operators import trees as TR
from sitecast.operators.chunks import attach_by_site
from sitecast.plans import evaluate as EV
from sitecast.plans import prepare, proxy
from sitecast.plans.refine import refine
from sitecast.schema import ENCODER, HORIZON, LOOKBACK, SENTINEL, SITE, TARGET, TIME, WEATHER
from sitecast.sources import shards
from sitecast.sources import states as day_store
from sitecast.sources.checked import read_checked
from sitecast.sources.checkpoints import checkpoint_dir, cut
from sitecast.sources.files import clean_readings, format_stats, parse_stats

DIGITS = 6
SEED = "s1"
WEIGHTS = {"train": 0.7, "validation": 0.15, "test": 0.15}
DATASET_KEYS = ("dataset", SITE)
MIX_EPOCH, MIX_EPOCHS, REFINE_EPOCHS, REFINE_PATIENCE = 4, 10, 10, 3
BLEND_EPOCH, SEGMENT = 4, 5
PATIENCE = 3
PICKS = 50
NEW_DAYS = 5

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def num(col: str | Column, name: str | None = None) -> Column:
    """Round once, at the output; adding 0 turns -0 into 0."""
    name = name or col
    col = F.col(col) if isinstance(col, str) else col
    return (F.round(col, DIGITS) + F.lit(0.0)).alias(name)


# ---- shared inputs ---------------------------------------------------------------------


def modelled_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled target series with the columns of the site's model."""
    return EV.with_site_models(proxy.target_series(spark, sf_dir))


def site_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SQ.samples(modelled_target(spark, sf_dir), keep=["a", "b"])


def site_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SQ.cells(site_samples(spark, sf_dir))


def numbered(sample: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their running number and batch (per data set, where there are several)."""
    lengths = proxy.lengths(spark, sf_dir)
    within = [c for c in ("dataset",) if c in sample.columns]
    if within:
        lengths = SQ.split_lengths(lengths, EV.SHARES, 100)
    offsets = SQ.series_offsets(SQ.sequence_counts(lengths, keys=[*within, SITE]), within)
    return SQ.with_batch(SQ.number_samples(sample, offsets, within))


def scaled_readings_of(full: DataFrame) -> DataFrame:
    return SC.scale_by_site(full, SC.fit_stats(full.filter(EV.in_train())))


def dataset_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered cells of all data sets (scaled), with the site's coefficients."""
    series = SQ.split_by_time(modelled_target(spark, sf_dir), EV.SHARES, 100)
    sample = SQ.samples(series, keep=["a", "b"], keys=DATASET_KEYS)
    return SQ.cells(numbered(sample, spark, sf_dir))


# ---- sources ---------------------------------------------------------------------------


@query
def readings_clean(spark, sf_dir):
    """Text readings with several spellings of missing."""
    ev = proxy.events(spark, sf_dir)
    text = (
        F.when(F.col("event_type") == "error", "NaN")
        .when(F.col("event_type") == "signup", "")
        .otherwise(F.col("value").cast("string"))
    )
    raw = ev.select(
        "event_id",
        F.col(SITE).cast("string").alias("CampusKey"),
        F.col("ts").cast("string").alias("ts"),
        text.alias(TARGET),
        F.when(F.col("event_type") == "view", F.col("k").cast("string")).otherwise("n/a").alias("AirTemperature"),
        F.col("event_id").cast("string").alias("RelativeHumidity"),
    )
    clean = clean_readings(raw, features=[TARGET, "AirTemperature", "RelativeHumidity"])
    return clean.select(
        F.col("RelativeHumidity").cast("bigint").alias("event_id"), SITE, "ts", TARGET, "AirTemperature"
    )


@query
def readings_rejected(spark, sf_dir):
    """Rows of a readings file that cannot be read, with the reasons, beside the rest.

    The file is written from the events: some lines are cut short, some are too long, some
    hold text where numbers belong.
    """
    ev = proxy.events(spark, sf_dir)
    kind = F.col("event_type")
    cells = F.concat_ws(
        ",",
        "event_id",
        F.when(kind == "error", F.concat(F.lit("site"), F.col(SITE).cast("string"))).otherwise(F.col(SITE).cast("string")),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
    )
    rest = (
        F.when(kind == "signup", "")
        .when(kind == "purchase", F.concat_ws(",", F.lit(""), F.col("k").cast("int"), F.lit("1"), F.lit("2")))
        .otherwise(F.concat(F.lit(","), F.when(kind == "error", "about 5").otherwise(F.col("k").cast("int").cast("string"))))
    )
    path = f"{checkpoint_dir(spark)}/readings-{uuid.uuid4().hex}"
    # The lines as they are, below a header line in every file.
    lines = ev.select(F.concat(cells, rest).alias(f"event_id,CampusKey,ts,{TARGET}"))
    plain = {"header": True, "quote": "", "escapeQuotes": False, "sep": "\u0001"}
    lines.write.options(**plain).csv(path)
    found = read_checked(spark, path, features=["event_id", TARGET])
    good = found.readings.select(F.col("event_id").cast("bigint").alias("event_id"), F.lit("").alias("reasons"), num(TARGET))
    bad = found.rejects.select(
        F.split("line", ",")[0].cast("bigint").alias("event_id"),
        F.array_join("reasons", ";").alias("reasons"),
        F.lit(None).cast("double").alias(TARGET),
    )
    return good.unionByName(bad)


@query
def stats_table(spark, sf_dir):
    """Fitted statistics through the scaler file's text form and back."""
    full = proxy.with_weather(spark, sf_dir)
    stats = SC.stats_long(SC.fit_stats(full.filter(EV.in_train())))
    return parse_stats(format_stats(stats)).select(SITE, "feature", num("mean"), num("std"))


@query
def sequence_export(spark, sf_dir):
    """Whole exported samples, reported as sizes and checksums per sample."""
    packed = SQ.packed_sequences(scaled_readings_of(proxy.readings(spark, sf_dir)))
    out = SQ.unfold_sequences(packed, keep=["chunk_id"])
    # One row per row of a sample; a chunk's samples lie together, so nothing moves for the sums.
    arrays = F.arrays_zip("src", "src_mask", "tgt_in", "tgt_out", "tgt_mask")
    rows = out.select(SITE, "chunk_id", "start_idx", F.posexplode(arrays).alias("k", "row"))
    place = F.col("k") + 1

    def total(x: Column) -> Column:
        """Values weighted by their place, so that rows out of order give another sum."""
        return F.sum(x * place)

    def masked(mask: str) -> Column:
        return F.sum(F.when(F.col(f"row.{mask}"), place).otherwise(0)).cast("int").alias(f"{mask}ed")

    sums = rows.groupBy(SITE, "chunk_id", "start_idx").agg(
        F.count("row.src").cast("int").alias("n_src"),
        F.count("row.tgt_out").cast("int").alias("n_tgt"),
        *[num(total(F.get("row.src", F.lit(i))), f"src_{c}") for i, c in enumerate(ENCODER)],
        num(total(F.get("row.tgt_in", F.lit(len(TIME)))), "tgt_in_prev"),
        num(total(F.col("row.tgt_out")), "tgt_out_sum"),
        masked("src_mask"),
        masked("tgt_mask"),
    )
    return sums.drop("chunk_id")


# ---- projections and missing values ----------------------------------------------------


@query
def feature_vectors(spark, sf_dir):
    vec = SC.feature_vectors(proxy.readings(spark, sf_dir))
    return vec.select(
        SITE,
        "row_idx",
        *[num(F.col("encoder")[i], f"enc_{i}") for i in range(10)],
        *[num(F.col("decoder")[i], f"dec_{i}") for i in range(5)],
    )


@query
def scaled_readings(spark, sf_dir):
    out = scaled_readings_of(proxy.readings(spark, sf_dir))
    return out.select(SITE, "row_idx", *[num(c) for c in ENCODER])


@query
def weather_filled(spark, sf_dir):
    out = SC.fill_weather(proxy.with_weather(spark, sf_dir))
    return out.select(SITE, "row_idx", *[num(c) for c in WEATHER], num(TARGET))


@query
def unscaled_forecast(spark, sf_dir):
    """Guided forecast of every row in kW, clipped at 0; every fifth site counts as unknown."""
    lagged = MD.with_lag(modelled_target(spark, sf_dir))
    prev = F.coalesce(F.col("before"), F.lit(0.0))
    rows = lagged.withColumn("yhat", F.col("a") + F.col("b") * prev)
    # The statistics come with the model, one row per site.
    stats = rows.filter((F.col("row_idx") == 0) & (F.col(SITE) % 5 != 0))
    raw = SC.unscale(rows.select(SITE, "row_idx", "yhat"), stats, "yhat")
    return raw.select(SITE, "row_idx", num(V.clip_nonneg(F.col("yhat")), "yhat"))


@query
def missing_mask_profile(spark, sf_dir):
    """How often each site's rows are masked, as look-back and as horizon rows."""
    index = SQ.sequence_index(proxy.target_series(spark, sf_dir))
    return index.groupBy(SITE).agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum("n_src_missing").alias("src_masked"),
        F.sum("n_tgt_missing").alias("tgt_masked"),
        F.sum((F.col("n_tgt_missing") == 20).cast("int")).cast("bigint").alias("no_truth"),
    )


@query
def sentinel_roundtrip(spark, sf_dir):
    y = F.col(TARGET)
    coded = V.to_sentinel(y, SENTINEL)
    return proxy.target_series(spark, sf_dir).select(
        SITE, "row_idx", num(coded, "coded"), num(V.from_sentinel(coded, SENTINEL), "decoded")
    )


@query
def night_filled(spark, sf_dir):
    grid = proxy.target_series(spark, sf_dir)
    lit_up = prepare.sun_angles(grid, proxy.places(proxy.events(spark, sf_dir)))
    return SC.fill_night(lit_up, F.col("zenith")).select(SITE, "row_idx", num(TARGET))


# ---- joins -----------------------------------------------------------------------------


@query
def asof_weather(spark, sf_dir):
    out = proxy.with_weather(spark, sf_dir)
    return out.select(SITE, "row_idx", "ts", num("Ghi_hourly"), num("CloudOpacity_hourly"))


@query
def minutes_since_update(spark, sf_dir):
    return proxy.with_weather(spark, sf_dir).select(SITE, "row_idx", "minutes_since_last_update")


@query
def decoder_inputs(spark, sf_dir):
    out = SQ.decoder_inputs(scaled_readings_of(proxy.readings(spark, sf_dir)))
    return out.select(SITE, "row_idx", *[num(c) for c in TIME], num("prev"))


@query
def forecast_truth(spark, sf_dir):
    out = EV.forecast_truth(proxy.target_series(spark, sf_dir))
    return out.select("dataset", SITE, "start_idx", "step", num("y"), num("yhat"))


def _site_scores(spark, sf_dir, scope="within"):
    series = SC.rescale_power(proxy.supplier_series(spark, sf_dir))
    cities = attach_by_site(series, proxy.supplier_cities(spark, sf_dir))
    return ST.cross_site_scores(cities, scope=scope)


def _scores_of(out):
    floats = ["a", "b", "own_rmse", "own_r2", "cross_rmse", "cross_r2"]
    return out.select("city", SITE, "n_sites", "n_cross", *[num(c) for c in floats])


@query
def cross_site_scores(spark, sf_dir):
    return _scores_of(_site_scores(spark, sf_dir))


@query
def cross_city_scores(spark, sf_dir):
    """Every site's model on the data of all other cities."""
    return _scores_of(_site_scores(spark, sf_dir, "across"))


@query
def champion_sites(spark, sf_dir):
    out = ST.choose_sites(_site_scores(spark, sf_dir))
    return out.select("city", SITE, num("cross_r2"), num("cross_rmse"))


# ---- sequences -------------------------------------------------------------------------


@query
def sequence_index(spark, sf_dir):
    return SQ.sequence_index(proxy.target_series(spark, sf_dir))


@query
def sequence_counts(spark, sf_dir):
    counts = SQ.sequence_counts(proxy.lengths(spark, sf_dir))
    return counts.rollup(SITE).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_sequences").alias("n_sequences")
    )


@query
def sample_numbering(spark, sf_dir):
    index = SQ.sample_keys(proxy.target_series(spark, sf_dir))
    return numbered(index, spark, sf_dir).select(SITE, "start_idx", "sample_id")


@query
def batch_sizes(spark, sf_dir):
    index = SQ.sample_keys(proxy.target_series(spark, sf_dir))
    return numbered(index, spark, sf_dir).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_samples"))


@query
def encoder_window_summary(spark, sf_dir):
    out = SQ.encoder_summary(scaled_readings_of(proxy.readings(spark, sf_dir)))
    counts = [f"{c}_valid" for c in ENCODER]
    floats = [f"{c}_{s}" for c in ENCODER for s in ("avg", "min", "max", "last")]
    return out.select(SITE, "row_idx", *[num(c) for c in floats], *counts)


@query
def segments_reference(spark, sf_dir):
    out = SG.continuous_segments(proxy.target_series(spark, sf_dir), m=3)
    return out.select(SITE, "row_idx", "in_segment")


@query
def segments_run(spark, sf_dir):
    out = SG.continuous_segments(proxy.target_series(spark, sf_dir), m=3, mode="run")
    return out.select(SITE, "row_idx", "in_segment")


@query
def gap_ordinals(spark, sf_dir):
    out = SG.gap_ordinals(SG.gap_samples(proxy.target_series(spark, sf_dir)))
    gaps = out.filter(F.col("ordinal").isNotNull())
    return gaps.select(SITE, "start_idx", "step", "ordinal", "gap_count")


@query
def fill_rounds(spark, sf_dir):
    sample = SG.gap_samples(proxy.target_series(spark, sf_dir)).select(SITE, "start_idx", "gap_count")
    return SG.fill_rounds(numbered(sample, spark, sf_dir))


@query
def metric_stall(spark, sf_dir):
    """Daily back-test error of the guided forecast per site, as a history with patience."""
    rows = MD.with_lag(modelled_target(spark, sf_dir)).withColumns(
        {
            "y": F.col(TARGET),
            "yhat": F.col("a") + F.col("b") * F.coalesce(F.col("before"), F.lit(0.0)),
            "epoch": F.expr("row_idx div 96"),
        }
    )
    out = M.metric_stall(rows.groupBy(SITE, "epoch").agg(M.rmse().alias("rmse")), PATIENCE)
    return out.select(
        SITE, "epoch", num("rmse"), num("best"), "improved", "epochs_since_best", "stopped"
    )


# ---- metrics ---------------------------------------------------------------------------


@query
def fit_stats(spark, sf_dir):
    full = proxy.with_weather(spark, sf_dir)
    stats = SC.stats_long(SC.fit_stats(full.filter(EV.in_train())))
    return stats.select(SITE, "feature", num("mean"), num("std"))


@query
def incremental_stats(spark, sf_dir):
    """Statistics and AR(1) from stored day states: history, then new days, then one day again."""
    columns = [TARGET, "AirTemperature", "RelativeHumidity"]
    slotted = proxy.slotted(spark, sf_dir)
    day = MO.day_of(F.col("slot"))
    known = slotted.agg(F.max(day).alias("last")).first()["last"]
    root = f"{checkpoint_dir(spark)}/day-states-{uuid.uuid4().hex}"
    for new in (day <= known - NEW_DAYS, day > known - NEW_DAYS, day == known - NEW_DAYS):
        day_store.add_days(MO.day_states(slotted.filter(new), columns), root)
    out = MO.fit_from_states(day_store.read_states(spark, root), columns)
    floats = [f"{c}_{s}" for c in columns for s in ("mean", "std")]
    return out.select(SITE, *[f"{c}_n" for c in columns], *[num(c) for c in floats], num("a"), num("b"), "n_pairs")


@query
def power_rescaled(spark, sf_dir):
    out = SC.rescale_power(proxy.supplier_series(spark, sf_dir))
    return out.select(SITE, "row_idx", num(TARGET))


@query
def metrics_overall(spark, sf_dir):
    out = M.scores(EV.forecast_truth(proxy.target_series(spark, sf_dir)), ["dataset"])
    return out.select("dataset", "n_valid", num("rmse"), num("r2"))


@query
def metrics_by_step(spark, sf_dir):
    out = M.metrics_by_step(EV.forecast_truth(proxy.target_series(spark, sf_dir)))
    return out.select("dataset", "step", "minutes_ahead", "n_valid", num("rmse"), num("r2"))


@query
def masked_mse(spark, sf_dir):
    """Error per sample, 0 for samples without truth."""
    cell = FC.forecast_ar(site_cells(spark, sf_dir))
    return cell.groupBy(SITE, "start_idx").agg(num(M.masked_mse(), "mse"))


@query
def batch_mean_rmse(spark, sf_dir):
    cell = FC.forecast_ar(dataset_cells(spark, sf_dir))
    return M.batch_mean_rmse(cell, ["dataset"]).select("dataset", "n_batches", num("yhat", "rmse"))


def _epoch_loss(cell, keys=("dataset",)):
    batches = cell.groupBy(*keys, "batch_id").agg(
        F.avg(F.pow(F.col("yhat") - F.col("y"), F.lit(2.0))).alias("loss")
    )
    out = M.epoch_loss(batches, keys)
    return out.select(*keys, "n_batches", "n_defined", num("loss_lenient"), num("loss_strict"))


@query
def epoch_loss(spark, sf_dir):
    """Guided epoch loss; in the test set every seventh batch counts as one without truth."""
    cell = FC.forecast_guided(dataset_cells(spark, sf_dir))
    dark = (F.col("dataset") == "test") & (F.col("batch_id") % 7 == 3)
    return _epoch_loss(cell.withColumn("y", F.when(~dark, F.col("y"))))


@query
def epoch_loss_ar(spark, sf_dir):
    """Epoch loss of the fully autoregressive forecast; its strict form is the published one."""
    return _epoch_loss(FC.forecast_ar(dataset_cells(spark, sf_dir)))


@query
def gap_fill_loss(spark, sf_dir):
    """Epoch loss of forecasts from inputs whose gaps were filled round by round."""
    sample = SG.gap_samples(modelled_target(spark, sf_dir), keep=["a", "b"])
    filled = FC.fill_gaps_reference(SG.with_rounds(numbered(sample, spark, sf_dir)))
    cell = filled.withColumn("yhat", F.col("a") + F.col("b") * F.col("filled"))
    return _epoch_loss(cell, ())


@query
def blended_loss(spark, sf_dir):
    sample = SQ.samples(
        modelled_target(spark, sf_dir),
        extra=["run_end"],
        keep=["a", "b"],
        derive=lambda framed, w: SG.mark_run_ends(framed, w, SEGMENT),
        before=SG.run_reach(SEGMENT),
    )
    cell = FC.forecast_guided(SQ.cells(numbered(sample, spark, sf_dir), ["run_end"]))
    first = F.col("start_idx") + LOOKBACK
    flag = SG.in_segment(F.col("y"), F.col("run_end"), first, SEGMENT)
    out = M.blended_loss(cell.withColumn("in_segment", flag), BLEND_EPOCH)
    return out.select("batch_id", num("base_loss"), num("segment_loss"), num("loss"))


@query
def validation_modes(spark, sf_dir):
    cell = dataset_cells(spark, sf_dir).withColumns(
        {"guided": FC.guided(), "hybrid": FC.hybrid(), "autoregressive": FC.autoregressive()}
    )
    return M.validate_modes(cell).select("dataset", "mode", "n_batches", num("rmse"))


# ---- splits, sampling, time and sun ----------------------------------------------------


@query
def hash_split(spark, sf_dir):
    index = SQ.sample_keys(proxy.target_series(spark, sf_dir))
    return SQ.split_windows(index, WEIGHTS, SEED)


@query
def shuffle_order(spark, sf_dir):
    index = SQ.sample_keys(proxy.target_series(spark, sf_dir))
    return SQ.shuffled(index, SEED)


@query
def epoch_order(spark, sf_dir):
    """Where every sample comes in an epoch's shuffled order, and the sample found there again."""
    index = numbered(SQ.sample_keys(proxy.target_series(spark, sf_dir)), spark, sf_dir)
    total = SQ.sequence_counts(proxy.lengths(spark, sf_dir)).agg(F.sum("n_sequences")).first()[0] or 0
    order = ORD.EpochOrder(total, SEED, MIX_EPOCH)
    placed = order.with_position(index.select(SITE, "start_idx", "sample_id"))
    return order.with_sample(placed, name="found")


@query
def trainer_shards(spark, sf_dir):
    """Samples exported as files of whole batches; each batch read from where the manifest says."""
    scaled = scaled_readings_of(proxy.readings(spark, sf_dir))
    packed = SQ.packed_sequences(scaled)
    # A packed row has the number of its first sample.
    packed = numbered(packed.withColumn("start_idx", F.col("lo")), spark, sf_dir).drop("start_idx", "batch_id")
    path = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    shards.write_packed_shards(packed, lambda rows: SQ.unfold_sequences(rows, keep=["offset"]), path)
    rows = shards.read_places(spark, path)
    batch = rows.groupBy("batch_id", "first_sample", "last_sample").agg(
        F.count("*").alias("n_samples"),
        F.min(F.col("place") - (F.col("sample_id") - F.col("first_sample"))).alias("off_by"),
        num(F.sum(F.aggregate("tgt_out", F.lit(0.0), lambda acc, y: acc + y)), "tgt_out_sum"),
    )
    return batch.withColumn("in_order", F.col("off_by") == 0).drop("off_by")


@query
def forecast_samples(spark, sf_dir):
    """Fifty forecast windows per data set beside the truth."""
    series = SQ.split_by_time(modelled_target(spark, sf_dir), EV.SHARES, 100)
    picks = SQ.sample_windows(SQ.sample_keys(series, keys=DATASET_KEYS), PICKS, SEED)
    most = PICKS * len(EV.SHARES)
    rows = SQ.picked_rows(series, picks, keys=DATASET_KEYS, at_most=most)
    sample = SQ.samples(rows, keep=MD.model_columns(), keys=DATASET_KEYS)
    picked = SQ.with_picks(sample, picks, DATASET_KEYS, most)
    out = EV.in_kilowatts(FC.forecast_ar(SQ.cells(picked)))
    minutes = ((F.col("step") + 1) * 15).alias("minutes_ahead")
    return out.select("dataset", "pick", SITE, "start_idx", minutes, num("y"), num("yhat"))


@query
def scheduled_mix(spark, sf_dir):
    """Samples mixed with the forecasts that are cached for training samples alone: those of
    the other samples are absent and skipped."""
    sample = SQ.samples(modelled_target(spark, sf_dir), keep=["a", "b", "n_rows"])
    upto = F.expr(f"n_rows * {EV.SHARES['train'][1]} div 100")
    cached = sample.filter(F.col("start_idx") + LOOKBACK + HORIZON <= upto)
    cell = SQ.cells(FC.join_cache(sample, FC.build_cache(cached)))
    out = FC.scheduled_mix(cell, MIX_EPOCH, MIX_EPOCHS, SEED)
    return out.select(SITE, "start_idx", "step", "taken", num("mixed"))


@query
def cycle_features(spark, sf_dir):
    out = prepare.cycle_features(proxy.target_series(spark, sf_dir))
    return out.select(SITE, "row_idx", num("day_sin"), num("year_sin"))


@query
def solar_position(spark, sf_dir):
    grid = proxy.target_series(spark, sf_dir)
    out = prepare.solar_position(grid, proxy.places(proxy.events(spark, sf_dir)))
    return out.select(SITE, "row_idx", *[num(c) for c in ("zenith", "zenith_sin", "azimuth_sin")])


@query
def grid_readings(spark, sf_dir):
    out = proxy.station_grid(spark, sf_dir)
    return out.select(
        SITE, "row_idx", "n_rows", "ts", num(TARGET), num("AirTemperature"), num("RelativeHumidity")
    )


# ---- forecasts -------------------------------------------------------------------------


@query
def ar1_coefficients(spark, sf_dir):
    series = proxy.target_series(spark, sf_dir)
    scaled = SC.scale_by_site(series, SC.fit_stats(series.filter(EV.in_train()), [TARGET]), [TARGET])
    out = MD.fit_ar1(scaled, train=EV.in_train())
    return out.select(SITE, num("a"), num("b"), "n_pairs")


@query
def arx_forecast(spark, sf_dir):
    """Pooled linear model on all encoder inputs, rolled out and scored per step."""
    scaled = cut(scaled_readings_of(proxy.readings(spark, sf_dir)))
    fitted = MD.fit_arx(MD.arx_rows(scaled).filter(EV.in_train()))
    cell = MD.arx_forecast(scaled, MD.arx_weights(fitted))
    out = M.metrics_by_step(cell, keys=[SITE])
    return out.select(SITE, "step", "minutes_ahead", "n_valid", num("rmse"), num("r2"))


@query
def direct_forecast(spark, sf_dir):
    """One model per site and step, fitted on whole training samples, scored per data set."""
    series = SQ.split_by_time(modelled_target(spark, sf_dir), EV.SHARES, 100)
    cell = SQ.cells(SQ.samples(series, keys=DATASET_KEYS))
    model = MD.fit_direct(cell.filter(F.col("dataset") == "train"))
    out = M.metrics_by_step(MD.direct_forecast(cell, model), keys=["dataset", SITE])
    return out.select("dataset", SITE, "step", "minutes_ahead", "n_valid", num("rmse"), num("r2"))


def _joint(spark, sf_dir):
    """Samples of all data sets, and the joint model of the training ones."""
    scaled = scaled_readings_of(proxy.readings(spark, sf_dir))
    series = SQ.split_by_time(scaled.drop("ts"), EV.SHARES, 100)
    sample = cut(J.joint_samples(series, keys=DATASET_KEYS))
    return sample, J.fit_joint(sample.filter(F.col("dataset") == "train"))


@query
def joint_weights(spark, sf_dir):
    """Weights of all inputs per step, from one aggregate over the training samples."""
    _, weights = _joint(spark, sf_dir)
    rows = [(k + 1, name, w) for k, of in enumerate(weights) for name, w in of.items()]
    out = spark.createDataFrame(rows, "step int, input string, weight double")
    return out.select("step", "input", num("weight"))


@query
def joint_forecast(spark, sf_dir):
    """All twenty steps at once from the encoder inputs, scored per data set."""
    sample, weights = _joint(spark, sf_dir)
    out = M.metrics_by_step(J.joint_forecast(sample, weights, DATASET_KEYS))
    return out.select("dataset", "step", "minutes_ahead", "n_valid", num("rmse"), num("r2"))


@query
def tree_forecast(spark, sf_dir):
    """Boosted trees on window summaries and known-ahead features, fitted on the training
    samples, scored per data set."""
    scaled = scaled_readings_of(proxy.readings(spark, sf_dir))
    series = SQ.split_by_time(scaled.drop("ts"), EV.SHARES, 100)
    sample = cut(TR.tree_samples(series, keys=DATASET_KEYS))
    cell = TR.tree_cells(sample, DATASET_KEYS)
    model = TR.fit_trees(cell.filter(F.col("dataset") == "train"))
    out = M.metrics_by_step(TR.tree_forecast(cell, model))
    return out.select("dataset", "step", "minutes_ahead", "n_valid", num("rmse"), num("r2"))


def _forecast(spark, sf_dir, apply):
    out = apply(site_cells(spark, sf_dir))
    return out.select(SITE, "start_idx", "step", num("yhat"))


@query
def forecast_guided(spark, sf_dir):
    return _forecast(spark, sf_dir, FC.forecast_guided)


@query
def forecast_ar(spark, sf_dir):
    return _forecast(spark, sf_dir, FC.forecast_ar)


@query
def forecast_hybrid(spark, sf_dir):
    return _forecast(spark, sf_dir, FC.forecast_hybrid)


@query
def gap_fill_reference(spark, sf_dir):
    sample = SG.gap_samples(modelled_target(spark, sf_dir), keep=["a", "b"])
    out = FC.fill_gaps_reference(SG.with_rounds(numbered(sample, spark, sf_dir)))
    return out.filter(F.col("y").isNull()).select(
        SITE, "start_idx", "step", "ordinal", "rounds", num("filled")
    )


@query
def gap_fill_aligned(spark, sf_dir):
    out = FC.fill_gaps_aligned(FC.aligned_samples(modelled_target(spark, sf_dir), keep=["a", "b"]))
    return out.filter(F.col("y").isNull()).select(
        SITE, "start_idx", "step", "gap_length", num("filled")
    )


@query
def prediction_cache(spark, sf_dir):
    cache = FC.build_cache(site_samples(spark, sf_dir))
    long = cache.select(SITE, "start_idx", F.posexplode("cached").alias("step", "yhat"))
    return long.select(SITE, "start_idx", "step", num("yhat"))


@query
def refine_history(spark, sf_dir):
    series = SQ.split_by_time(modelled_target(spark, sf_dir), EV.SHARES, 100)
    out = refine(series, epochs=REFINE_EPOCHS, patience=REFINE_PATIENCE, seed=SEED)
    return out.select("epoch", num("rate"), num("ar_rmse"), num("best"), "improved")


@query
def evaluation_report(spark, sf_dir):
    out = EV.evaluate(proxy.target_series(spark, sf_dir))
    return out.select(
        "dataset", "scope", "step", "minutes_ahead", "n_valid", num("rmse"), num("r2")
    )
