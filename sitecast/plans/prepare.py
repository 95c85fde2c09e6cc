"""Calendar and sun features of gridded readings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.functions import clock, solar
from sitecast.operators.chunks import attach_by_site
from sitecast.schema import SITE


def cycle_features(df: DataFrame) -> DataFrame:
    ts = F.col("ts")
    return df.withColumns({"day_sin": clock.day_sin(ts), "year_sin": clock.year_sin(ts)})


def sun_angles(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Add `zenith` and `azimuth` in degrees; `sites` holds lat and lon per site."""
    joined = attach_by_site(df, sites.select(SITE, "lat", "lon"))
    zenith, azimuth = solar.sun_angles(F.col("ts"), F.col("lat"), F.col("lon"))
    return joined.withColumns({"zenith": zenith, "azimuth": azimuth}).drop("lat", "lon")


def solar_position(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Add the two sun angles as sines."""
    return sun_angles(df, sites).withColumns(
        {
            "zenith_sin": F.sin(F.radians("zenith")),
            "azimuth_sin": F.sin(F.radians("azimuth")),
        }
    )
