"""Column names and sizes."""

# Column names and sizes that readings and scaler files use.
TARGET = "SolarGeneration"
WEATHER = [
    "AirTemperature",
    "Ghi_hourly",
    "CloudOpacity_hourly",
    "minutes_since_last_update",
    "RelativeHumidity",
]
TIME = ["zenith_sin", "azimuth_sin", "day_sin", "year_sin"]
LOOKBACK = 96
HORIZON = 20
BATCH = 32
STEP_MINUTES = 15
SENTINEL = -999.0
MIN_STD = 1e-6

ENCODER = WEATHER + TIME + [TARGET]
DECODER = TIME + [TARGET]
SCALED = WEATHER + [TARGET]

SITE = "campus_key"
SLOT_MICROS = STEP_MINUTES * 60 * 1_000_000
SLOTS_PER_DAY = 24 * 60 // STEP_MINUTES

# Rows of one site that share a window partition (10 days). Frames reach at most
# LOOKBACK rows back, so the copied margin stays near a tenth of the data.
CHUNK = 960
