"""Schemas (as DDL text) of the raw feeds and of the tables the operators produce."""

# Raw feeds.
LONG_OBSERVATIONS = (
    "station_id string, obs_date string, element string, value double, "
    "m_flag string, q_flag string, s_flag string, obs_time string"
)
GRID = (
    "latitude double, longitude double, time string, t2m double, tp double, "
    "sp double, u10 double, v10 double"
)
MONTH_GRID = (
    "year int, month int, latitude double, longitude double, temp_anomaly double"
)

# Station inventory layout, (name, first character, length, type).
STATION_LAYOUT = [
    ("station_id", 1, 11, "string"),
    ("latitude", 13, 8, "double"),
    ("longitude", 22, 9, "double"),
    ("elevation", 32, 6, "double"),
    ("state", 39, 2, "string"),
    ("name", 42, 30, "string"),
    ("gsn_flag", 73, 3, "string"),
    ("hcn_flag", 77, 3, "string"),
    ("wmo_id", 81, 5, "string"),
]

# Observation elements and the factor each raw value is divided by.
ELEMENTS = ["TMAX", "TMIN", "TAVG", "PRCP", "SNOW", "SNWD"]
ELEMENT_DIVISORS = {"TMAX": 10.0, "TMIN": 10.0, "TAVG": 10.0, "PRCP": 10.0}
VARIABLES = ["tmax", "tmin", "prcp"]

# Outputs of the grouped models.
FORECAST = (
    "station_id string, forecast_date date, variable string, predicted_value double, "
    "lower_bound double, upper_bound double, model_type string, model_version string, "
    "mae double, rmse double"
)
FORECAST_COLUMNS = [part.split()[0] for part in FORECAST.split(", ")]
