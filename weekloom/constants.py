"""Names and lookup values shared by the operators."""

DISEASES = ("leptospirosis", "typhus", "hepatitis_a", "chickenpox")

CLIMATE_VARIABLES = ("T2M", "T2M_MAX", "T2M_MIN", "RH2M", "PRECTOTCORR")
WEEKLY_CLIMATE = tuple(f"{v}_{s}" for v in CLIMATE_VARIABLES for s in ("max", "min", "avg"))

LAGGED_CLIMATE = ("PRECTOTCORR_avg", "T2M_avg", "RH2M_avg")
CLIMATE_LAG_COLUMNS = tuple(f"{v}_lag_{k}" for v in LAGGED_CLIMATE for k in range(1, 7))

SEASON_COLUMNS = ("month", "monsoon_IM2", "monsoon_NE", "monsoon_SW", "week_number", "sin_week", "cos_week")
PANEL_FEATURES = WEEKLY_CLIMATE + SEASON_COLUMNS + CLIMATE_LAG_COLUMNS

TARGET_LAGS = (1, 2, 3, 4, 5, 6, 8, 12)
ROLLING_WINDOWS = (2, 4, 8, 12)

TARGET_FEATURES = (
    tuple(f"target_lag_{k}" for k in TARGET_LAGS)
    + tuple(f"target_roll_{s}_{w}" for w in ROLLING_WINDOWS for s in ("mean", "std", "max", "min"))
    + ("target_trend_4", "target_trend_8", "target_accel")
)
INTERACTION_FEATURES = (
    "heat_humidity", "rain_humidity", "rain_temp", "temp_range",
    "rain_hum_lag1", "rain_hum_lag2", "cum_rain_4w", "cum_rain_8w",
)
TRAIN_STAT_FEATURES = ("district_week_mean", "late_dist_mean", "excess_over_seasonal", "ratio_to_seasonal")
MODEL_FEATURES = PANEL_FEATURES + TARGET_FEATURES + INTERACTION_FEATURES + TRAIN_STAT_FEATURES + ("district_enc",)

# Spelling variants of a district and names that are not districts.
DISTRICT_ALIASES = {"NuwaraEliya": "Nuwara Eliya"}
DISTRICTS_DROPPED = ("Kalmune",)

# Expected physical range per climate variable prefix (low, high; None = open).
EXPECTED_RANGES = {"T2M": (15.0, 35.0), "RH2M": (0.0, 100.0), "PRECTOTCORR": (0.0, None)}

# District centroids (latitude, longitude) as used with the daily climate source.
DAILY_SOURCE_COORDINATES = {
    "Colombo": (6.9271, 79.8612),
    "Gampaha": (7.0850, 79.9994),
    "Kalutara": (6.5854, 80.0853),
    "Kandy": (7.2906, 80.6337),
    "Matale": (7.4675, 80.6234),
    "Nuwara Eliya": (6.9497, 80.7891),
    "Galle": (6.0535, 80.2210),
    "Matara": (5.9485, 80.5428),
    "Hambantota": (6.1246, 81.1185),
    "Jaffna": (9.6615, 80.0255),
    "Kilinochchi": (9.3890, 80.3990),
    "Mannar": (8.9800, 79.9095),
    "Vavuniya": (8.7500, 80.5000),
    "Mullaitivu": (9.2671, 80.8140),
    "Batticaloa": (7.7102, 81.6924),
    "Ampara": (7.2975, 81.6820),
    "Trincomalee": (8.5710, 81.2335),
    "Kurunegala": (7.4863, 80.3647),
    "Puttalam": (8.0400, 79.8283),
    "Anuradhapura": (8.3114, 80.4037),
    "Polonnaruwa": (7.9403, 81.0188),
    "Badulla": (6.9934, 81.0550),
    "Monaragala": (6.8900, 81.3500),
    "Ratnapura": (6.6850, 80.4037),
    "Kegalle": (7.2513, 80.3464),
}

# District centroids (latitude, longitude) as used with the readings source.
READING_SOURCE_COORDINATES = {
    "Colombo": (6.9271, 79.8612),
    "Gampaha": (7.0892, 80.7744),
    "Kalutara": (6.5896, 80.2712),
    "Kandy": (7.2906, 80.6337),
    "Matale": (7.7674, 80.6270),
    "Nuwara Eliya": (6.9497, 80.7891),
    "Galle": (6.0535, 80.2179),
    "Matara": (5.7489, 80.5353),
    "Hambantota": (6.1256, 81.1242),
    "Jaffna": (9.6615, 80.7740),
    "Kilinochchi": (9.3886, 80.4318),
    "Mannar": (8.9833, 79.9167),
    "Vavuniya": (8.7606, 80.4945),
    "Mullaitivu": (8.3068, 81.8109),
    "Batticaloa": (7.7102, 81.7050),
    "Ampara": (7.2833, 81.6667),
    "Trincomalee": (8.5874, 81.2348),
    "Kurunegala": (7.4821, 80.6354),
    "Puttalam": (8.0306, 79.8336),
    "Anuradhapura": (8.3163, 80.3858),
    "Polonnaruwa": (7.9408, 81.0081),
    "Badulla": (6.9934, 81.2671),
    "Monaragala": (6.8297, 81.3530),
    "Ratnapura": (6.7148, 80.3987),
    "Kegalle": (7.2515, 80.8393),
}
