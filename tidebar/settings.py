"""Fixed values of the engine, in one place."""

# Indicator windows (in bars).
SMA_WINDOWS = (7, 14, 30, 50)
EMA_SPANS = (7, 14, 30)
RSI_WINDOW = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BOLLINGER_WINDOW, BOLLINGER_DEVIATIONS = 20, 2
LAGS = (1, 2, 4, 6, 12, 24)
VOLUME_WINDOWS = (7, 14, 30, 50)

# Forecast horizons in bars, in display order.
HORIZONS = {"1h": 1, "1d": 24, "1w": 168}

# The market symbols and the column suffix each one gets.
MARKET_SYMBOLS = {
    "^GSPC": "GSPC",
    "^IXIC": "IXIC",
    "^DJI": "DJI",
    "^TNX": "TNX",
    "GC=F": "GC",
    "SI=F": "SI",
    "DX-Y.NYB": "DX",
    "^VIX": "VIX",
}

# Training windows of the window experiment, in days and in order.
TRAINING_WINDOWS = {
    "1_month": 30,
    "6_weeks": 42,
    "2_months": 60,
    "10_weeks": 70,
    "3_months": 90,
    "4_months": 120,
}

# Learner settings.
TREES, DEPTH, LEARNING_RATE, SEED = 100, 6, 0.1, 42
CV_FOLDS, TOP_FEATURES, RETRAIN_HOURS = 5, 50, 24

# Rows per window task: a chunk of a series plus what its frames look back on.
CHUNK_ROWS = 16384
HALO_ROWS = 2048
BLOCK_ROWS = 256
SLOT_SECONDS = 14 * 24 * 3600
