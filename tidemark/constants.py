"""Fixed values of the scoring method.

All of these must equal the published calibration for results to match.
"""

# --- fixed values: horizons, sub-scores and horizon weights -----------------
HORIZONS = ("near", "med", "long")

WEIGHTS = {
    "near": {
        "lead_time_growth": 0.30,
        "capacity_tightness": 0.35,
        "geo_concentration": 0.10,
        "regulatory_friction": 0.05,
        "demand_signal": 0.20,
    },
    "med": {
        "lead_time_growth": 0.20,
        "capacity_tightness": 0.20,
        "geo_concentration": 0.20,
        "regulatory_friction": 0.15,
        "demand_signal": 0.25,
    },
    "long": {
        "lead_time_growth": 0.10,
        "capacity_tightness": 0.10,
        "geo_concentration": 0.30,
        "regulatory_friction": 0.30,
        "demand_signal": 0.20,
    },
}

# --- fixed values: normalization bands (sub-score, source, min, max) --------
BANDS = [
    ("lead_time_growth", "transformers_ppi", 80.0, 350.0),
    ("lead_time_growth", "semi_book_to_bill", 0.8, 1.4),
    ("lead_time_growth", "semi_ppi", -0.10, 0.25),
    ("lead_time_growth", "edgar_keyword", -2.0, 2.0),
    ("lead_time_growth", "seed", 0.0, 1.0),
    ("capacity_tightness", "iso_capacity_ratio", 0.0, 1.0),
    ("capacity_tightness", "power_ratio", 0.0, 0.5),
    ("capacity_tightness", "manufacturing_utilization", 75.0, 90.0),
    ("capacity_tightness", "comtrade_volume", -0.20, 0.40),
    ("capacity_tightness", "edgar_keyword", -2.0, 2.0),
    ("capacity_tightness", "seed", 0.0, 1.0),
    ("capacity_tightness", "imputed", 0.0, 1.0),
    ("demand_signal", "hyperscaler_capex", -0.10, 0.40),
    ("demand_signal", "manufacturing_indpro", -0.05, 0.10),
    ("demand_signal", "seed", 0.0, 1.0),
    ("geo_concentration", "hhi", 0.0, 1.0),
    ("geo_concentration", "seed", 0.0, 1.0),
    ("regulatory_friction", "seed", 0.0, 1.0),
]

# --- fixed values: regimes and their ordered (B, B') cells ------------------
REGIMES = ("PEAKING", "PEAKED", "RESOLVING", "EMERGING", "STABLE", "RESOLVING_FROM_LOW", "NO_DATA")
LONG_GUARD = ("RESOLVING", "RESOLVING_FROM_LOW", "NO_DATA")
NO_DATA_COMPLETENESS = 0.4
FAST_RESOLVE_BELOW = -50.0

# (b_min, b_max, b_max_inclusive, bp_min, bp_max, bp_max_inclusive, regime)
REGIME_CELLS = [
    (70.0, None, False, 20.0, None, False, "PEAKING"),
    (70.0, None, False, 0.0, 20.0, False, "PEAKED"),
    (70.0, None, False, None, 0.0, False, "RESOLVING"),
    (0.0, None, False, 30.0, None, False, "EMERGING"),
    (30.0, 70.0, False, None, -15.0, True, "RESOLVING"),
    (30.0, None, False, -15.0, 30.0, False, "STABLE"),
    (0.0, 30.0, False, None, -15.0, True, "RESOLVING_FROM_LOW"),
]

# --- fixed values: windows and gates ----------------------------------------
SIGNAL_LOOKBACK_DAYS = 1825
LOOKAHEAD_DAYS = 1095
LOOKAHEAD_SIGNALS = ("planned_capacity_mw",)
IDEMPOTENT_SOURCES = ("eia_860m",)
MOMENTUM_DAYS = 180
MOMENTUM_NEAR_ZERO = 5.0
MOMENTUM_CAP = 100.0
ROLLING_DAYS = 1825
ROLLING_LOW = 0.05
ROLLING_HIGH = 0.95
ROLLING_MIN_SPAN = 365
ROLLING_MATURE_SPAN = 730
HHI_FLOOR = 0.05
HHI_SEED_GAP = 0.30
PEAK_CAPACITY_GAP_DAYS = 400
RETENTION_DAYS = 1825
PUBLICATION_LAG_MONTHS = 3

# --- fixed values: baskets and inference ------------------------------------
MIN_BASKET_SCORE = 50.0
SEGMENT_PROXIMITY = 10.0
MAX_SEGMENTS = 2
MAX_TICKERS = 5
MIN_EXPOSURE = 0.50
MIN_MCAP_USD = 2_000_000_000.0
COST_PER_NAME = 0.001
TRADING_DAYS = 252.0
STEP_DAYS = 30
BOOTSTRAPS = 1000
BOOTSTRAP_SEED = 42
FDR_ALPHA = 0.10

# --- fixed values: audit thresholds -----------------------------------------
DIVERGENCE_GAP = 0.2
INTERESTING_SCORE_DELTA = 5.0
INTERESTING_MOMENTUM = 5.0
CLAIM_ABS_TOL = 0.05
CLAIM_REL_TOL = 0.02
SEED_BACKED = ("lead_time_growth", "geo_concentration", "demand_signal")

# --- fixed values: filings --------------------------------------------------
PHRASES = ("lead time", "shortage", "capacity expansion")
ACCEPTED_FORMS = ("10-K", "10-Q", "8-K", "20-F", "10-K/A", "10-Q/A", "20-F/A")
CLUSTER_DAYS = 30
CLUSTER_THRESHOLD = 3
RATIO_LOW, RATIO_HIGH = 0.5, 2.0
LB_PER_MWH_TO_G_PER_KWH = 0.453592

# --- fixed values: segment profiles ------------------------------------------
PROFILES = (
    "power_generation_oem",
    "data_center_shell",
    "gpu_asic_silicon",
    "advanced_node_fabs",
    "hbm_memory",
    "networking_interconnect",
    "advanced_packaging",
    "systems_rack_scale",
    "cooling_water",
    "transformers_tnd",
)

# Which source feeds a sub-score for a profile, best first.
SOURCE_PRIORITY = {
    "capacity_tightness": {
        "power_generation_oem": ("iso_capacity_ratio", "power_ratio", "edgar_keyword"),
        "data_center_shell": ("iso_capacity_ratio", "power_ratio", "edgar_keyword"),
        "gpu_asic_silicon": ("edgar_keyword",),
        "advanced_node_fabs": ("edgar_keyword",),
        "hbm_memory": ("comtrade_volume", "edgar_keyword"),
        "networking_interconnect": ("edgar_keyword",),
        "advanced_packaging": ("comtrade_volume", "edgar_keyword"),
        "systems_rack_scale": ("manufacturing_utilization", "edgar_keyword"),
        "cooling_water": ("manufacturing_utilization", "edgar_keyword"),
        "transformers_tnd": ("comtrade_volume", "edgar_keyword"),
    },
    "lead_time_growth": {
        "power_generation_oem": ("edgar_keyword",),
        "data_center_shell": ("edgar_keyword",),
        "gpu_asic_silicon": ("semi_book_to_bill", "semi_ppi", "edgar_keyword"),
        "advanced_node_fabs": ("semi_book_to_bill", "semi_ppi", "edgar_keyword"),
        "hbm_memory": ("semi_book_to_bill", "semi_ppi", "edgar_keyword"),
        "networking_interconnect": ("semi_book_to_bill", "semi_ppi", "edgar_keyword"),
        "advanced_packaging": ("semi_book_to_bill", "semi_ppi", "edgar_keyword"),
        "systems_rack_scale": ("edgar_keyword",),
        "cooling_water": ("edgar_keyword",),
        "transformers_tnd": ("transformers_ppi",),
    },
    "demand_signal": {
        "power_generation_oem": ("manufacturing_indpro",),
        "data_center_shell": ("hyperscaler_capex",),
        "gpu_asic_silicon": ("hyperscaler_capex",),
        "advanced_node_fabs": ("hyperscaler_capex",),
        "hbm_memory": ("hyperscaler_capex",),
        "networking_interconnect": ("hyperscaler_capex",),
        "advanced_packaging": ("hyperscaler_capex",),
        "systems_rack_scale": ("manufacturing_indpro",),
        "cooling_water": ("manufacturing_indpro",),
        "transformers_tnd": (),
    },
}

# --- fixed values: static resolution bands by profile -------------------------
ETA = {
    "advanced_node_fabs": (">24mo", "medium"),
    "advanced_packaging": ("12-24mo", "medium"),
    "cooling_water": ("12-24mo", "low"),
    "data_center_shell": (">24mo", "medium"),
    "gpu_asic_silicon": ("12-24mo", "low"),
    "hbm_memory": ("12-24mo", "medium"),
    "networking_interconnect": ("12-24mo", "low"),
    "power_generation_oem": (">24mo", "medium"),
    "systems_rack_scale": ("<12mo", "low"),
    "transformers_tnd": (">24mo", "high"),
}

# --- fixed values: exchange -> home region, exchange -> currency --------------
EXCHANGE_REGION = {
    "NYSE": "NorthAmerica",
    "NASDAQ": "NorthAmerica",
    "NYSEMKT": "NorthAmerica",
    "AMEX": "NorthAmerica",
    "OTCQX": "NorthAmerica",
    "TSE": "Japan",
    "TYO": "Japan",
    "KRX": "Korea",
    "KOSPI": "Korea",
    "TWSE": "Taiwan",
    "FRA": "Europe",
    "XETRA": "Europe",
    "ETR": "Europe",
    "EPA": "Europe",
    "BME": "Europe",
    "OSLO": "Europe",
    "LSE": "Europe",
    "SIX": "Europe",
    "SSE": "GreaterChina",
    "SZSE": "GreaterChina",
    "HKEX": "GreaterChina",
    "BSE": "GreaterChina",
    "NSE": "GreaterChina",
    "ASX": "SoutheastAsia",
    "SGX": "SoutheastAsia",
    "TADAWUL": "MiddleEast",
    "OTHER": "NorthAmerica",
}

EXCHANGE_CURRENCY = {
    "NYSE": "USD",
    "NASDAQ": "USD",
    "NYSEMKT": "USD",
    "AMEX": "USD",
    "OTCQX": "USD",
    "OTHER": "USD",
    "TSE": "JPY",
    "TYO": "JPY",
    "KRX": "KRW",
    "KOSPI": "KRW",
    "TWSE": "TWD",
    "FRA": "EUR",
    "XETRA": "EUR",
    "ETR": "EUR",
    "EPA": "EUR",
    "BME": "EUR",
    "OSLO": "EUR",
    "LSE": "GBP",
    "HKEX": "HKD",
    "SSE": "CNY",
    "SZSE": "CNY",
    "SGX": "SGD",
    "TADAWUL": "SAR",
}

# --- fixed values: grid regions ------------------------------------------------
REGION_STATES = {
    "ERCO": ("TX",),
    "CISO": ("CA",),
    "PJM": ("PA", "NJ", "MD", "DE", "DC", "VA", "WV", "OH", "NC", "SC", "IL", "IN", "KY", "TN", "MI"),
    "MISO": ("MN", "WI", "IA", "MO", "AR", "LA", "ND", "SD", "NE", "MS", "MT", "OK", "NM", "KS", "TX"),
    "NYIS": ("NY",),
    "ISNE": ("ME", "NH", "VT", "MA", "RI", "CT"),
    "SWPP": ("KS", "OK", "NE", "ND", "SD", "MT", "WY", "CO", "NM", "TX"),
}
REGION_SEGMENTS = {
    "ERCO": ("power_generation_oem", "data_center_shell"),
    "CISO": ("power_generation_oem", "data_center_shell"),
    "PJM": ("power_generation_oem", "data_center_shell"),
    "MISO": ("power_generation_oem",),
    "NYIS": ("power_generation_oem",),
    "ISNE": ("power_generation_oem",),
    "SWPP": ("power_generation_oem",),
}
