"""Results are only right when these equal the published ones."""

# --- fixed values: seed rule catalogue -------------------------------------------------------
RULE_COLUMNS = (
    "parameter string, display_name string, unit string, normal_low double, normal_high double, "
    "critical_low double, critical_high double, threshold_scale double, rate_change_scale double, "
    "enabled boolean"
)
SEED_RULES = [
    ("pH", "pH", "pH", 6.5, 9.0, 6.0, 9.5, 1.0, 1.0, True),
    ("temperature", "Temperature", "C", 0.0, 30.0, -1.0, 35.0, 10.0, 10.0, True),
    ("turbidity", "Turbidity", "NTU", 0.0, 10.0, -1.0, 50.0, 15.0, 5.0, True),
    ("conductivity", "Conductivity", "uS/cm", 150.0, 500.0, 50.0, 1500.0, 500.0, 300.0, True),
    ("dissolved_oxygen", "Dissolved Oxygen", "mg/L", 5.5, 14.0, 3.0, 18.0, 3.0, 2.0, True),
    ("ORP", "ORP", "mV", 300.0, 500.0, 100.0, 700.0, 200.0, 100.0, True),
]
PARAMETERS = ("pH", "temperature", "turbidity", "conductivity", "dissolved_oxygen", "ORP")
DEFAULT_THRESHOLD_SCALE = 1.0
DEFAULT_RATE_SCALE = 1.0

# --- fixed values: timestamp texts -----------------------------------------------------------
MICROS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
MILLIS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
SECONDS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# --- fixed values: anomaly score -------------------------------------------------------------
SCORE_WEIGHTS = {"threshold": 0.5, "statistical": 0.3, "rate": 0.2}
SCORE_FLOORS = {"critical": 0.85, "threshold": 0.60, "statistical": 0.45, "rate": 0.35}
SCORE_BANDS = [(0.85, "CRITICAL"), (0.60, "WARNING"), (0.35, "WATCH")]
Z_ONSET = 1.5
Z_SPAN = 1.5
COMPONENT_TRIGGER = 0.5
SCORE_SENTENCES = {
    "critical": "Value crossed a critical water-quality threshold.",
    "threshold_statistical": "Value is outside the allowed range and significantly different from recent behavior.",
    "threshold": "Value is outside the allowed water-quality range.",
    "statistical": "Value is statistically unusual compared with recent readings.",
    "rate": "Value changed faster than expected in the recent window.",
    "default": "Reading is consistent with the recent sensor pattern.",
}

# --- fixed values: risk model ----------------------------------------------------------------
RISK_BANDS = [("LOW", 0.0, 0.35), ("MEDIUM", 0.35, 0.60), ("HIGH", 0.60, 0.85), ("CRITICAL", 0.85, 1.01)]
NORMAL_CLASS = "normal"
NO_EVENT = "none"
LOW_RISK_SENTENCE = "Model sees low near-term degradation risk from the recent readings."
SCENARIO_CLASSES = (
    "normal",
    "storm_runoff",
    "oxygen_depletion",
    "chemical_shift",
    "sensor_fault",
    "gradual_degradation",
)
MODEL_NAME = "early_warning_random_forest"
MODEL_VERSION = "synthetic-rf-v1"
FEATURE_WINDOW = "5 minutes"
HORIZON_MINUTES = 10
FOREST = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 10, "seed": 42}

# --- fixed values: limits --------------------------------------------------------------------
MAX_PAGE = 500
RECENT_INTERVAL = "5 minutes"
COOLDOWN_SECONDS = 300
WATERMARK = "10 minutes"

# --- fixed values: notification texts --------------------------------------------------------
MAIL_TITLE = "Water quality alert"
CHAT_TITLE = "Water Quality Alert"
UNKNOWN = "unknown"
