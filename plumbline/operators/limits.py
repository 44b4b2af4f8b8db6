"""Every constant of the profiler. Results depend on them."""

TYPES = ("numeric", "categorical", "datetime", "boolean", "id", "text")

# type inference
MAJORITY = 0.9
TEXT_UNIQUE_RATIO = 0.5
TEXT_MEAN_LENGTH = 20
ID_UNIQUE_RATIO = 0.99
ID_MEAN_LENGTH = 36
ID_SPACE_RATIO = 0.1
SAMPLE_VALUES = 5

# statistics
TOP_VALUES = 10
MOST_BINS = 50
FINE_BINS = 256
DENSITY_POINTS = 64
DENSITY_LEAST = 5
DENSITY_CUTOFF = 4
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
EPSILON = 1e-12

# quality: the most a part can cost, the factor of its measure, and where its verdict turns
PENALTY_CAP = {"missing": 25, "duplicate": 15, "constant": 15, "cardinality": 15, "outlier": 15, "invalid": 15}
PENALTY_FACTOR = {"missing": 100, "duplicate": 300, "constant": 5, "cardinality": 5, "outlier": 300, "invalid": 500}
VERDICT = {"missing": (0.05, 0.2), "duplicate": (0.0, 0.05), "outlier": (0.01, 0.05), "invalid": (0.0, 0.01)}
BAD_SHARE = {"constant": 0.2, "cardinality": 0.5}
GRADES = (("good", 80), ("fair", 50), ("poor", 0))
WORST_COLUMNS = 5

# findings
MISSING_HIGH = 0.2
MISSING_IMPUTE = 0.05
MISSING_IMPUTE_SKEW = 1
DUPLICATE_ROWS = 1
CONSTANT_MODE = 0.95
HIGH_CARD_UNIQUE = 50
HIGH_CARD_RATIO = 0.5
ID_RATIO = 0.99
SKEW = 2
KURTOSIS = 7
OUTLIER_RATE = 0.05
OUTLIER_ACTION_RATE = 0.01
OUTLIER_ACTION_SKEW = 1
BIN_SENSITIVE_UNIQUE = 20
COLLINEAR_PEARSON = 0.8
COLLINEAR_VIF = 10
CAUSAL_PEARSON = 0.7
LEAKAGE_PEARSON = 0.95
CLASS_SHARE = 0.1
TARGET_SKEW = 1
SCALE_RATIO = 100

# recipes and display
ONE_HOT_LEVELS = 20
FILE_BYTES = 25 * 1024 * 1024
SHOWN_FINDINGS = 15
FINDINGS_PER_TYPE = 5
SHOWN_CHARTS = 8
SCATTER_PAIRS = 6
SCATTER_POINTS = 200
HEATMAP_COLUMNS = 20
SCHEMA_VERSION = "1.2"
