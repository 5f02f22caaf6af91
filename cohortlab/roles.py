"""Column roles, rule tables and label bands.

Operators never name columns themselves; they receive a :class:`Roles` and
rule lists.  ``ENTITY`` is the configuration for the entity view built from
the TPC-H-like tables (``cohortlab.sources.fixtures.entity_view``).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RangeRule:
    """``value`` is *outside* when it is not null and below ``lo`` / above ``hi``.

    ``lo_open`` makes the lower bound exclusive (``x <= lo`` is outside).
    ``action`` is ``drop`` (row removed), ``clip`` (raised to ``lo``) or
    ``flag`` (reported only).
    """

    name: str
    column: str
    lo: float | None = None
    hi: float | None = None
    action: str = "flag"
    lo_open: bool = False
    decision: str = ""


@dataclass(frozen=True)
class Roles:
    id: str
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    drop: tuple[str, ...] = ()
    regression_target: str | None = None
    canonical_column: str | None = None
    canonical_map: dict[str, str] = field(default_factory=dict)
    title_columns: tuple[str, ...] = ()
    ordinal_column: str | None = None
    ordinal_order: tuple[str, ...] = ()
    rules: tuple[RangeRule, ...] = ()

    @property
    def drop_rules(self) -> tuple[RangeRule, ...]:
        return tuple(r for r in self.rules if r.action == "drop")

    @property
    def clip_rules(self) -> tuple[RangeRule, ...]:
        return tuple(r for r in self.rules if r.action == "clip")

    def tree_features(self) -> list[str]:
        skip = {self.id, self.target, *self.drop}
        return [c for c in (*self.numeric, *self.categorical) if c not in skip]

    def regression_features(self) -> list[str]:
        skip = {self.id, self.target, self.regression_target, *self.drop}
        return [c for c in (*self.numeric, *self.categorical) if c not in skip]


# ---------------------------------------------------------------------------
# FIXED VALUES — thresholds and labels that the analysis reports use.
# Band rules are (lower bound, label) pairs checked top-down, first hit wins;
# the last label is the default.
# ---------------------------------------------------------------------------
BAND_MISSING_PCT = ((5.0, "high"), (2.0, "moderate"), (None, "low"))
BAND_CORR_TARGET = ((0.5, "strong"), (0.3, "moderate"), (None, "weak"))
BAND_CORR_PAIR = ((0.7, "high"), (0.5, "moderate"), (None, "low"))
BAND_RATE = ((30.0, "high"), (15.0, "moderate"), (None, "low"))
BAND_IMPORTANCE = ((10.0, "high"), (5.0, "moderate"), (None, "low"))  # inclusive bounds
BAND_CLUSTER_RATE = ((40.0, "high"), (20.0, "moderate"), (None, "low"))
BAND_SEGMENT_RATE = ((60.0, "high"), (40.0, "moderate"), (None, "low"))
BAND_VIF = ((10.0, "High"), (5.0, "Moderate"), (None, "Low"))  # inclusive bounds
BAND_SHRINKAGE = ((1000.0, "high"), (100.0, "moderate"), (None, "low"))
R2_GAP_LIMIT = 0.05
# Engineered features: name -> (numerator, denominator, offset of the denominator, floor).
ENGINEERED = {
    "salary_per_tenure": ("gross", "tenure", 1.0, None),
    "overtime_to_satisfaction_ratio": ("qty", "tax", 1.0, None),
    "promotion_rate": ("n_lines", "tenure", 1.0, None),
    "absence_to_tenure_ratio": ("supps", "tenure", 1.0, None),
}
TARGET_DERIVED = ("salary_per_tenure",)  # made from the regression target
NOT_SUITABLE = "Not suitable, chaining detected"
SUITABLE = "Suitable"
P_SIGNIFICANT = 0.05
DEPTH_GAP_BANDS = ((0.05, "high"), (0.02, "moderate"), (None, "low"))
SILHOUETTE_GOOD = 0.15
BALANCE_BANDS = ((2.0, "balanced"), (4.0, "moderate"))  # max/min size below bound
CHAINING_SHARE = 0.8
GAP_BANDS = ((-5000.0, "severe"), (0.0, "underpaid"))  # salary gap below bound

SEGMENT_NAMES = {"stable": "Stable Performers", "outlier": "Outlier Pair", "risk": "Flight Risk"}
SEGMENT_INTERVENTIONS = {
    "stable": "Retention programs and career pathing to sustain engagement",
    "outlier": "Individual case review — investigate anomalous profiles",
    "risk": "Urgent re-engagement: satisfaction surveys, salary review, workload audit",
}
ALPHA_GRID = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
L1_RATIO_GRID = (0.1, 0.25, 0.5, 0.75, 0.9)
LASSO_PATH_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
CV_FOLDS = 5
TEST_FRACTION = 0.3
SPLIT_SEED = 42
SAMPLE_SIZE = 300
NUM_CLUSTERS = 3
NUM_CELLS = 300  # weighted cells of the linkage; they hold all rows
SILHOUETTE_CELLS = 4096
NEIGHBOUR_RADIUS = 0.35
PRUNED_DEPTH = 4
TOP_N = 10
LINKAGE_METHODS = ("average", "complete", "ward")
DISTANCE_METRICS = ("euclidean", "manhattan")

# ---------------------------------------------------------------------------
# FIXED VALUES — configuration of the entity view over the TPC-H-like tables.
# The department column is a dirtied copy of the market segment; this map
# sends each spelling to one canonical name (the ``X-`` variants stay unmapped).
# ---------------------------------------------------------------------------
ENTITY_CANONICAL_MAP = {
    "AUTOMOBILE": "Automobile", "AUTOMOBILES": "Automobile", "automobile": "Automobile", "AUT": "Automobile",
    "BUILDING": "Building", "BUILDINGS": "Building", "building": "Building", "BUI": "Building",
    "FURNITURE": "Furniture", "FURNITURES": "Furniture", "furniture": "Furniture", "FUR": "Furniture",
    "HOUSEHOLD": "Household", "HOUSEHOLDS": "Household", "household": "Household", "HOU": "Household",
    "MACHINERY": "Machinery", "MACHINERYS": "Machinery", "machinery": "Machinery", "MAC": "Machinery",
}
ENTITY_SHIFT_ORDER = ("1-Urgent", "2-High", "3-Medium", "4-Not Specified", "5-Low")
ENTITY_RULES = (
    RangeRule("balance", "balance", lo=0.0, hi=9900.0, action="drop", decision="Drop rows (balance < 0 or > 9900)"),
    RangeRule("gross_low", "gross", lo=0.0, action="drop", lo_open=True, decision="Drop rows (gross <= 0)"),
    RangeRule("gross_high", "gross", hi=500000.0, action="drop", decision="Drop rows (gross > 500,000)"),
    RangeRule("supps", "supps", lo=0.0, action="clip", decision="Clip to 0 (negative supplier count)"),
    RangeRule("tenure", "tenure", lo=0.0, action="clip", decision="Clip to 0 (negative tenure)"),
    RangeRule("disc", "disc", lo=1.05, hi=8.95, action="flag", decision="Report only"),
    RangeRule("tax", "tax", lo=0.0, hi=8.05, action="flag", decision="Report only"),
)
ENTITY = Roles(
    id="id",
    target="target",
    numeric=("balance", "gross", "tenure", "n_lines", "qty", "disc", "tax", "parts", "supps"),
    categorical=("department", "region", "emp_type", "shift"),
    drop=("hired",),
    regression_target="gross",
    canonical_column="department",
    canonical_map=ENTITY_CANONICAL_MAP,
    title_columns=("region", "emp_type", "shift"),
    ordinal_column="shift",
    ordinal_order=ENTITY_SHIFT_ORDER,
    rules=ENTITY_RULES,
)
# Feature groups used by the profile / clustering / correlation reports.
ENTITY_CLUSTER_FEATURES = ("gross", "disc", "tax", "balance", "tenure", "supps", "qty", "n_lines")
ENTITY_CORR_COLUMNS = ("gross", "tenure", "shift_rank", "n_lines", "qty")
ENTITY_PROFILE_MEANS = ("gross", "tax", "supps", "tenure")
# A hypothetical entity traced through the pruned tree (feature -> value).
ENTITY_PROBE = {
    "balance": 4200.0, "gross": 160000.0, "tenure": 3.0, "n_lines": 4.0, "qty": 100.0, "disc": 5.0,
    "tax": 4.0, "parts": 4.0, "supps": 4.0, "department": 3.0, "region": 7.0, "emp_type": 1.0, "shift": 2.0,
}
