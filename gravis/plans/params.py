"""Parameters of the analyses, in one place.

The reference's constants are tuned to its data (a fatal share near 3%,
years 2020-2025, victim type CONDUTOR). The driver tables have a fatal share
near 33%, order years 1995-2001 and priorities for victim types, so the
constants below restate each rule for those tables; the rule itself is kept.
"""

# Year filter: the reference keeps six consecutive years of two extracts.
KEEP_YEARS = (1996, 1997, 1998, 1999, 2000)

# The two months the seasonal comparison names (December vs April).
MONTH_A, MONTH_B = 12, 4

# The day cluster compared against the rest of the month, and the days the
# daily ranking highlights.
DAY_CLUSTER = (24, 25, 26)
HIGHLIGHT_DAYS = (1, 20, 24, 25, 26)

# Victim type compared with the mean of all others (CONDUTOR in the reference).
CHOSEN_VICTIM = "1-URGENT"

# Top-k sizes used by the reports.
TOP_MONTHS, TOP_DAYS, TOP_DAYS_CHART = 3, 5, 10
TOP_MUNICIPALITIES, SAFEST_MUNICIPALITIES, TOP_INTERACTION = 10, 5, 5
TOP_FEATURES = 15

# Risk tiers in percent fatal, scaled from the reference's cuts around a 3%
# base rate to the 33% base rate here (about x11).
MONTH_TIER_CUTS, MONTH_TIER_LABELS = (34.0, 33.0), ("ALTO", "MEDIO", "BAIXO")
MUNICIPAL_TIER_CUTS, MUNICIPAL_TIER_LABELS = (35.0, 33.0), ("ALTO", "MEDIO", "BAIXO")
VICTIM_TIER_CUTS, VICTIM_TIER_LABELS = (33.5, 32.5), ("EXTREMO", "ALTO", "MODERADO")
IMPORTANCE_TIER_CUTS, IMPORTANCE_TIER_LABELS = (20.0, 10.0, 5.0), ("CRITICA", "ALTA", "MEDIA", "BAIXA")

# Minimum cases of a municipality for a reliable rate (100 in the reference; a
# nation holds 401-752 cases at sf0.01, where 600 leaves some out).
MIN_SUPPORT = 600

# Municipal outliers: fatal percent above the cut, or more cases than
# OUTLIER_TOTAL (3000 on the reference's volume).
OUTLIER_RATE_PCT = 36.0
OUTLIER_TOTAL = 700

# Worst municipalities that a chart highlights, and the rate from which a victim
# type is highlighted (90 in the reference, on a class of about 87 %; a third here).
WORST_MUNICIPALITIES = 3
VICTIM_FLAG_PCT = 33.5
# Age bands in a box chart: the most frequent ones.
TOP_BANDS = 6
# Variables beside the target in the correlation matrix of the strongest ones.
TOP_CORRELATED = 10

# Equal-width histogram bins (age, municipal rate).
AGE_BINS, RATE_BINS = 30, 15

# Density grid points for the age curve.
DENSITY_POINTS = 200

# Machine learning.
SEED = 42
TEST_FRACTION = 0.2
THRESHOLD_RULE_REFERENCE = (("LEVE", 0.3), ("GRAVE", 0.3))  # as the reference runs it (Q1)
THRESHOLD_RULE_INTENDED = (("FATAL", 0.3), ("GRAVE", 0.3))  # as its comment describes
THRESHOLD_DEFAULT_REFERENCE = "FATAL"
THRESHOLD_DEFAULT_INTENDED = "LEVE"

# Random forest: 100 trees as the reference; its depth has no limit, Spark's
# trees go to 30 levels.
RF_TREES, RF_DEPTH = 100, 30

# The reference's grid (trees x depth x leaf size; its split-size axis has no
# Spark parameter, and "no depth limit" becomes Spark's maximum, 30).
REFERENCE_GRID = dict(trees=(50, 100, 200), depths=(30, 5, 10, 20), leaves=(1, 2, 4))
