"""Word lists, patterns and thresholds that decide results.

They are stated plainly because two engines only agree when these agree.
"""

# Placeholder words that stand for "no value" (compared stripped and lower-cased).
TEXT_SENTINELS = (
    "?", "??", "???", "na", "n/a", "none", "null", "nil", "unknown",
    "missing", "nan", "undefined", "#n/a", "#value!", "#ref!", "test", "xxx", "-",
)

# Placeholder numbers that stand for "no value".
NUMERIC_SENTINELS = (-999, -9999, -1, 999, 9999, 99999, 8888, -99, 99)

# The smaller sets that the default repair nulls out.
REPAIR_TEXT_SENTINELS = (
    "?", "??", "na", "n/a", "none", "null", "unknown", "missing",
    "#n/a", "#value!", "-", " ",
)
REPAIR_NUMERIC_SENTINELS = (-999, -9999, 9999, 99999)

# Column-name fragments.
KEY_FRAGMENTS = ("_id", "id_", "identifier", "uuid", "guid", "key", "pk")
KEY_NAMES = ("id", "pk", "ssn", "email", "phone")
AGE_FRAGMENTS = ("age", "years_old", "patient_age")
MONEY_FRAGMENTS = (
    "income", "salary", "price", "loan_amount", "charges", "revenue", "fare", "cost", "budget",
)
BIOMETRIC_FRAGMENTS = ("bp", "blood_pressure", "bmi")

# Column-name endings that mark a likely target.
BALANCE_TARGET_ENDINGS = (
    "status", "target", "label", "flag", "class", "churn", "default", "approved", "readmitted",
)
LEAKAGE_TARGET_ENDINGS = (
    "status", "target", "label", "flag", "class", "churn", "default", "approved",
)

# Text shapes.
CURRENCY_PATTERN = r"^[\$€£¥₹]?\s*-?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?$"
DATE_PATTERN = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$|^\d{1,2}[-/]\d{1,2}[-/]\d{4}$"
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CURRENCY_NOISE = r"[\$€£¥₹\s%,]"

# Everything Python's str.strip() treats as white space.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      "
    "          　"
)

# Text that a delimited-file reader turns into a null.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Date layouts tried in order when text becomes a timestamp.
DATE_LAYOUTS = ("yyyy-M-d", "yyyy/M/d")
DAY_FIRST_LAYOUTS = ("d-M-yyyy", "d/M/yyyy")
MONTH_FIRST_LAYOUTS = ("M-d-yyyy", "M/d/yyyy")

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")

# Dimension -> (weight, checkers).
DIMENSIONS = {
    "Completeness": (0.25, ("missing_values",)),
    "Uniqueness": (0.15, ("duplicate_rows",)),
    "Validity": (0.20, ("outliers", "constant_columns", "suspicious_values")),
    "Consistency": (0.15, ("high_correlation", "data_types")),
    "ML Readiness": (0.25, ("class_imbalance", "data_leakage")),
}

GRADES = ((95.0, "A+"), (90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D"))
