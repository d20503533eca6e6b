"""Fixed values.

Everything in this file is a lookup table, limit or label that decides a result: the check
names, the type vocabulary, the caps and the fixed texts of ``expected`` and ``actual``.
"""

# -- fixed values: type names -------------------------------------------------------------
TYPE_ALIASES = {
    "integer": "int",
    "int32": "int",
    "int64": "long",
    "bigint": "long",
    "string": "string",
    "str": "string",
    "varchar": "string",
    "text": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "double": "double",
    "float64": "double",
    "float": "float",
    "decimal": "decimal",
    "numeric": "decimal",
    "timestamp_ntz": "timestamp",
    "datetime": "timestamp",
    "date": "date",
}

# (contract type, received type) pairs that only warn
SAFE_PROMOTIONS = [("int", "long"), ("float", "double")]

INTEGER_TYPES = ["int", "long"]
FLOATING_TYPES = ["float", "double"]
NUMERIC_TYPES = ["int", "long", "float", "double", "decimal"]
TEMPORAL_TYPES = ["date", "timestamp"]

# -- fixed values: words ------------------------------------------------------------------
BOOLEAN_WORDS = ["true", "false", "1", "0", "yes", "no"]
INFERRED_BOOLEAN_WORDS = ["true", "false"]
TRUTHY_WORDS = ["true", "yes", "1", "required"]

# Every character that Unicode counts as white space, plus the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# -- fixed values: limits -----------------------------------------------------------------
ISSUE_CAP = 20
INFERENCE_ROWS = 100
REDACT_LENGTH = 80
REDACT_KEEP = 77
MAX_FILE_BYTES = 5 * 1024 * 1024
MAX_COLUMNS = 500
MAX_CONTRACT_COLUMNS = 500
MAX_DATA_ROWS = 1000
CHUNK_CHARS = 1000
EXCERPT_CHARS = 400
TOP_K = 3
FIRST_ROW = 2

DATA_SUFFIXES = ["csv", "json", "parquet"]
CONTRACT_SUFFIXES = ["yaml", "yml", "json"]

DEFAULT_CONTRACT_NAME = "unnamed-contract"
DEFAULT_VERSION = "0.1.0"
DEFAULT_OWNER = "unknown"
DEFAULT_TYPE = "string"
DEFAULT_QUERY_TEXT = "data contract guidelines"

# -- fixed values: severities and checks --------------------------------------------------
FAIL, WARN, INFO, PASS = "FAIL", "WARN", "INFO", "PASS"

RENAMED = "column.renamed"
MISSING = "column.missing"
PROMOTION = "type.promotion"
TYPE_CHANGE = "type.change"
EXTRA = "column.extra"
REQUIRED = "value.required"
ALLOWED = "value.allowed"
PATTERN = "value.pattern"
FORMAT = "value.format"
VALUE_TYPE = "value.type"
MINIMUM = "value.min"
MAXIMUM = "value.max"
UNIQUE = "value.unique"
ISSUE_LIMIT = "quality.issue_limit"

EXPECTED_NON_EMPTY = "non-empty value"

# check -> correction action
ACTIONS = {
    "column.renamed": "RENAME_SOURCE_COLUMN",
    "column.missing": "ADD_SOURCE_COLUMN",
    "type.promotion": "UPDATE_CONTRACT_TYPE",
    "type.change": "CAST_SOURCE_COLUMN",
    "column.extra": "ADD_CONTRACT_COLUMN",
    "value.required": "FILL_REQUIRED_VALUE",
    "value.allowed": "MAP_ALLOWED_VALUE",
    "value.pattern": "FIX_VALUE_PATTERN",
    "value.format": "NORMALIZE_DATE_FORMAT",
    "value.type": "CAST_OR_CLEAN_VALUE",
    "value.min": "ENFORCE_MIN_VALUE",
    "value.max": "ENFORCE_MAX_VALUE",
    "value.unique": "REMOVE_DUPLICATES",
}
