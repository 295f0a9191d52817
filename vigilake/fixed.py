"""Values that must keep exactly these texts and numbers for results to agree."""

# Regular expressions behind the file name tokens.
TOKEN_REGEX = {
    "date": r"\d{4}[-_.]?\d{2}[-_.]?\d{2}",
    "time": r"\d{2}[-_.:]?\d{2}[-_.:]?\d{2}",
    "seq": r"\d+",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
}

# What a file name's volatile parts are replaced with, in this order.
TEMPLATE_STEPS = [
    ("{uuid}", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("{date}{time}", r"\d{4}[-_.]?\d{2}[-_.]?\d{2}T?\d{2}[-_.:]?\d{2}[-_.:]?\d{2}"),
    ("{date}", r"\d{4}[-_.]?\d{2}[-_.]?\d{2}"),
    ("{time}", r"\d{2}[-_.:]\d{2}[-_.:]\d{2}"),
    ("{seq}", r"\d+"),
]

# Change types that break a consumer; every other type is "info".
BREAKING_CHANGES = [
    "table_removed",
    "column_removed",
    "column_type_changed",
    "file_schema_changed",
    "fileset_schema_changed",
    "fileset_overdue",
    "endpoint_removed",
    "schema_removed",
]

# Text that reads as an integer or as a number.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
NUMBER_TEXT = (
    r"^\s*[+-]?(([0-9]+(_[0-9]+)*)?\.?[0-9]+(_[0-9]+)*|[0-9]+(_[0-9]+)*\.)"
    r"(e[+-]?[0-9]+(_[0-9]+)*)?\s*$|^\s*[+-]?(nan|inf|infinity)\s*$"
)

# Operations an API path can carry.
HTTP_METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]

# Defaults of thresholds and of the caps that are part of a feature.
Z_THRESHOLD = 3.0
BAND_WIDTH = 0.8
MIN_ARRIVALS = 3
OVERDUE_FACTOR = 2.0
MIN_CLUSTER_SIZE = 2
SAMPLE_FILES = 10
SAMPLE_RATE = 100
ORACLE_PORT = 1521
MSSQL_PORT = 1433

# The lines that say what changed (printf formats).
CHANGE_TEXTS = {
    "column": "%s (%s)",
    "column_type_changed": "%s: %s -> %s",
    "reshaped": "column types changed",
    "fileset_reshaped": "fileset %s: %s",
    "unrecognized_file": "matches no declared fileset",
    "fileset_overdue": "no file since %s — expected a new one by %s (arrives ~every %.1fh)",
    "fileset_suggested": '%s files look like a fileset%s — declare name: %s, pattern: "%s"',
    "via": " (%s)",
    "columns": "%d column(s)",
}
