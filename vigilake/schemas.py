"""Column layouts of the state tables, as DDL strings."""

TABLES = "source_uri string, uri string, name string, db_name string, schema_name string"
FILES = "source_uri string, uri string, name string, filetype string, file_encoding string"
FIELDS = "owner_uri string, uri string, name string, type string"
METRICS = "uri string, ts timestamp, metric_name string, metric_value double"
SCANS = "scan_id bigint, source_uri string, server string, scan_time timestamp, last_modified timestamp"
SNAPSHOTS = (
    "scan_id bigint, source_uri string, object_uri string, kind string, columns map<string,string>"
)
CHANGES = (
    "scan_id bigint, source_uri string, ts timestamp, object_uri string, "
    "change_type string, severity string, detail string"
)
ARRIVALS = "source_uri string, fileset string, file_name string, mtime timestamp"

EMPTY_COLUMNS = "cast(map() as map<string,string>)"
