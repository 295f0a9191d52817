"""Tables as sources: catalog crawl and reader options for databases and warehouses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilake.fixed import MSSQL_PORT, ORACLE_PORT
from vigilake.operators.profile import profile_query, scale_counts


def crawl_fields(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``owner_uri, name, type, uri`` of every column of the given tables (uri to table).

    Reads schemas only, no rows.
    """
    rows = [
        (uri, field.name, field.dataType.simpleString(), f"{uri}/{field.name}")
        for uri, df in tables.items()
        for field in df.schema.fields
    ]
    return spark.createDataFrame(rows, "owner_uri string, name string, type string, uri string")


def catalog_tables(spark: SparkSession, source: str, databases: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of a Spark catalog's databases, by address."""
    catalog = spark.catalog
    database = catalog.currentCatalog()
    names = databases or [d.name for d in catalog.listDatabases()]
    found = {}
    for schema in names:
        for table in catalog.listTables(schema):
            if not table.isTemporary:
                found[f"db://{source}/{database}/{schema}/{table.name}"] = spark.table(f"`{schema}`.`{table.name}`")
    return found


def reader_options(kind: str, connection: dict, database: str | None = None) -> tuple[str, dict]:
    """Format and options of ``spark.read`` for a database source, without the table.

    ``kind`` is ``database`` (any JDBC url prefix as ``drivername``), ``oracle``,
    ``mssql``, ``snowflake`` or ``bigquery``. The matching driver or connector must be
    on the cluster's class path.
    """
    c = connection
    login = {"user": c.get("username"), "password": c.get("password")}
    if kind == "database":
        port = f":{c['port']}" if c.get("port") else ""
        query = "&".join(f"{k}={v}" for k, v in sorted((c.get("options") or {}).items()))
        url = f"jdbc:{c['drivername']}://{c['host']}{port}/{database}" + (f"?{query}" if query else "")
        return "jdbc", {"url": url, **login}
    if kind == "oracle":
        url = f"jdbc:oracle:thin:@//{c['host']}:{c.get('port', ORACLE_PORT)}/{c['service_name']}"
        return "jdbc", {"url": url, **login}
    if kind == "mssql":
        url = f"jdbc:sqlserver://{c['host']}:{c.get('port', MSSQL_PORT)};databaseName={database}"
        return "jdbc", {"url": url, **login}
    if kind == "snowflake":
        return "snowflake", {
            "sfURL": f"{c['account']}.snowflakecomputing.com", "sfUser": c["user"], "sfPassword": c["password"],
            "sfDatabase": database, "sfRole": c.get("role"), "sfWarehouse": c.get("warehouse")}
    if kind == "bigquery":
        options = {"parentProject": c["project"], "dataset": database}
        if c.get("credentials_path"):
            options["credentialsFile"] = c["credentials_path"]
        return "bigquery", options
    raise NotImplementedError(f"source type not supported: {kind}")


def read_database_table(
    spark: SparkSession,
    kind: str,
    connection: dict,
    table: str,
    database: str | None = None,
    split: tuple[str, int, int, int] | None = None,
) -> DataFrame:
    """One table of a database source.

    ``split`` is (numeric column, lower, upper, partitions) and makes a JDBC read
    parallel; without it a JDBC table comes through one connection.
    """
    source_format, options = reader_options(kind, connection, database)
    reader = spark.read.format(source_format).options(**{k: v for k, v in options.items() if v is not None})
    if split and source_format == "jdbc":
        column, lower, upper, partitions = split
        reader = reader.options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.option("dbtable", table).load()


def sampled_table(kind: str, table: str, percent: float) -> str:
    """A table reference that lets the database draw the sample."""
    clauses = {
        "database": f"TABLESAMPLE SYSTEM ({percent:g})",
        "mssql": f"TABLESAMPLE ({percent:g} PERCENT)",
        "oracle": f"SAMPLE ({percent:g})",
        "snowflake": f"SAMPLE ({percent:g})",
        "bigquery": f"TABLESAMPLE SYSTEM ({percent:g} PERCENT)",
    }
    return f"{table} {clauses[kind]}"


def database_profile(
    spark: SparkSession, kind: str, connection: dict, table: str, schema, database: str | None = None,
    heavy: bool = False, sample_percent: float | None = None,
) -> DataFrame:
    """One-row profile of a table, computed by its database."""
    source_format, options = reader_options(kind, connection, database)
    target = sampled_table(kind, table, sample_percent) if sample_percent else table
    query = profile_query(schema, target, heavy, "`" if kind == "bigquery" else '"')
    stats = spark.read.format(source_format).options(
        **{k: v for k, v in options.items() if v is not None}).option("query", query).load()
    return scale_counts(stats, sample_percent)


def database_tables(
    spark: SparkSession, source: str, kind: str, connection: dict, database: str | None = None
) -> dict[str, DataFrame]:
    """All tables of a database source by address; only their schemas are read until they are used."""
    listed = read_database_table(spark, kind, connection, schema_listing_query(kind), database)
    label = database or connection.get("service_name", source)
    # One row per table of the database: a catalog's size, not the data's.
    return {
        f"db://{source}/{label}/{row[0]}/{row[1]}": read_database_table(spark, kind, connection, f"{row[0]}.{row[1]}", database)
        for row in listed.toLocalIterator()
    }


def schema_listing_query(kind: str) -> str:
    """Query that lists a JDBC database's tables as ``table_schema, table_name``."""
    if kind == "oracle":
        return "(select owner as table_schema, table_name from all_tables) t"
    return "(select table_schema, table_name from information_schema.tables where table_type = 'BASE TABLE') t"
