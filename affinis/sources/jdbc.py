"""Tables in a relational database, by Spark's JDBC source; a driver jar must be on the class path."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Table:
    """Where a table is, and how much moves at once."""

    url: str
    name: str
    user: str | None = None
    password: str | None = None
    fetch: int = 10_000
    batch: int = 1_000
    #: Column types of a table that is to be made, as in SQL; Spark's own where none are given.
    types: str | None = None

    def options(self) -> dict[str, str]:
        given = {"url": self.url, "dbtable": self.name, "user": self.user, "password": self.password, "fetchsize": str(self.fetch), "batchsize": str(self.batch), "createTableColumnTypes": self.types}
        return {k: v for k, v in given.items() if v is not None}


def read(spark: SparkSession, table: Table, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """The table; filters, columns and counts are pushed down. ``split`` is a numeric column, its bounds and the number of parts."""
    reader = spark.read.format("jdbc").options(**table.options())
    if split:
        column, low, high, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def write(rows: DataFrame, table: Table, mode: str = "append") -> None:
    rows.write.format("jdbc").options(**table.options()).mode(mode).save()


def upsert(spark: SparkSession, table: Table, new: DataFrame, key: str) -> None:
    """Replaces the rows of ``new``'s keys and adds the others.

    The merged table is written beside the old one first, and only then put in its place within one transaction of the database: a failure before leaves
    the old table as it was.
    """
    from affinis.operators.sets import upsert as merged

    beside = replace(table, name=f"{table.name}_next")
    write(merged(read(spark, table), new, key), beside, "overwrite")
    names = ", ".join(f'"{c}"' for c in new.columns)
    statements = [f"DELETE FROM {table.name}", f"INSERT INTO {table.name} ({names}) SELECT {names} FROM {beside.name}"]
    execute(spark, table, statements)
    execute(spark, table, [f"DROP TABLE {beside.name}"])


def execute(spark: SparkSession, table: Table, statements: list[str]) -> None:
    """Runs ``statements`` in one transaction, on the driver's connection."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(table.url, table.user, table.password) if table.user else spark.sparkContext._jvm.java.sql.DriverManager.getConnection(table.url)
    try:
        connection.setAutoCommit(False)
        run = connection.createStatement()
        for s in statements:
            run.execute(s)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def of_type(spark: SparkSession, table: Table, label: str, column: str = "type_label") -> DataFrame:
    """Rows of one descriptor type; the filter runs in the database."""
    return read(spark, table).where(F.col(column) == label)
