"""Small inline tables that exist both as DataFrames and as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL = {"int": "INTEGER", "bigint": "BIGINT", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "array<double>": "DOUBLE[]"}


@dataclass(frozen=True)
class Fixture:
    """Columns with Spark types, and rows; dates are ISO strings."""

    schema: str
    rows: list[tuple]

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.strip().split(" ", 1)) for c in self.schema.split(",")]  # type: ignore[misc]

    def frame(self, spark: SparkSession) -> DataFrame:
        text = ", ".join(f"{n} {'string' if t == 'date' else t}" for n, t in self.columns)
        df = spark.createDataFrame(self.rows, text)
        return df.selectExpr(*(f"CAST(`{n}` AS DATE) AS `{n}`" if t == "date" else f"`{n}`" for n, t in self.columns))

    def sql(self) -> str:
        def literal(x) -> str:
            if x is None:
                return "NULL"
            if isinstance(x, bool):
                return str(x).upper()
            if isinstance(x, (list, tuple)):
                return "[" + ", ".join(map(literal, x)) + "]"
            return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

        names = ", ".join(f'"{n}"' for n, _ in self.columns)
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f'CAST("{n}" AS {_SQL[t]}) AS "{n}"' for n, t in self.columns)
        return f"(SELECT {casts} FROM (VALUES {values}) AS v({names}))"


@dataclass(frozen=True)
class Spread:
    """The rows of a fixture with ids from 1 on, in turn on all customers: numbers a little larger on each, up to a tenth, ids the customers' keys."""

    base: Fixture

    @property
    def _doubles(self) -> list[str]:
        return [n for n, t in self.base.columns if t == "double"]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("c_custkey")
        customers = spark.read.parquet(f"{sf_dir.rstrip('/')}/customer.parquet").select(key)
        rows = customers.join(F.broadcast(self.base.frame(spark)), key % len(self.base.rows) + 1 == F.col("id"))  # a few rows
        factor = F.lit(1.0) + (key % 97).cast("double") / F.lit(1000.0)
        return rows.select(key.cast("int").alias("id"), *((F.col(n) * factor).alias(n) if n in self._doubles else F.col(n) for n, _ in self.base.columns if n != "id"))

    def sql(self) -> str:
        factor = "(1 + CAST(c_custkey % 97 AS DOUBLE) / 1000)"
        columns = ", ".join(f'f."{n}" * {factor} AS "{n}"' if n in self._doubles else f'f."{n}"' for n, _ in self.base.columns if n != "id")
        return f"(SELECT CAST(c_custkey AS INTEGER) AS id, {columns} FROM customer JOIN {self.base.sql()} f ON c_custkey % {len(self.base.rows)} + 1 = f.id)"


@dataclass(frozen=True)
class Repeated:
    """All rows of a fixture for each supplier: ``keys`` become the supplier's own, numbers a little larger on each, up to a tenth, but for those in ``fixed``."""

    base: Fixture
    keys: tuple[str, ...]
    fixed: tuple[str, ...] = ()

    def _grows(self, name: str, kind: str) -> bool:
        return kind == "double" and name not in self.fixed

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = F.array(*(F.struct(*(F.lit(x).cast(t).alias(n) for x, (n, t) in zip(row, self.base.columns, strict=True))) for row in self.base.rows))
        supplier = spark.read.parquet(f"{sf_dir.rstrip('/')}/supplier.parquet").select(F.col("s_suppkey").alias("_s"))
        key, factor = F.col("_s"), F.lit(1.0) + (F.col("_s") % 97).cast("double") / F.lit(1000.0)
        own = {"string": lambda c: F.concat(c, F.lit("-"), key.cast("string")), "int": lambda c: (c + key * 100).cast("int")}
        value = lambda n, t: own[t](F.col(f"r.{n}")) if n in self.keys else F.col(f"r.{n}") * factor if self._grows(n, t) else F.col(f"r.{n}")
        return supplier.select("_s", F.explode(rows).alias("r")).select(*(value(n, t).alias(n) for n, t in self.base.columns))

    def sql(self) -> str:
        own = {"string": "f.\"{}\" || '-' || s_suppkey", "int": "CAST(f.\"{}\" + s_suppkey * 100 AS INTEGER)"}
        value = lambda n, t: own[t].format(n) if n in self.keys else f'f."{n}" * (1 + CAST(s_suppkey % 97 AS DOUBLE) / 1000)' if self._grows(n, t) else f'f."{n}"'
        return f"(SELECT {', '.join(f'{value(n, t)} AS "{n}"' for n, t in self.base.columns)} FROM supplier, {self.base.sql()} f)"
