"""Writers: CSV with fixed formats, scoped replacement, run records, reports, audits, subsets."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed(column: str, places: int) -> Column:
    """A number as text with so many decimals; null as empty text."""
    return F.coalesce(F.format_string(f"%.{places}f", F.col(column).cast("double")), F.lit(""))


def write_csv(df: DataFrame, path: str, formats: dict[str, int] | None = None, by: list[str] | None = None) -> None:
    """CSV files with a header, numbers in fixed formats, in folders by the columns of ``by``."""
    out = df.select(*[fixed(c, formats[c]).alias(c) if formats and c in formats else F.col(c) for c in df.columns])
    writer = out.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def replace_scope(df: DataFrame, path: str, scope: list[str], scopes: DataFrame | None = None) -> None:
    """Replace the partitions of the scopes in ``df``, and of those in ``scopes``, and leave the others.

    A scope of ``scopes`` without a row in ``df`` loses its folder, after the rows are written. What must change in one step is a
    ``versions.VersionedTable``.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)
    if scopes is not None:
        spark = df.sparkSession
        gone = scopes.select(*scope).distinct().join(df.select(*scope).distinct(), [scopes[c].eqNullSafe(df[c]) for c in scope], "left_anti")
        catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        for row in gone.toLocalIterator():
            folder = spark._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *[catalog.getPartitionPathString(c, None if row[c] is None else str(row[c])) for c in scope]]))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append_run(spark: SparkSession, path: str, record: dict[str, object]) -> None:
    """One row of run metadata: keys and values as text, parameters as JSON."""
    row = {k: json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else None if v is None else str(v) for k, v in record.items()}
    spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row)).write.mode("append").parquet(path)


def key_values(spark: SparkSession, record: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in record.items()], "key string, value string")


def run_id(*parts: object) -> str:
    """A stable id of a run or route from what determines it."""
    return hashlib.sha1("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def policy_text(**policy: object) -> str:
    """key=value pairs, sorted, joined by bars."""
    return "|".join(f"{k}={policy[k]}" for k in sorted(policy))


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as a Markdown report; more than ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cells = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return f"# {title}\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in cells) + "\n"


def json_report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as a JSON report; more than ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return json.dumps({"title": title, "rows": [r.asDict(recursive=True) for r in rows]}, indent=2, sort_keys=True, default=str)


def dated_name(path: str, date: str | None = None) -> str:
    """The path with _yyyy-mm-dd before its ending (.sqlite) or after its name; today's date in UTC unless given."""
    date = date or datetime.now(timezone.utc).date().isoformat()
    stem, dot, ending = path.rpartition(".")
    return f"{stem}_{date}.{ending}" if dot and ending.lower() == "sqlite" else f"{path}_{date}"


def write_top_tables(top: DataFrame, path: str) -> None:
    """The ranked rings and their flags, each written whole in place of the last run's: ``path/ranked`` and ``path/flags``."""
    top.write.mode("overwrite").parquet(f"{path}/ranked")
    written = top.sparkSession.read.parquet(f"{path}/ranked")
    written.select("system_name", "body_name", "ring_name", F.col("category").alias("top_category"), F.col("rank").alias("top_rank"), F.lit(1).alias("is_top")).write.mode("overwrite").parquet(f"{path}/flags")


def audit(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, column, type) of every column."""
    return [(name, c, kind) for name, df in sorted(tables.items()) for c, kind in df.dtypes]


def probe_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int = 5) -> DataFrame:
    """A few rows of a join by the first key that both sides have: shows whether the path joins at all."""
    for key in keys:
        if key in left.columns and key in right.columns:
            return left.join(right, key).limit(rows)
    raise ValueError(f"no common column among {', '.join(keys)}")


def subset(tables: dict[str, DataFrame], systems: DataFrame, key: str = "system_name", small: int = 1000) -> dict[str, DataFrame]:
    """Tables cut down to some systems; one without the key is kept whole if it is small, else left out."""
    chosen, out = systems.select(key).distinct(), {}
    for name, df in tables.items():
        if key in df.columns:
            out[name] = df.join(chosen, key, "left_semi")
        elif df.limit(small + 1).count() <= small:
            out[name] = df
    return out


def parse_k_map(text: str) -> dict[str, int]:
    """"E-inner=3,N-outer=5" as a map."""
    out = {}
    for part in (p.strip() for p in text.split(",")):
        if part:
            name, eq, k = part.partition("=")
            if not eq or not name.strip() or int(k) < 1:
                raise ValueError(f"not name=k: {part!r}")
            out[name.strip()] = int(k)
    return out


def parse_numbers(text: str, low: float | None = None, high: float | None = None) -> list[float]:
    """Comma-separated numbers, each within bounds."""
    out = [float(p) for p in text.split(",") if p.strip()]
    if not out or any((low is not None and v < low) or (high is not None and v > high) for v in out):
        raise ValueError(f"not numbers within bounds: {text!r}")
    return out
