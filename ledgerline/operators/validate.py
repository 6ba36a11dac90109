"""Row validators and schema assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts


def quoted(c: str) -> str:
    """A column name in SQL: dots and backticks in it count as characters."""
    return "`" + c.replace("`", "``") + "`"


def named(c: str) -> Column:
    return F.col(quoted(c))


def missing(c: str) -> Column:
    """Null, or NaN on floating columns."""
    return named(c).isNull() | (F.typeof(named(c)).isin("float", "double") & (named(c).cast("string") == "NaN"))


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def _outside(c: str, lo: float, hi: float) -> Column:
    return ~F.coalesce(F.col(c).between(lo, hi), F.lit(False))


def rules(table: str) -> dict[str, Column]:
    """Violations by name: true where a row breaks the rule."""
    col = F.col
    if table == "candles":
        return {"close": ~F.coalesce(col("close") > 0, F.lit(False)), "volume": ~F.coalesce(col("volume") >= 0, F.lit(False))}
    if table == "news":
        return {
            "asset_id": blank("asset_id"),
            "published_at": col("published_at").isNull(),
            "headline": col("headline").isNull(),
            "summary": col("summary").isNull(),
            "source": blank("source"),
            "url": ~blank("url") & ~F.trim("url").rlike("^https?://"),
            "language": col("language").isNotNull() & ~texts.is_language_code(col("language")),
        }
    if table == "scored_news":
        return {
            "article_id": blank("article_id"),
            "asset_id": blank("asset_id"),
            "sentiment_score": _outside("sentiment_score", -1, 1),
            "confidence": col("confidence").isNotNull() & _outside("confidence", 0, 1),
            "model_name": col("model_name").isNotNull() & blank("model_name"),
        }
    if table == "daily_sentiment":
        return {
            "sentiment_score": _outside("sentiment_score", -1, 1),
            "n_articles": ~F.coalesce(col("n_articles") > 0, F.lit(False)),
            "sentiment_std": col("sentiment_std") < 0,
        }
    if table == "fundamentals":
        return {"asset_id": blank("asset_id"), "report_type": ~F.coalesce(col("report_type").isin("annual", "quarterly"), F.lit(False))}
    if table == "indicator_sets":
        return {"indicators": F.coalesce(F.size("indicators") < 1, F.lit(True))}
    raise KeyError(table)


def violations(df: DataFrame, table: str) -> DataFrame:
    """df with the names of the broken rules of each row."""
    broken = [F.when(v, F.lit(name)) for name, v in rules(table).items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their violations."""
    marked = violations(df, table)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def strict(df: DataFrame, table: str) -> DataFrame:
    """df that fails when a row is computed that breaks a rule."""
    marked = violations(df, table)
    fine = F.size("violations") == 0
    checked = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{table}: "), F.array_join("violations", ", "))))
    return marked.filter(checked).drop("violations")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def conform(df: DataFrame, schema: T.StructType, extras: bool = False) -> DataFrame:
    """Declared columns in order and cast; with extras the others behind them."""
    require_columns(df, schema.fieldNames())
    more = [c for c in df.columns if c not in schema.fieldNames()] if extras else []
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields), *more)


def require_ids(df: DataFrame, column: str = "article_id") -> DataFrame:
    """df that fails when a row with a blank id is computed."""
    return df.filter(F.when(~blank(column), F.lit(True)).otherwise(F.raise_error(F.lit(f"blank {column}"))))
