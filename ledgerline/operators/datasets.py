"""Text dataset preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts


def labelled_texts(df: DataFrame, columns: tuple[str, str, str], label: str, names: dict[str, str]) -> DataFrame:
    """(text, label): title, synopsis and body joined, labels renamed, rows without any part left out."""
    mapping = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    value = F.coalesce(F.try_element_at(mapping, F.col(label)), F.col(label))
    return df.select(texts.joined(*map(F.col, columns)).alias("text"), value.alias("label")).filter("text is not null")


def split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """df with `part`, train or test: exactly floor(share * n) training rows, chosen by md5 of key and seed.

    The cut value is found by counting hash prefixes, then ranks within the one prefix that holds
    the cut, so that no task sorts the whole table.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    rows = df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))))
    prefix = F.substring("__h", 1, 4)
    sizes = rows.groupBy(prefix.alias("__p")).count()  # at most 65,536 rows
    before = F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    sizes = sizes.select("__p", before.alias("__before"), "count", F.floor(share * total).alias("__train"))
    rows = rows.withColumn("__p", prefix).join(F.broadcast(sizes), "__p")
    edge = (F.col("__before") < F.col("__train")) & (F.col("__before") + F.col("count") > F.col("__train"))
    cut = rows.filter(edge).withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("__h", key)))
    cut = cut.withColumn("part", F.when(F.col("__before") + F.col("__r") <= F.col("__train"), "train").otherwise("test"))
    plain = rows.filter(~edge).withColumn("part", F.when(F.col("__before") < F.col("__train"), "train").otherwise("test"))
    return plain.select(*df.columns, "part").unionByName(cut.select(*df.columns, "part"))


def content_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df's other columns, pos and line: trimmed lines that are neither blank, digits nor a bullet."""
    rows = df.select(*(c for c in df.columns if c != text), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line"))
    return rows.filter((F.col("line") != "") & ~F.col("line").rlike("^[0-9]+$") & ~F.col("line").isin("•", "·", "-", "*"))


def marked_items(df: DataFrame, html: str, prefix: str, required: list[str]) -> DataFrame:
    """Rows whose markup starts with a prefix and that have every required field."""
    return df.filter(F.col(html).startswith(prefix)).na.drop(subset=required)
