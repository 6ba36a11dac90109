"""News scoring and daily sentiment."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts, times
from . import keys, validate

Scorer = Callable[[list[str]], list[float]]


def daily_sentiment(scored: DataFrame) -> DataFrame:
    """Mean score, count and population deviation by asset and UTC day; confidence plays no part."""
    return scored.groupBy("asset_id", times.day_of(F.col("published_at")).alias("day")).agg(
        F.avg("sentiment_score").alias("sentiment_score"),
        F.count("*").alias("n_articles"),
        F.stddev_pop("sentiment_score").alias("sentiment_std"),
    )


def daily_moments(scored: DataFrame) -> DataFrame:
    """Count, mean and sum of squared deviations by asset and UTC day: parts that merged_moments() adds up."""
    n = F.count("sentiment_score")
    found = scored.groupBy("asset_id", times.day_of(F.col("published_at")).alias("day"))
    return found.agg(n.alias("n"), F.avg("sentiment_score").alias("mean"), (F.var_pop("sentiment_score") * n).alias("m2")).filter("n > 0")


def merged_moments(parts: DataFrame) -> DataFrame:
    """One row a day of several parts, in any order: pairwise merging of means and squares, stable for close values."""
    some = F.sort_array(F.collect_list(F.struct("n", "mean", "m2")))  # a part a batch

    def add(a: F.Column, b: F.Column) -> F.Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    both = parts.groupBy("asset_id", "day").agg(some.alias("p"))
    rest = F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0)))
    return both.select("asset_id", "day", F.aggregate(rest, F.col("p")[0], add).alias("m")).select("asset_id", "day", "m.*")


def sentiment_of(moments: DataFrame) -> DataFrame:
    """Daily sentiment of moments: the table that daily_sentiment() gives of all their articles."""
    return moments.select("asset_id", "day", F.col("mean").alias("sentiment_score"), F.col("n").alias("n_articles"), F.sqrt(F.col("m2") / F.col("n")).alias("sentiment_std"))


def checksum_scorer() -> Scorer:
    """A deterministic scorer for tests and dry runs: the text's digest spread over [-1, 1]."""
    return lambda batch: [int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 2001 / 1000 - 1 for t in batch]


def checksum_score(text: F.Column) -> F.Column:
    """The same scores as a column expression."""
    return F.conv(F.left(F.md5(F.encode(text, "UTF-8")), F.lit(6)), 16, 10).cast("long") % 2001 / 1000.0 - 1


def budgeted(sizes: list[int], most: int, budget: int | None) -> Iterator[list[int]]:
    """Places of texts dealt to batches: at most `most` a batch, and texts times the longest of them within the budget.

    With a budget, texts of like sizes go together, the longest first; one that alone exceeds the budget is a batch of its own.
    Without one, batches follow the order.
    """
    order = range(len(sizes)) if budget is None else sorted(range(len(sizes)), key=lambda i: -sizes[i])
    batch: list[int] = []
    for i in order:
        if batch and (len(batch) == most or (budget is not None and (len(batch) + 1) * sizes[batch[0]] > budget)):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def score_text(
    df: DataFrame,
    factory: Callable[[], Scorer],
    text: str = "text",
    model_name: str = "model",
    batch: int = 32,
    budget: int | None = None,
    size: Callable[[str], int] = len,
) -> DataFrame:
    """df with sentiment_score, confidence and model_name from a user's model.

    The model is built once a task from `factory` and called on lists of at most `batch` texts; with a budget also of at most
    that padded size (number of texts times the largest `size`), from the texts of one Arrow batch.  Scores stay with
    their rows, and rows in their order.  A null text has size 0.  A wrong number of scores fails the task.
    """
    if batch < 1 or (budget is not None and budget < 1):
        raise ValueError("batch and budget must be positive")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            values = frame[text].tolist()
            scores = [0.0] * len(values)
            sizes = [0 if v is None else size(v) for v in values] if budget is not None else [0] * len(values)
            for places in budgeted(sizes, batch, budget):
                part = scorer([values[i] for i in places])
                if len(part) != len(places):
                    raise ValueError("the scorer must return one score a text")
                for i, score in zip(places, part, strict=True):
                    scores[i] = score
            yield frame.assign(sentiment_score=pd.Series(scores, dtype=float, index=frame.index), confidence=pd.Series(scores, dtype=float, index=frame.index).abs(), model_name=model_name)

    return df.mapInPandas(run, f"{fields}, sentiment_score double, confidence double, model_name string")


def classify_text(df: DataFrame, factory: Callable[[], Callable[[str], str]], text: str = "text", error: str = "ERRO") -> DataFrame:
    """df with a `label` of each text; a row whose classification fails gets the error label."""
    validate.require_columns(df, [text])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = factory()

        def label(value):
            try:
                return str(classify(value))
            except Exception:  # any failure of a user's model on one row is that row's result
                return error

        for frame in frames:
            yield frame.assign(label=[label(v) for v in frame[text]])

    return df.mapInPandas(run, f"{fields}, label string")


def unscored(news: DataFrame, scored: DataFrame) -> DataFrame:
    """News whose article_id has no score yet, with the text to be scored."""
    todo = keys.not_in(validate.require_ids(news), keys.known_ids(scored, "article_id"), "article_id")
    return todo.withColumn("text", texts.scoring_text(F.col("headline"), F.col("summary")))


def score_news(news: DataFrame, scored: DataFrame, factory: Callable[[], Scorer], model_name: str, **batches) -> DataFrame:
    """Rows to add to the scored table: only news that isn't in it.  `batches` are score_text()'s bounds."""
    columns = ("asset_id", "article_id", "published_at", "text")
    return score_text(unscored(news, scored).select(*columns), factory, model_name=model_name, **batches).drop("text")


def accuracy(df: DataFrame, logits: str, label: str) -> DataFrame:
    return df.agg(F.avg((texts.argmax(F.col(logits)) == F.col(label)).cast("double")).alias("accuracy"))
