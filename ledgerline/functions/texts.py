"""Text columns: symbols, news fields, markup and class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " "


def symbol(name: Column) -> Column:
    """Upper-case part before the first dot."""
    return F.upper(F.split_part(name, F.lit("."), F.lit(1)))


def filled(text: Column) -> Column:
    """Trimmed text, null if empty."""
    return F.nullif(F.trim(text), F.lit(""))


def news_texts(headline: Column, summary: Column) -> tuple[Column, Column]:
    """Both trimmed, null as empty; both a blank if there is nothing in either."""
    h, s = F.coalesce(F.trim(headline), F.lit("")), F.coalesce(F.trim(summary), F.lit(""))
    nothing = (h == "") & (s == "")
    return F.when(nothing, BLANK).otherwise(h), F.when(nothing, BLANK).otherwise(s)


def source_or(source: Column, default: str) -> Column:
    return F.coalesce(filled(source), F.lit(default))


def article_id(given: Column, url: Column) -> Column:
    """The id, else the url, else null."""
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(url, F.lit("")))


def fallback_id(url: Column, time: Column, headline: Column) -> Column:
    """The url, else the time and the headline's first 80 characters."""
    return F.coalesce(filled(url), F.concat(time.cast("string"), F.lit(":"), F.left(headline, F.lit(80))))


def scoring_text(headline: Column, summary: Column) -> Column:
    """Trimmed non-empty parts joined by a blank; a blank if there are none."""
    joined = F.concat_ws(" ", filled(headline), filled(summary))
    return F.when(joined == "", BLANK).otherwise(joined)


def number(text: Column) -> Column:
    """A finite double; empty, None, null, NaN and unreadable texts become null."""
    value = F.when(~F.lower(F.trim(text)).isin("", "none", "null", "nan"), text.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def language_code(text: Column) -> Column:
    return F.lower(F.trim(text))


def is_language_code(text: Column) -> Column:
    """Letters of any script and hyphens only."""
    return language_code(text).rlike(r"^[\p{L}-]+$")


def between(text: Column, keyword: str, n: int, start: str, end: str) -> Column:
    """Trimmed text between two marks within part n of a split at keyword; null if anything is missing."""
    part = F.get(F.split(text, _quoted(keyword)), F.lit(n))
    at = F.instr(part, start)
    rest = F.when(at > 0, F.substring(part, at + len(start), F.length(part)))
    stop = F.instr(rest, end)
    return F.when(stop > 0, F.trim(F.substring(rest, F.lit(1), stop - 1)))


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def headings(html: Column) -> Column:
    """Array of (tag, text) of h1 to h3 elements in order."""
    pattern = r"(?is)<(h[1-3])\b[^>]*>(.*?)</h[1-3]>"
    tags, texts = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.zip_with(tags, texts, lambda a, b: F.struct(F.lower(a).alias("tag"), F.trim(F.regexp_replace(b, r"<[^>]*>", "")).alias("text")))


def joined(*parts: Column, separators: tuple[str, ...] = (". ", " ")) -> Column:
    """Parts with separators between them; null if any part is null."""
    out = parts[0]
    for i, p in enumerate(parts[1:]):
        out = F.concat(out, F.lit(separators[min(i, len(separators) - 1)]), p)
    return out


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def sentiment(logits: Column, classes: list[str]) -> tuple[Column, Column]:
    """Score, the positive less the negative probability, and confidence, its size."""
    p = softmax(logits)
    score = F.get(p, F.lit(classes.index("positive"))) - F.get(p, F.lit(classes.index("negative")))
    return score, F.abs(score)


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def label_of(values: Column, labels: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), argmax(values).cast("int"))
