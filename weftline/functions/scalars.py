"""Scalar functions as column expressions: texts, numbers, boxes and vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clip of probabilities under a logarithm.
LOG_CLIP = 1e-15


def strip(c: Column) -> Column:
    """Without any white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) == "", None).otherwise(c)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def kit_of(item_id: Column) -> Column:
    """The part before the last underscore, or the whole id."""
    return F.when(item_id.contains("_"), F.regexp_extract(item_id, r"^(.*)_[^_]*$", 1)).otherwise(item_id)


def slot_of(item_id: Column) -> Column:
    """The whole number after the last underscore, else null."""
    tail = F.regexp_extract(item_id, r"_([^_]*)$", 1)
    return F.when(tail.rlike(r"^[+-]?\d+$"), tail.try_cast("int"))


def label_text(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def sentence_case(c: Column) -> Column:
    t = strip(c)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def joined_vi(values: Column) -> Column:
    """Distinct values as "a, b và c"."""
    v = F.array_distinct(values)
    n = F.size(v)
    return F.when(n == 0, "").when(n == 1, F.try_element_at(v, F.lit(1))).otherwise(F.concat(F.array_join(F.slice(v, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" và "), F.try_element_at(v, F.lit(-1))))


def parsed_bool(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), F.coalesce(c, F.lit("null")))))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def log_loss(p: Column, label: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(LOG_CLIP)), F.lit(1 - LOG_CLIP))
    return -F.when(label == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q))


def percent_score(p: Column) -> Column:
    """floor(100 p + 0.5), from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(p * F.lit(100.0) + F.lit(0.5)))).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it: inside a lambda an expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def length(v: Column) -> Column:
    return bound(v, lambda w: F.sqrt(dot(w, w)))


def unit(v: Column) -> Column:
    """The vector of length 1; null for vectors that are too short or not finite."""
    return bound(v, lambda w: bound(F.sqrt(dot(w, w)), lambda n: F.when(finite(n) & (n > F.lit(1e-12)), F.transform(w, lambda x: x / n))))


def wide(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def vector_sum(vectors: Column, dim: int) -> Column:
    return F.aggregate(vectors, F.array_repeat(F.lit(0.0), dim), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def expanded_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, ratio: float) -> dict[str, Column]:
    """The box grown by ratio of its sides, rounded outwards, inside the image and one pixel wide at least."""
    dx, dy = (x2 - x1) * F.lit(ratio), (y2 - y1) * F.lit(ratio)
    left = F.greatest(F.lit(0), F.least(F.floor(x1 - dx), width - 1))
    top = F.greatest(F.lit(0), F.least(F.floor(y1 - dy), height - 1))
    right = F.least(width, F.greatest(F.ceil(x2 + dx), left + 1))
    bottom = F.least(height, F.greatest(F.ceil(y2 + dy), top + 1))
    return {"left": left, "top": top, "right": right, "bottom": bottom}


def valid_box(*sides: Column) -> Column:
    x1, y1, x2, y2 = sides
    return finite(x1) & finite(y1) & finite(x2) & finite(y2) & (x2 > x1) & (y2 > y1)


def image_url(base: str, item_id: Column) -> Column:
    """base/id with all reserved characters percent-encoded, spaces as %20."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.url_encode(item_id), F.lit("+"), F.lit("%20")))


def media_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(suffix == "png", "image/png").when(suffix == "webp", "image/webp").otherwise("image/jpeg")


def pair_count(n: Column) -> Column:
    return n * (n - 1) / F.lit(2.0)
