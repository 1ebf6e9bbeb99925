"""Vector, sparse and token-matrix similarities as column expressions.

Vectors are arrays of doubles. Undefined similarities (an empty vector, unequal lengths, a zero norm) are 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_raw(a: Column, b: Column) -> Column:
    """Cosine, clamped to [-1, 1]."""
    size = norm(a) * norm(b)
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), value).otherwise(ZERO)


def cosine(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; undefined similarities stay 0."""
    size = norm(a) * norm(b)
    defined = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0)
    return F.when(defined, (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)) + 1) / 2).otherwise(ZERO)


def cosine_strict(a: Column, b: Column) -> Column:
    """Raw cosine; unequal lengths are an error."""
    return F.when(F.assert_true(F.size(a) == F.size(b), F.lit("vectors of unequal lengths")).isNull(), cosine_raw(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays. The norm is taken once, as the element of an outer array, and not once a component."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


def from_distance(d: Column) -> Column:
    return F.greatest(F.lit(ZERO), F.least(F.lit(1.0), (2 - d) / 2))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets over their union; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(ZERO)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two maps term -> weight."""
    return total(F.transform(F.map_keys(a), lambda t: F.coalesce(a[t] * b[t], F.lit(ZERO))))


def sparse_cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(sparse_dot(a, a) * sparse_dot(b, b))
    return F.when(size > 0, sparse_dot(a, b) / size).otherwise(ZERO)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller weights over sum of larger ones, a missing term weighing 0."""
    terms = F.array_union(F.map_keys(a), F.map_keys(b))
    pick = lambda f: total(F.transform(terms, lambda t: f(F.coalesce(a[t], F.lit(ZERO)), F.coalesce(b[t], F.lit(ZERO)))))
    high = pick(F.greatest)
    return F.when(high > 0, pick(F.least) / high).otherwise(ZERO)


def max_sim(query: Column, doc: Column) -> Column:
    """Mean over query tokens of the best mapped cosine to a token of the document."""
    best = F.transform(query, lambda q: F.greatest(F.lit(ZERO), F.array_max(F.transform(doc, lambda d: cosine(q, d)))))
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), total(best) / F.size(query)).otherwise(ZERO)


def symmetric_max_sim(a: Column, b: Column) -> Column:
    return (max_sim(a, b) + max_sim(b, a)) / 2


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a))


def variance(v: Column) -> Column:
    """Population variance of the components."""
    mean = total(v) / F.size(v)
    return total(F.transform(v, lambda x: (x - mean) * (x - mean))) / F.size(v)
