"""Column expressions: scores, time intervals, predicates, identifiers.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECAY = 0.693
DAY = 86400.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / (DAY * 1e6)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; 0 where a vector is null or zero."""
    a, b = col(a), col(b)
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def importance_bucket(score: str | Column) -> Column:
    s = col(score)
    out = F.lit(0.0)
    for least, level in ((0.5, 1.0), (2, 3.0), (4, 5.0), (5.5, 6.0), (7, 8.0), (9, 10.0)):
        out = F.when(s >= least, F.lit(level)).otherwise(out)
    return out


def priority_importance(priority: str | Column) -> Column:
    """Importance of an edge from the order of its fact: later facts weigh more."""
    p = col(priority)
    return F.when(p >= 100, 10.0).when(p >= 50, 8.0).when(p >= 20, 6.0).otherwise(5.0)


def recency(age_days: str | Column, half_life: float = 30.0) -> Column:
    return F.exp(-DECAY * col(age_days) / half_life)


def frequency(n: str | Column, saturation: int = 100) -> Column:
    n = col(n)
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.lit(float(saturation)))))


def connectivity(degree: str | Column, cap: int = 50) -> Column:
    return F.least(F.lit(1.0), F.log1p(col(degree).cast("double")) / F.log1p(F.lit(float(cap))))


def clamp(c: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def node_importance(age_days: str | Column, accesses: str | Column, rank: str | Column, importance: str | Column) -> Column:
    return clamp(10 * (0.3 * recency(age_days) + 0.3 * frequency(accesses) + 0.2 * col(rank) + 0.2 * col(importance) / 10))


def edge_importance(age_days, accesses, weight, confidence, endpoints) -> Column:
    """endpoints: mean importance of the two nodes, 5 where one is missing."""
    return clamp(10 * (0.25 * recency(age_days) + 0.2 * frequency(accesses) + 0.2 * F.least(F.lit(1.0), col(weight) / 5) + 0.15 * col(confidence) + 0.2 * col(endpoints) / 10))


def node_strength(age_days, importance, accesses, half_life: float = 30.0) -> Column:
    slow = half_life * (0.5 + col(importance) / 20) * F.least(F.lit(1.0), 0.5 + F.log1p(col(accesses).cast("double")) / 10)
    return F.exp(-DECAY * col(age_days) / slow)


def edge_strength(age_days, weight, confidence, half_life: float = 30.0) -> Column:
    return F.exp(-DECAY * col(age_days) / F.greatest(F.lit(1.0), half_life * F.least(F.lit(1.0), col(weight) / 5) * col(confidence)))


def recent_boost(hours: str | Column) -> Column:
    h = col(hours)
    return F.coalesce(F.when(h < 24, 0.1 * (1 - h / 24)), F.lit(0.0))


def access_boost(n: str | Column) -> Column:
    return F.least(F.lit(0.1), 0.01 * F.coalesce(col(n), F.lit(0)))


def store_score(similarity, importance, hours, accesses) -> Column:
    return 0.60 * col(similarity) + 0.25 * col(importance) / 10 + recent_boost(hours) + access_boost(accesses)


def hybrid_score(similarity, importance, name_boost, hours, accesses) -> Column:
    return 0.5 * col(similarity) + 0.25 * col(importance) / 10 + 0.15 * (col(name_boost) * 3.33) + recent_boost(hours) + access_boost(accesses)


def valid_at(t, valid_from="valid_from", valid_until="valid_until", bounds: str = "closed") -> Column:
    """The interval holds t; a null bound is open.  bounds: closed, or halfopen without its end."""
    a, b = col(valid_from), col(valid_until)
    late = (b >= t) if bounds == "closed" else (b > t)
    return (a.isNull() | (a <= t)) & (b.isNull() | late)


def live_edge(importance="importance", state="state") -> Column:
    return (F.coalesce(col(importance), F.lit(5.0)) != 0) & ~F.coalesce(col(state), F.lit("ACTIVE")).isin("ARCHIVED", "DELETED")


def in_tenant(user_id: str, column="user_id") -> Column:
    return col(column).isNull() | (col(column) == user_id)


def valid_text(*columns: str) -> Column:
    return F.coalesce(*[F.col(c) for c in columns], F.lit("")).rlike(r"\S")


def matches_filters(filters: dict, properties="properties") -> Column:
    """AND of the filters; a property that a row lacks doesn't count against it."""
    out = F.lit(True)
    for key, value in filters.items():
        if key == "entity_type":
            out &= F.lower("entity_type") == str(value).lower()
        elif key == "min_importance":
            out &= F.col("importance") >= float(value)
        elif key == "state":
            out &= F.col("state") == value
        else:
            p = F.coalesce(col(properties), F.create_map().cast("map<string,string>"))
            out &= ~F.map_contains_key(p, key) | (p[key] == str(value))
    return out


def hash_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[col(p) for p in parts]), 256), 1, 16)


def strengthen(weight="weight", confidence="confidence", by: float = 1.1) -> tuple[Column, Column]:
    return F.least(F.lit(10.0), col(weight) * by), F.least(F.lit(1.0), col(confidence) * by)


def weaken(weight="weight", confidence="confidence", by: float = 0.9) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.1), col(weight) * by), F.greatest(F.lit(0.1), col(confidence) * by)


def tokens_of(text: str | Column) -> Column:
    """Estimated language-model tokens: a quarter of the characters."""
    return F.floor(F.length(col(text)) * 0.25)
