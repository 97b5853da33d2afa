"""Column expressions over names and language-model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemoria.functions.exprs import col

NAME_STOPWORDS = "the a an of and & inc ltd llc plc corp co company limited sa s.a. gmbh ag corporation incorporated enterprises holdings group".split()
TITLES = "dr mr ms mrs prof professor jr sr phd md the".split()
OVERLAP_STOPWORDS = "the dr mr ms mrs prof professor inc corp llc".split()
NOTHING = ("none", "n/a", "-", "", "null")
CAPITALISED = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
TITLED = r"\b((?:Dr\.|Mr\.|Ms\.|Mrs\.|Prof\.|CEO|CTO|CFO)\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clean_name(name) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(name), F.lit("")), r"\s+", " ")), r"^[ \"'“”‘’]+|[ \"'“”‘’]+$", "")


def entity_key(name) -> Column:
    return F.substring(F.regexp_replace(F.lower(clean_name(name)), "[^a-z0-9]", "_"), 1, 64)


def name_tokens(name) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(name), F.lit(""))), F.lit("[a-z0-9]+"), 0))
    return F.array_sort(F.array_except(found, words(NAME_STOPWORDS)))


def token_similarity(a, b) -> Column:
    """Jaccard of two token sets; 0.9 at least for a subset, 0.7 for an equal last token in order."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    score = both / F.size(F.array_union(a, b))
    score = F.when(both == F.least(F.size(a), F.size(b)), F.greatest(score, F.lit(0.9))).otherwise(score)
    score = F.when(F.array_max(a) == F.array_max(b), F.greatest(score, F.lit(0.7))).otherwise(score)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def last_name(name) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(name), F.lit("")), F.lit(r"\b[A-Za-z]{2,}\b"), 0)
    found = F.transform(found, F.lower)
    own = F.filter(found, lambda w: ~w.isin(*TITLES))
    return F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at(found, F.lit(-1)))


def share_last_name(a, b) -> Column:
    x = last_name(a)
    return F.coalesce((x == last_name(b)) & (F.length(x) >= 3), F.lit(False))


def significant_tokens(name) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(name), F.lit(""))), F.lit(r"\b[a-z]{2,}\b"), 0))
    return F.array_except(found, words(OVERLAP_STOPWORDS))


def aliases(text) -> Column:
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: ~F.lower(p).isin(*NOTHING))))


def temporal(text) -> Column:
    """None-words are null, ``present`` stays, else the first date or year, else the text in lower case."""
    t = F.lower(F.trim(col(text)))
    found = F.regexp_extract(t, r"(\d{4}(?:-\d{2}-\d{2})?)", 1)
    return F.when(t.isin(*NOTHING), F.lit(None)).when(t == "present", t).when(found != "", found).otherwise(t)


def temporal_timestamp(text, end_of_period: bool = False) -> Column:
    """Start of the date or year that a text names; with end_of_period, the last moment of it."""
    t = F.lower(F.trim(col(text)))
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))
    year = F.when(~t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.regexp_extract(t, r"(\d{4})", 1))
    begin = F.when(year != "", F.try_to_timestamp(F.concat(year, F.lit("-01-01")), F.lit("yyyy-MM-dd")))
    out = F.coalesce(day, begin)
    if end_of_period:
        tick = F.expr("interval 1 microsecond")
        out = F.coalesce(day + F.expr("interval 1 day") - tick, begin + F.expr("interval 1 year") - tick)
    return F.when(t.isin(*NOTHING, "present"), F.lit(None).cast("timestamp")).otherwise(out)


def potential_names(text) -> Column:
    t = col(text)
    found = [F.regexp_extract_all(t, F.lit(p), 1) for p in ('"([^"]+)"', CAPITALISED, TITLED)]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def normal_answer(text) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    t = F.regexp_replace(F.lower(F.coalesce(col(text).cast("string"), F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "), r"\s+", " "))


def name_boost(question, aliases_col, name="name", canonical="canonical_name") -> Column:
    """How far a question names an entity: 0.3 an alias, 0.25 its name, 0.15 a word of an alias."""
    q = F.lower(col(question))
    asked = F.split(q, r"\s+")
    all_names = F.transform(F.array_union(F.coalesce(col(aliases_col), F.array().cast("array<string>")), F.array(col(name))), F.lower)
    whole = F.exists(all_names, lambda a: q.contains(a))
    shared = F.exists(all_names, lambda a: F.arrays_overlap(F.split(a, r"\s+"), asked))
    named = q.contains(F.lower(col(name))) | F.coalesce(q.contains(F.lower(col(canonical))), F.lit(False))
    return F.when(whole, 0.3).when(named, 0.25).when(shared, 0.15).otherwise(0.0)
