"""Column expressions on names and replies: which names are features, how replies of a model are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeweave.functions.numeric import clip, col, number

#: fixed values: whole names that are identifiers rather than features, in any case
ID_LIKE = ("id", "idx", "index", "row_id", "rowid", "row_num", "rownum", "seq", "key", "pk", "uuid", "guid")
#: fixed values: names of labels that say nothing about the concept
GENERIC_LABELS = ("label", "class", "target", "y", "binaryclass", "labels", "classes", "targets")
#: fixed values: answers that stand for yes
AFFIRMATIVE = ("yes", "y", "true", "t", "1", "positive", "pos", "present", "found")


def is_feature_name(c: Column | str, longest: int = 60, most_words: int = 5) -> Column:
    """A short name of few words, without a question mark or full stop at the end, and not an identifier."""
    name = F.trim(col(c))
    words = F.size(F.split(name, r"\s+"))
    return (F.length(name) > 0) & (F.length(name) <= longest) & (words <= most_words) & ~F.contains(name, F.lit("?")) & ~F.endswith(name, F.lit(".")) & ~F.lower(name).isin(*ID_LIKE)


def is_cryptic_name(c: Column | str) -> Column:
    """A name of one character, or a number."""
    return (F.length(F.trim(col(c))) <= 1) | number(c).isNotNull()


def matches_any(c: Column | str, patterns: Sequence[str]) -> Column:
    return col(c).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def slug(c: Column | str) -> Column:
    """Lower case, with a single underscore for each run of other characters."""
    return F.trim(F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9]+", "_"), F.lit("_"))


def without_tags(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"<[^>]*>", ""))


def first_sentence(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(?s)^\s*(.*?[.!?])(?:\s|$)", 1)


def table_number(c: Column | str) -> Column:
    """A number as tables write it: thousands separators and per cent signs don't count."""
    return number(F.regexp_replace(F.trim(col(c)), "[,%]", ""))


def reply_prediction(c: Column | str) -> Column:
    """0 or 1 from a model's reply, after any reasoning part and code fence; null if it has none."""
    body = F.regexp_replace(F.element_at(F.split(col(c), "</think>"), -1), "```(?:json)?", "")
    stated = F.regexp_extract(body, r'(?i)"?(?:prediction|label|answer)"?\s*[:=]\s*"?([01])', 1)
    bare = F.regexp_extract(body, r"^\s*([01])\s*$", 1)
    return F.coalesce(F.nullif(stated, F.lit("")), F.nullif(bare, F.lit(""))).cast("int")


def reply_confidence(c: Column | str, default: float = 0.5) -> Column:
    """A confidence in [0, 1] from a model's reply."""
    found = F.regexp_extract(col(c), r'(?i)"?(?:confidence|probability)"?\s*[:=]\s*"?([0-9]*\.?[0-9]+)', 1)
    return clip(F.coalesce(number(found), F.lit(default)), 0.0, 1.0)


def reply_direction(c: Column | str) -> Column:
    """POSITIVE unless the reply says NEGATIVE."""
    return F.when(F.contains(F.upper(col(c)), F.lit("NEGATIVE")), F.lit("NEGATIVE")).otherwise(F.lit("POSITIVE"))


def lookup_key(c: Column | str) -> Column:
    """How names are compared in lookups: trimmed and in lower case, on both sides."""
    return F.lower(F.trim(col(c)))
