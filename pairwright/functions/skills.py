"""Skill names and their overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a skill's name loses before it is compared; results rest on these patterns.
ANALYSIS_WORDS, ANALYSIS_NUMBERS, ANALYSIS_SIGNS = r"\b(?:developer|engineer)\b|\.js\b", r"\d+(?:\.\d+)?", r"[^a-z0-9+\s]"
PLAIN_VERSIONS, PLAIN_ENDS = r"\b\d+(?:\.\d+)*\b", r"(?: developer| engineer|\.js)$"


def squeezed(c: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def analysis_skill(skill: Column) -> Column:
    """Lower case without role words, ``.js``, numbers and signs other than a plus."""
    bare = F.regexp_replace(squeezed(F.lower(skill)), ANALYSIS_WORDS, "")
    return squeezed(F.regexp_replace(F.regexp_replace(bare, ANALYSIS_NUMBERS, ""), ANALYSIS_SIGNS, " "))


def plain_skill(skill: Column) -> Column:
    """Lower case without version numbers and without one trailing role word or ``.js``."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(skill), PLAIN_VERSIONS, ""), r"(?U)^\s+|\s+$", "")
    return squeezed(F.regexp_replace(bare, PLAIN_ENDS, ""))


def skill_set(skills: Column, normalise=analysis_skill, keep_empty: bool = False) -> Column:
    """The different normalised skills of an array of names."""
    out = F.array_distinct(F.transform(F.coalesce(skills, F.array().cast("array<string>")), normalise))
    return out if keep_empty else F.filter(out, lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
