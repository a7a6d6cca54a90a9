"""Scores as columns: relevance of a line, of a file name, of a file; vector similarity; small norms."""

from __future__ import annotations

import re
from math import e

from pyspark.sql import Column
from pyspark.sql import functions as F

from fossick.functions.matching import quoted


def clamp(x: float, lo: float, hi: float) -> float:
    return max(lo, min(hi, x))


def term_frequency(text: Column, term: str, *, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    flags = ("" if case_sensitive else "(?iu)") + ("(?U)" if whole_word else "")
    pattern = rf"{flags}(?<!\w){quoted(term)}(?!\w)" if whole_word else flags + quoted(term)
    return F.regexp_count(text, F.lit(pattern))


def line_relevance(
    text: Column, terms: list[str], weights: list[float] | None = None, *, case_sensitive: bool = False, whole_word: bool = False, saturation: str = "sigmoid", k: float = 1.0,
    exponent: float = 1.0, isolated_bonus: float = 2.0, length_norm: str = "linear", idf: dict[str, float] | None = None, ends_line: bool = True,
) -> Column:
    """Sum over the terms of saturated frequency ** exponent * bonus * weight * idf, times a factor of the length.

    The idf of a term is its length / 5 between 0.2 and 1 unless given; the bonus holds where some occurrence has no
    letter or digit beside it; the length includes the newline that ends a line.
    """
    if weights is not None and len(weights) != len(terms):
        raise ValueError("as many weights as terms are needed")
    total = F.lit(0.0)
    for term, w in zip(terms, weights or [1.0] * len(terms), strict=True):
        if not term:
            continue
        tf = term_frequency(text, term, case_sensitive=case_sensitive, whole_word=whole_word).cast("double")
        sat = {"sigmoid": tf / (tf + k), "log": 1 + F.ln(tf), "raw": tf}[saturation]
        flags = "(?U)" if case_sensitive else "(?iuU)"
        alone = text.rlike(rf"{flags}(?<![\p{{L}}\p{{N}}]){quoted(term)}(?![\p{{L}}\p{{N}}])")
        bonus = F.when(alone, F.lit(isolated_bonus)).otherwise(1.0)
        rare = (idf or {}).get(term, clamp(len(term) / 5, 0.2, 1.0))
        total = total + F.when(tf > 0, (sat if exponent == 1 else F.pow(sat, F.lit(exponent))) * bonus * F.lit(w * rare)).otherwise(0.0)
    n = F.length(text) + (1 if ends_line else 0)
    factor = {"linear": 1 / (n / F.lit(100.0) + 1), "log": 1 / (F.ln(n + 1) + 1), "none": F.lit(1.0)}[length_norm]
    return F.when(F.length(text) > 0, total * factor).otherwise(0.0)


def default_idf(term: str) -> float:
    return clamp(len(term) / 5, 0.5, 1.0)


def file_score(tf: dict[str, Column], idf: dict[str, float] | None = None) -> Column:
    """Sum of idf * (1 + ln tf) over the keywords that occur; ``tf`` counts matching lines."""
    total = F.lit(0.0)
    for term, n in tf.items():
        w = (idf or {}).get(term, default_idf(term))
        total = total + F.when(n > 0, w * (1 + F.ln(n.cast("double")))).otherwise(0.0)
    return total


def filename_score(name: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """How well a file name fits a pattern, with or without its regex marks: equal 1.0, but for the case 0.9; begins with
    it 0.8, but for the case 0.75; holds it 0.6, but for the case 0.55; else 0.3 and up to 0.2 for the share of its length."""
    core = re.sub(r"[\^$.*+?()\[\]{}|\\]", "", pattern)
    low, bare = F.lower(name), core.lower()
    out = F.when(name.isin(pattern, core), 1.0)
    if not case_sensitive:
        out = out.when(low.isin(pattern.lower(), bare), 0.9)
    out = out.when(name.startswith(core), 0.8).when(low.startswith(bare), 0.75).when(name.contains(core), 0.6).when(low.contains(bare), 0.55)
    return out.otherwise(0.3 + F.lit(float(len(core))) / F.greatest(F.lit(1), F.length(name)) * 0.2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors that are null, of length zero or of different sizes."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def log_tf_norm(count: Column) -> Column:
    return F.when(count > 0, 1 + F.ln(count.cast("double"))).otherwise(0.0)


def log_tf_norm_penalty(count: Column, ideal: tuple[float, float] = (50, 200), alpha: float = 0.5) -> Column:
    """The log norm, lowered on both sides of the ideal range."""
    lo, hi = ideal
    below = F.exp(-F.lit(alpha) * (lo - count) / lo)
    above = F.exp(-F.lit(alpha) * (count - hi) / hi)
    return F.when(count <= 0, 0.0).otherwise(F.ln(count + F.lit(e)) * F.when(count < lo, below).when(count > hi, above).otherwise(1.0))


def clamp_weights(keywords: Column) -> Column:
    """Keyword weights between 1 and 10."""
    return F.transform_values(keywords, lambda _, v: F.least(F.lit(10.0), F.greatest(F.lit(1.0), v)))
