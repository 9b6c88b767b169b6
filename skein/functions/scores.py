"""Scoring arithmetic of retrieval, intervals and audio levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENCY, HALF_LIFE_DAYS, COVERAGE = 0.004, 45.0, 0.004
RRF_K = 60
WEAK_COSINE = 0.30


def recency_prior(created: Column, now: Column) -> Column:
    """0.004 * e^(-age in days / 45) from epoch seconds; future dates count as now."""
    age = F.greatest(F.lit(0.0), (now - created) / F.lit(86400.0))
    return F.lit(RECENCY) * F.exp(-age / F.lit(HALF_LIFE_DAYS))


def coverage(query_terms: Column, doc_terms: Column) -> Column:
    """Share of the distinct query terms that a document holds."""
    q = F.array_distinct(query_terms)
    return share(F.size(F.array_intersect(q, doc_terms)), F.size(q))


def share(shared: Column, terms: Column) -> Column:
    """Share of a number of terms; 0 of none."""
    return F.when(terms > 0, shared / terms).otherwise(F.lit(0.0))


def adjusted(fused: Column, recency: Column, covered: Column) -> Column:
    return fused + recency + F.lit(COVERAGE) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), covered))


def is_weak(keyword_hits: Column, best_cosine: Column) -> Column:
    return (keyword_hits == 0) & (F.coalesce(best_cosine, F.lit(0.0)) < WEAK_COSINE)


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def level(samples_rms: Column) -> Column:
    """RMS to decibels, clamped to -60..0, as 0..1."""
    db = F.lit(20.0) * F.log10(F.greatest(samples_rms, F.lit(1e-7)))
    return (F.greatest(F.lit(-60.0), F.least(F.lit(0.0), db)) + 60.0) / 60.0
