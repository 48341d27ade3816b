"""Numeric claims in text that no known value backs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import CLAIM_ABS_TOL, CLAIM_REL_TOL

# Fixed patterns: ISO dates are not claims; a number must not sit inside an identifier.
ISO_DATE = r"(?U)\b\d{4}-\d{1,2}(?:-\d{1,2})?\b"
STANDALONE_NUMBER = r"(?U)(?<![\w.])(-?[0-9]+(?:\.[0-9]+)?%?)(?![\w]|\.\w)"


def claimed_numbers(text: Column) -> Column:
    """Number and percent tokens of a text, in order, as strings."""
    return F.regexp_extract_all(F.regexp_replace(text, ISO_DATE, " "), F.lit(STANDALONE_NUMBER), F.lit(1))


def ungrounded_numbers(text: Column, known: Column) -> Column:
    """Claimed numbers that match no value of ``known`` within tolerance.

    A percent may match as written or as a fraction.
    """

    def near(value: Column) -> Column:
        return F.exists(
            known, lambda k: F.abs(value - k) <= F.greatest(F.lit(CLAIM_ABS_TOL), F.lit(CLAIM_REL_TOL) * F.abs(k))
        )

    def value_of(token: Column) -> Column:
        return F.rtrim(token, F.lit("%")).cast("double")

    backed = lambda tok: near(value_of(tok)) | (tok.endswith("%") & near(value_of(tok) / 100.0))
    return F.transform(F.filter(claimed_numbers(text), lambda tok: ~backed(tok)), value_of)


def claimed_values(text: Column) -> Column:
    """Claimed numbers of a text, in order: struct of the number and the values that may back it (a percent also as a fraction)."""

    def entry(token: Column) -> Column:
        value = F.rtrim(token, F.lit("%")).cast("double")
        return F.struct(value.alias("claim"), F.when(token.endswith("%"), F.array(value, value / 100.0)).otherwise(F.array(value)).alias("values"))

    return F.transform(claimed_numbers(text), entry)


#: A bucket is a little wider than the tolerance is anywhere on the bucket scale (1 in its linear, 1.0102 in its logarithmic part).
BUCKET = 1.03


def tolerance_bucket(value: Column) -> Column:
    """Number on a scale, linear near zero and logarithmic beyond, on which values within tolerance are in the same or neighbouring buckets."""
    size = F.abs(value)
    edge = CLAIM_ABS_TOL / CLAIM_REL_TOL
    place = F.when(size <= edge, size / CLAIM_ABS_TOL).otherwise(1.0 / CLAIM_REL_TOL + F.ln(size / edge) / CLAIM_REL_TOL)
    return F.floor(F.signum(value) * place / BUCKET).cast("long")
