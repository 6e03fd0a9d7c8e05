"""Report cleaning (N3) and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytable.functions import report as R

# Positions of the fields that must not be blank, counted from 0.
KEY_FIRST, KEY_LAST = 4, 22


def drop_reason(columns: list[str]) -> Column:
    """Why a raw row is dropped, or ``kept``."""
    return (
        F.when(R.has_bad_word(columns), "bad_value")
        .when(R.is_rejected(columns), "input_rejected")
        .when(R.has_blank_key(columns, KEY_FIRST, KEY_LAST), "blank_key")
        .otherwise("kept")
    )


def cleaned_columns(columns: list[str], mode: str) -> list[Column]:
    """Cleaned value per column, extras left out.

    ``train`` follows the training set; ``infer`` also strips complex numbers; ``panstarrs`` keeps blanks in arrays.
    """
    out = []
    for c in columns:
        if c in R.EXTRA_COLUMNS:
            continue
        value = R.q(c)
        if c in R.WHOLE_WORDS:
            value = R.renamed_words(value, c, "whole")
        elif c in R.BOOLEAN_COLUMNS:
            value = R.capital_boolean(value)
        elif c in R.ARRAY_COLUMNS:
            value = R.joined_array_text(value, c, underscores=mode != "panstarrs")
        if mode == "infer":
            value = R.real_part(value)
        out.append(value.alias(c))
    return out


def sanitize_report(raw: DataFrame, mode: str = "train", carry: list[str] | None = None) -> DataFrame:
    """One scan; text rules first, casts later. ``carry`` columns (a row id) pass through untouched."""
    carry = carry or []
    columns = [c for c in raw.columns if c not in carry]
    # All fields are trimmed once, in an array; the row tests read it, and each kept field is taken from it.
    fields = F.array(*[F.trim(F.coalesce(R.q(c), F.lit(""))) for c in columns])
    listed = raw.select(*[R.q(c) for c in carry], F.explode(F.array(fields)).alias("_fields"))
    state = columns.index("fit_state") if "fit_state" in columns else None
    bad = F.arrays_overlap("_fields", F.array(*[F.lit(w) for w in R.BAD_WORDS]))
    blank = F.array_contains(F.slice("_fields", KEY_FIRST + 1, KEY_LAST - KEY_FIRST + 1), "")
    good = ~bad & ~blank
    if state is not None:
        good = good & (F.col("_fields")[state] != "input rejected")
    kept = listed.filter(good).select(*[R.q(c) for c in carry], *[F.col("_fields")[i].alias(c) for i, c in enumerate(columns)])
    return kept.select(*[R.q(c) for c in carry], *cleaned_columns(columns, mode))


def sanitize_counts(raw: DataFrame) -> DataFrame:
    """Rows per drop reason."""
    columns = raw.columns
    return R.trimmed(raw).groupBy(drop_reason(columns).alias("reason")).agg(F.count("*").alias("n"))


def clean_loose(df: DataFrame) -> DataFrame:
    """The looser cleaner of the augmentation step: words inside text, underscores in all arrays, infinities dropped."""
    out = []
    for c in df.columns:
        value = R.q(c)
        if df.schema[c].dataType.typeName() == "string":
            value = F.trim(value)
        if c in R.PART_WORDS:
            value = R.renamed_words(value, c, "part")
        elif c in R.BOOLEAN_COLUMNS:
            value = F.replace(F.replace(value.cast("string"), F.lit("true"), F.lit("True")), F.lit("false"), F.lit("False"))
        elif c in R.ARRAY_COLUMNS:
            value = F.translate(value, " ", "_")
        out.append(value.alias(c))
    done = df.select(*out)
    return done.filter(~R.has_infinity(done))


def typed_report(clean: DataFrame) -> DataFrame:
    """Cleaned text to the declared types."""
    out = []
    for c in clean.columns:
        if c in ("P_CW", "P_ACW"):
            out.append(R.q(c).try_cast("double").alias(c))
        elif c in R.REPORT_COLUMNS:
            out.append(R.q(c).try_cast(R.report_type(c)).alias(c))
        else:
            out.append(R.q(c))
    return clean.select(*out)
