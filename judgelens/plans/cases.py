"""A stratified reading list of validation errors with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame

from judgelens.constants import CASES_PER_CELL, EVIDENCE_COLUMNS, EXAMPLE_KEY, SEED
from judgelens.operators.classification import assert_scored
from judgelens.operators.sampling import annotate_cases, assert_evidence, attach_evidence, stratified_error_sample
from judgelens.sources.staging import stage

INDEX_COLUMNS = ("example_id", "label", "prediction", "p_e", *EVIDENCE_COLUMNS)


def development_cases(
    scored: DataFrame, features: DataFrame, per_cell: int = CASES_PER_CELL, seed: int = SEED, identity=EXAMPLE_KEY
) -> DataFrame:
    """Sampled errors with text, evidence and an empty review form; refuses scores and sources that do not fit.

    ``identity`` names the columns that tell pairs apart; without other ones, an id that two pairs share is refused.
    """
    assert_scored(scored, identity)
    sample = stratified_error_sample(scored, per_cell, seed, identity)
    cases = stage(attach_evidence(sample, features, per_cell, identity), "cases")
    assert_evidence(cases, identity)
    return annotate_cases(cases.drop(*[name for name in identity if name not in EXAMPLE_KEY]), per_cell)


def case_index(cases: DataFrame) -> DataFrame:
    """The part of the case table that holds no query or product text."""
    return cases.select(*INDEX_COLUMNS)
