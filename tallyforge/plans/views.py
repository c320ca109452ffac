"""The reconciled batch of a data folder, computed once per session and read by the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans.reconcile import Reconciliation, classify_unmatched, matches_and_free, reconcile
from tallyforge.sources import tables

AS_OF = "2001-01-01"

_batches: dict[tuple[str, str], Reconciliation] = {}
_phases: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _phases:
        _phases[key] = matches_and_free(tables.bank(spark, sf_dir), tables.ledger(spark, sf_dir))
    return _phases[key]


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2-M8 of the derived batch, as the reports read it: a written table."""
    return tables.once(spark, sf_dir, "matches", lambda: _matched(spark, sf_dir)[0])


def adjudicated(spark: SparkSession, sf_dir: str) -> Reconciliation:
    """M1-M8 with shortlist and decisions."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _batches:
        _batches[key] = reconcile(
            tables.bank(spark, sf_dir), tables.ledger(spark, sf_dir), tables.gateway(spark, sf_dir),
            adjudication=True)
    return _batches[key]


def plain(spark: SparkSession, sf_dir: str) -> Reconciliation:
    return Reconciliation(matches(spark, sf_dir), *_matched(spark, sf_dir)[1:])


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the unmatched records of ``plain``, classified."""
    return tables.once(
        spark, sf_dir, "exceptions",
        lambda: classify_unmatched(plain(spark, sf_dir), tables.bank(spark, sf_dir), AS_OF))
