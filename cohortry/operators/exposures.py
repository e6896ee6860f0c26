"""Exposures to coded items and each person's first exposure.

Charges and visits may come per source, as mappings from a source to its table: a charge then
belongs to a visit of its own source only, whatever visit numbers the sources share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import EXCLUDED_CODE_MARKER, EXPOSURE_CODE_PREFIX
from ..functions.text import excluded_code
from .linking import Table, by_source
from .skew import BroadcastLimit, hot_keys, lookup_join, skew_join


def _coded_charges(
    charges: DataFrame, codes: DataFrame, item: str, code: str, code_prefix: str, limit: BroadcastLimit
) -> DataFrame:
    """Charges with a code of the class.

    The code table is a reference table: it is filtered first and broadcast if its
    measured size allows, which drops foreign items before any shuffle. A code table
    with repeated names multiplies rows.
    """
    wanted = codes.select(item, code).filter(F.col(code).startswith(code_prefix))
    return lookup_join(charges, wanted, item, "inner", limit)


def exposures(
    charges: Table,
    codes: DataFrame,
    visit_person: Table,
    *,
    item: str,
    code: str,
    visit: str | Sequence[str],
    code_prefix: str = EXPOSURE_CODE_PREFIX,
    limit: BroadcastLimit = BroadcastLimit(),
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Charges of items whose code starts with `code_prefix`, with the person of the visit.

    Hot visits are looked up in the charges themselves, not in the joined frame.
    """
    keys, (charges, visit_person) = by_source(visit, charges, visit_person)
    hot = hot_keys(charges, keys)
    coded = _coded_charges(charges, codes, item, code, code_prefix, limit)
    return skew_join(coded, visit_person, keys, hot=hot, spread_by=spread_by)


def _counted(df: DataFrame, time: str, code: str, excluded_marker: str | None) -> DataFrame:
    kept = df.filter(F.col(time).isNotNull())
    return kept if excluded_marker is None else kept.filter(~excluded_code(F.col(code), excluded_marker))


def first_exposure(
    exposed: DataFrame, *, person: str, time: str, code: str, excluded_marker: str | None = EXCLUDED_CODE_MARKER
) -> DataFrame:
    """Earliest dated exposure of each person, without codes whose head holds the marker."""
    kept = _counted(exposed, time, code, excluded_marker).filter(F.col(person).isNotNull())
    return kept.groupBy(person).agg(F.min(time).alias(time))


def first_exposure_of_charges(
    charges: Table,
    codes: DataFrame,
    visit_person: Table,
    *,
    item: str,
    code: str,
    visit: str | Sequence[str],
    person: str,
    time: str,
    code_prefix: str = EXPOSURE_CODE_PREFIX,
    excluded_marker: str | None = EXCLUDED_CODE_MARKER,
    limit: BroadcastLimit = BroadcastLimit(),
) -> DataFrame:
    """`first_exposure` of `exposures` without linking every charge to its person.

    The first time of a person is the first of the first times of the visits, so charges
    shrink to one row per visit in the map tasks before they are joined.
    """
    keys, (charges, visit_person) = by_source(visit, charges, visit_person)
    coded = _coded_charges(charges.select(*keys, item, time), codes, item, code, code_prefix, limit)
    per_visit = _counted(coded, time, code, excluded_marker).groupBy(*keys).agg(F.min(time).alias(time))
    linked = per_visit.join(visit_person.select(*keys, person), keys).filter(F.col(person).isNotNull())
    return linked.groupBy(person).agg(F.min(time).alias(time))
