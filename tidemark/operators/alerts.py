"""Alert keys and their deduplication."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alert_key(scenario: Column, entity: Column, window: Column, detector: Column) -> Column:
    """The message id of an alert: the same for the same scenario, entity, minute and detector."""
    digest = F.sha2(F.concat_ws("|", scenario, entity, window.cast("string"), detector), 256)
    return F.concat(F.lit("alert-"), F.substring(digest, 1, 24))


def minute(us: Column) -> Column:
    return F.floor(us / 60_000_000)
