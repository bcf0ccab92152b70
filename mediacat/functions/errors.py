"""Classes of an object store's errors, from its error code and its HTTP status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and statuses of a missing object, and of a conditional write that lost.
NOT_FOUND, NOT_FOUND_STATUS = ("NoSuchKey", "NotFound"), 404
LOST, LOST_STATUS = ("PreconditionFailed",), 412


def error_class(code: Column, status: Column) -> Column:
    """'not_found', 'precondition_failed' or 'other'; null without code and status."""
    has = lambda codes, at: F.coalesce(code.isin(*codes), F.lit(False)) | F.coalesce(status == at, F.lit(False))
    return F.when(has(NOT_FOUND, NOT_FOUND_STATUS), "not_found").when(has(LOST, LOST_STATUS), "precondition_failed").when(code.isNotNull() | status.isNotNull(), "other")
