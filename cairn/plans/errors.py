"""Errors of the query layer, with stable snake_case codes."""

from __future__ import annotations


class QueryError(ValueError):
    code = "internal_error"
    retryable = False


def _kind(name: str, code: str, retryable: bool = False) -> type[QueryError]:
    return type(name, (QueryError,), {"code": code, "retryable": retryable})


InvalidQuery = _kind("InvalidQuery", "invalid_query")
TypeMismatch = _kind("TypeMismatch", "type_mismatch")
ColumnNotFound = _kind("ColumnNotFound", "column_not_found")
TableNotFound = _kind("TableNotFound", "table_not_found")
IndexNotFound = _kind("IndexNotFound", "index_not_found")
ScanBoundExceeded = _kind("ScanBoundExceeded", "scan_bound_exceeded")
InvalidCursor = _kind("InvalidCursor", "invalid_cursor")
PermissionDenied = _kind("PermissionDenied", "permission_denied")


class EngineError(ValueError):
    code = "internal_error"


def _engine(name: str, code: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code})


DuplicateKey = _engine("DuplicateKey", "duplicate_primary_key")
ConstraintViolation = _engine("ConstraintViolation", "constraint_violation")
AssertionFailed = _engine("AssertionFailed", "assertion_failed")
Conflict = _engine("Conflict", "conflict")
Underflow = _engine("Underflow", "underflow")
Overflow = _engine("Overflow", "overflow")
ValidationError = _engine("ValidationError", "validation")
NotFound = _engine("NotFound", "not_found")
FencingLost = _engine("FencingLost", "fencing_lost")
