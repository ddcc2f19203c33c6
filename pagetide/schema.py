"""Table schemas, allowed values and error codes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
_TS, _D = T.TimestampNTZType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


REQUESTS = _struct(request_id=_L, ts=_TS, ip=_S, user_agent=_S, referer=_S, path=_S)
VISITS = _struct(id=_L, ip_trunc=_S, country=_S, city=_S, device=_S, browser=_S,
                 source=_S, path=_S, created_at=_TS)
BOT_VISITS = _struct(id=_L, name=_S, country=_S, path=_S, created_at=_TS)
GEO_BLOCKS = _struct(ip_start=_L, ip_end=_L, country=_S, city=_S)
FILES = _struct(id=_S, sha256=_S, filename=_S, size_bytes=_L, mime=_S, storage_key=_S,
                kind=_S, status=_S, page_count=_I, created_at=_TS)
JOBS = _struct(id=_S, tool=_S, status=_S, file_ids=_S, options=_S, output_file_id=_S,
               error=_S, error_code=_S, created_at=_TS, updated_at=_TS)
LOGIN_ATTEMPTS = _struct(username=_S, ip=_S, success=_B, created_at=_TS)
DOC_PAGES = _struct(doc_id=_L, page_no=_I, text=_S, width_pt=_D, height_pt=_D, rotation=_I)
MESSAGES = _struct(locale=_S, key=_S, value=_S)

# Columns each operational table must have; the second tuple holds nullable
# columns that are added when an older table lacks them.
REQUIRED = {
    "files": (("id", "sha256", "filename", "size_bytes", "mime", "storage_key", "kind",
               "status", "page_count", "created_at"), ()),
    "jobs": (("id", "tool", "status", "file_ids", "options", "output_file_id", "error",
              "created_at", "updated_at"), (("error_code", "string"),)),
    "visits": (("id", "ip_trunc", "country", "city", "device", "browser", "source", "path",
                "created_at"), ()),
    "bot_visits": (("id", "name", "country", "path", "created_at"), ()),
}

# Life-cycle states.
FILE_STATUSES = ("pending", "validated", "rejected", "deleted")
JOB_STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")
OPEN_JOB_STATUSES = ("queued", "running")

# Error codes written to ``error_code`` columns.
INVALID_OPTION = "invalid_option"
BAD_OPTION = "bad_option"
MISSING_OPTION = "missing_option"
MISSING_INPUT = "missing_input"
INVALID_INPUT = "invalid_input"
ENCRYPTED_PDF = "encrypted_pdf"
NO_MATCHES = "no_matches"
REDACTION_FAILED = "redaction_failed"
NO_DIFFERENCES = "no_differences"
NO_TEXT = "no_text"
UNREPAIRABLE = "unrepairable"
OUTPUT_TOO_LARGE = "output_too_large"
SERVER_RESTART = "server_restart"
FILE_TOO_LARGE = "file_too_large"
QUOTA_EXCEEDED = "quota_exceeded"

# Limits and windows.
RETENTION_DAYS = 7
QUOTA_PER_HOUR = 5
QUOTA_RETENTION_HOURS = 2
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_DOWNLOAD_BYTES = 50 * 1024 * 1024
PART_BYTES = 4 * 1024 * 1024
PART_TTL_SECONDS = 2 * 3600
LOGIN_MAX_FAILURES = 5
LOGIN_WINDOW_SECONDS = 15 * 60
DUPLICATE_WINDOW_SECONDS = 10 * 60
