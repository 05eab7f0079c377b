"""Table schemas, states and issue codes of the archive."""

USERS = "id long, username string, created_at timestamp, updated_at timestamp"
TASKS = (
    "id string, url string, domain string, status string, file_name string, error string, external_task_id string, "
    "created_at timestamp, updated_at timestamp, started_at timestamp, finished_at timestamp"
)
STATS = "source string, file_count long"
DOCUMENTS = "id string, title string, filename string, domain string, content string"
FILES = "domain string, filename string, request_path string, abs_path string"
ISSUES = (
    "code string, severity string, store string, domain string, filename string, path string, document_ids array<string>, "
    "message string, recoverable boolean"
)

PENDING, RUNNING, SUCCESS, FAILED = "pending", "running", "success", "failed"
ACTIVE = (PENDING, RUNNING)

# Code -> (severity, store, recoverable).
ISSUE_KINDS = {
    "html_unattributed": ("error", "html", False),
    "html_unparseable": ("error", "html", False),
    "doc_blank_key": ("warning", "meilisearch", True),
    "doc_missing": ("warning", "meilisearch", True),
    "doc_duplicate": ("warning", "meilisearch", True),
    "doc_orphan": ("error", "meilisearch", False),
    "stat_total_mismatch": ("warning", "database", True),
    "stat_source_mismatch": ("warning", "database", True),
    "stat_source_stale": ("warning", "database", True),
}


class ArchiveError(ValueError):
    """A request that the archive rejects."""


class InvalidPath(ArchiveError):
    pass


class FileMissing(ArchiveError):
    pass


class DocumentMissing(ArchiveError):
    pass


class Cancelled(ArchiveError):
    """What was waited for is no longer wanted."""
