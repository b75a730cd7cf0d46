"""Job parameters (one immutable value object handed to the jobs)."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults and limits that decide which files and threats appear. The size and depth limits are
# parameters to ask for; a scan has none unless they are given.
DEFAULT_EXTENSIONS = ("php", "js", "html", "htm", "css")
DEFAULT_MAX_FILE_SIZE = 10485760
DEFAULT_EXCLUDED_DIRS = (
    "wp-content/cache",
    "wp-content/backup",
    "wp-content/uploads",
    "wp-admin/includes",
    "wp-includes",
    ".git",
    "node_modules",
    "vendor",
)
MAX_DEPTH = 10
DEFAULT_CONFIDENCE_THRESHOLD = 0.5
MIN_CONFIDENCE_THRESHOLD = 0.1
MAX_CONFIDENCE_THRESHOLD = 1.0


@dataclass(frozen=True)
class ScanSettings:
    scan_paths: tuple[str, ...] = ()
    file_extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    max_file_size: int | None = None
    excluded_dirs: tuple[str, ...] = DEFAULT_EXCLUDED_DIRS
    max_depth: int | None = None
    confidence_threshold: float = DEFAULT_CONFIDENCE_THRESHOLD
    gate_verdicts: bool = True
    email_notifications: bool = False
    notification_email: str = ""
    site_name: str = "site"
    admin_email: str = ""
    dashboard_url: str = ""

    def __post_init__(self) -> None:
        if not MIN_CONFIDENCE_THRESHOLD <= self.confidence_threshold <= MAX_CONFIDENCE_THRESHOLD:
            raise ValueError(f"confidence threshold {self.confidence_threshold} is not between 0.1 and 1")

    @property
    def threshold(self) -> float:
        return self.confidence_threshold

    @property
    def alerts_enabled(self) -> bool:
        return self.email_notifications and bool(self.notification_email)


def split_setting(text: str, separator: str) -> tuple[str, ...]:
    """Split a settings text into trimmed, non-empty entries."""
    return tuple(part.strip() for part in text.split(separator) if part.strip())
