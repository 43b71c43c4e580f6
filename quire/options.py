"""Settings of a conversion run, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass

# The formats accepted by default.
SUPPORTED_EXTENSIONS = (
    ".pdf", ".docx", ".pptx", ".xlsx",
    ".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif",
    ".epub",
)

# The image types that are copied next to the Markdown.
IMAGE_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif",
)

# Fixed value: seconds a converter may spend on one document.
DOCUMENT_TIMEOUT = 300


@dataclass(frozen=True)
class Options:
    """What to convert and how to lay out the results.

    force: convert documents the ledger already holds.
    retry_failed: treat an unchanged document whose last run failed as pending.
    max_bytes: larger documents become ``failed`` rows and are not read; None means no limit.
    verify: open every file, also those whose length and time are as they were.
    document_seconds: a conversion that takes longer is a ``failed`` row; None means no limit.
    document_memory: so many bytes a conversion may take beyond what its process has; None
        means no limit. Without both limits, converters run inside the task's own process.
    settled_seconds: a file that changed later than this before a run is opened again next time.
    item_order: ``"manifest"`` or ``"spine"`` order of an EPUB's chapters.
    """

    supported: tuple[str, ...] = SUPPORTED_EXTENSIONS
    attachments_dir: str = "attachments"
    hash_prefix_length: int = 8
    ledger_version: str = "1.0"
    force: bool = False
    retry_failed: bool = False
    max_bytes: int | None = None
    item_order: str = "manifest"
    keep_external_images: bool = False
    verify: bool = False
    settled_seconds: float = 2.0
    document_seconds: float | None = DOCUMENT_TIMEOUT
    document_memory: int | None = None
