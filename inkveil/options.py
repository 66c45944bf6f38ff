"""Options of a run, checked once on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from inkveil.errors import RedactionError
from inkveil.targets import Target

MODES = ("auto", "text", "vision", "patterns-only")
LINK_TEXT = ("keep", "redact-identifying", "redact-all")
STYLES = ("blur", "box", "label", "pixelate")
OUTPUTS = ("pdf", "images", "both")


@dataclass(frozen=True)
class GridOptions:
    cols: int = 24
    rows: int = 36
    opacity: float = 0.35
    snap_to_words: bool = True


@dataclass(frozen=True)
class RedactOptions:
    targets: tuple[str | Target, ...]
    mode: str = "auto"
    link_text: str = "keep"
    style: str = "blur"
    dpi: int = 150
    padding: float = 2.0
    min_confidence: float = 0.5
    max_pages: int = 0  # 0: no limit
    grid: GridOptions = field(default_factory=GridOptions)
    ocr: bool = True
    ocr_language: str = "eng"
    output: str = "pdf"
    context_url: str | None = None
    snap_visual: bool = False  # visual targets keep their whole region; True shrinks them to words as well
    on_progress: Callable[[dict], None] | None = None

    def __post_init__(self):
        for name, known in (("mode", MODES), ("link_text", LINK_TEXT), ("style", STYLES), ("output", OUTPUTS)):
            if getattr(self, name) not in known:
                raise RedactionError(f"{name} must be one of {', '.join(known)}", "BAD_OPTION")

    def progress(self, stage: str, message: str = "") -> None:
        if self.on_progress:
            self.on_progress({"stage": stage, "message": message})
