"""Document redaction on Spark. The names below are the public ones; each is imported when it is first used."""

from __future__ import annotations

import importlib

_HOME = {
    "redact": "inkveil.plans.pipeline",
    "text_pages": "inkveil.plans.pipeline",
    "file_pages": "inkveil.plans.pipeline",
    "Pages": "inkveil.plans.pipeline",
    "Result": "inkveil.plans.pipeline",
    "RedactOptions": "inkveil.options",
    "GridOptions": "inkveil.options",
    "Target": "inkveil.targets",
    "resolve_targets": "inkveil.targets",
    "builtin_target_ids": "inkveil.targets",
    "read_files": "inkveil.sources.files",
    "read_images": "inkveil.sources.files",
    "fetch_context": "inkveil.sources.files",
    "OcrEngine": "inkveil.sources.files",
    "grid_overlays": "inkveil.operators.paint",
    "column_label": "inkveil.functions.grid",
    "parse_cell": "inkveil.functions.grid",
    "range_box": "inkveil.functions.grid",
    "CustomProvider": "inkveil.providers",
    "ScriptedProvider": "inkveil.providers",
    "OpenAIProvider": "inkveil.providers",
    "AnthropicProvider": "inkveil.providers",
    "strict_schema": "inkveil.providers",
    "redact_stream": "inkveil.streaming.stream",
    "RedactionError": "inkveil.errors",
    "UnsupportedInput": "inkveil.errors",
    "UnknownTarget": "inkveil.errors",
    "ProviderFailure": "inkveil.errors",
    "MissingDependency": "inkveil.errors",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(importlib.import_module(_HOME[name]), name)
