"""Lexicons and settings from files, read on the driver: they are small and parametrise plans."""

from __future__ import annotations

import json
from pathlib import Path

from ..functions.lexicon import Lexicon, Settings


def read_config(path: str) -> dict:
    """A JSON file, or a YAML one where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML needs the yaml package; JSON needs nothing") from error
        return yaml.safe_load(text) or {}
    return json.loads(text)


def read_lexicon(path: str) -> Lexicon:
    return Lexicon.of(read_config(path))


def read_settings(path: str) -> Settings:
    return Settings.of(read_config(path))
