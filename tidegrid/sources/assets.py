"""Driver-side assets: JSON sidecars and typed INI settings."""

from __future__ import annotations

import ast
import configparser
import json
from pathlib import Path

CLASSES, AUDIO, SPECTRAL = "classes_list.json", "audio_settings.json", "spec_settings.json"


def read_json(folder: str, name: str):
    return json.loads(Path(folder, name).read_text())


def write_json(folder: str, name: str, value) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, name).write_text(json.dumps(value, indent=1, sort_keys=True))


def read_settings(path: str, template: dict[str, dict[str, tuple]]) -> dict[str, dict]:
    """Sections of an INI file by a template {section: {key: (type, default)}}.

    Values are literals (never evaluated as code) or plain strings; a default of ``...`` makes a key
    required. Unknown sections and keys are errors.
    """
    parser = configparser.ConfigParser()
    with open(path) as f:
        parser.read_file(f)
    unknown = [f"{s}.{k}" for s in parser.sections() for k in parser[s] if k not in template.get(s, {})]
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out: dict[str, dict] = {}
    for section, keys in template.items():
        out[section] = {}
        for key, (kind, default) in keys.items():
            if not parser.has_option(section, key):
                if default is ...:
                    raise ValueError(f"missing setting {section}.{key}")
                out[section][key] = default
                continue
            text = parser.get(section, key)
            try:
                value = ast.literal_eval(text)
            except (ValueError, SyntaxError):
                value = text
            out[section][key] = value if value is None or isinstance(value, kind) else kind(value)
    return out
