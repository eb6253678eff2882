"""Settings, descriptions of an index, query history and log: small files of the driver."""

from __future__ import annotations

import json
import logging
import logging.handlers
import os
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime

from tessera.sources.files import IMAGE_SUFFIXES


@dataclass
class Settings:
    """``degraded`` tells whether a stand-in replaces a backend; it isn't saved."""

    dataset_root: str = ""
    granularity: str = "folder"
    class_names: dict = field(default_factory=dict)
    top_k: int = 24
    score_threshold: float = 0.0
    search_mode: str = "hybrid"
    agentic: bool = False
    summarize: bool = True
    model_id: str = "hash"
    embed_dim: int = 512
    max_members: int = 64
    image_suffixes: list = field(default_factory=lambda: list(IMAGE_SUFFIXES))
    degraded: str = field(default="", compare=False)

    @classmethod
    def load(cls, path: str) -> "Settings":
        """Settings of a file; defaults where it is missing or broken, unknown keys left out."""
        raw = load_json(path)
        known = {f.name for f in fields(cls)} - {"degraded"}
        return cls(**{k: v for k, v in raw.items() if k in known}) if isinstance(raw, dict) else cls()

    def save(self, path: str) -> None:
        save_json(path, {k: v for k, v in asdict(self).items() if k != "degraded"})


def load_json(path: str):
    """What a JSON file holds; None if there is none or it is broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def save_json(path: str, value) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)


def index_meta(report: dict, root: str, signature: tuple, seconds: float) -> dict:
    """A description of an index after a build; ``report`` is its report's row."""
    model, dim, granularity = signature
    return {"built_at": datetime.now().isoformat(timespec="seconds"), "duration_s": round(seconds, 2), "dataset_root": root, "model_id": model, "embed_dim": dim, "granularity": granularity} | report


def mismatch(meta: dict | None, root: str, signature: tuple | None = None) -> str:
    """Why an index doesn't belong to a tree or model; empty if it does or nothing is known."""
    if not meta:
        return ""
    plain = lambda p: (p or "").replace("\\", "/").rstrip("/").lower()
    if root and meta.get("dataset_root") and plain(meta["dataset_root"]) != plain(root):
        return f"the index was built from {meta['dataset_root']}"
    if signature and (meta.get("model_id"), meta.get("embed_dim"), meta.get("granularity")) != tuple(signature):
        return "the index was built with another model, dimension or granularity"
    return ""


def remember(history: list[str], text: str, last: int = 200) -> list[str]:
    """The history with one more query; a repeat of the last one changes nothing."""
    return (history if history and history[-1] == text else [*history, text])[-last:]


def name_pairs(items: Iterable[str]) -> dict[str, str]:
    """Class names given as ``id=name``; ids that are numbers lose leading zeros, what isn't a pair is left out."""
    pairs = (x.partition("=") for x in items)
    return {(str(int(k.strip())) if k.strip().isdigit() else k.strip()): v.strip() for k, eq, v in pairs if eq and k.strip()}


def data_paths(home: str | None = None) -> dict[str, str]:
    """Where the library keeps things; ``TESSERA_HOME`` moves it."""
    base = home or os.environ.get("TESSERA_HOME") or os.path.join(os.path.expanduser("~"), ".tessera")
    return {"home": base} | {name: os.path.join(base, part) for name, part in (("store", "store"), ("settings", "settings.json"), ("meta", "index.json"), ("history", "history.json"), ("thumbs", "thumbs"), ("log", "logs/tessera.log"))}


def log_to(path: str) -> logging.Logger:
    """A log of at most four files of 2 MB."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    log = logging.getLogger("tessera")
    log.setLevel(logging.INFO)
    handler = logging.handlers.RotatingFileHandler(path, maxBytes=2_000_000, backupCount=3, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    return log
