"""Layered configuration: defaults, then files on one another, then "key value" overrides; unknown keys are errors."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import random
import subprocess
import tempfile
import time
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path
from typing import Any


def merged(base: Mapping[str, Any], more: Mapping[str, Any], at: str = "") -> dict[str, Any]:
    """base with the values of more, which may only have keys of base."""
    out = dict(base)
    for k, v in more.items():
        if k not in base:
            raise KeyError(f"unknown key: {at}{k}")
        out[k] = merged(base[k], v, f"{at}{k}.") if isinstance(base[k], Mapping) and isinstance(v, Mapping) else v
    return out


def from_file(path: str | Path) -> dict[str, Any]:
    """A JSON file; its key `_BASE_` names a file, beside it, that it lies on."""
    path = Path(path)
    made = json.loads(path.read_text())
    base = made.pop("_BASE_", None)
    if base is None:
        return made
    under = from_file(path.parent / base)

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}

    return over(under, made)


def overridden(base: Mapping[str, Any], pairs: list[str]) -> dict[str, Any]:
    """base with "A.B value" pairs, values in JSON or else plain text."""
    out = dict(base)
    for key, text in zip(pairs[::2], pairs[1::2], strict=True):
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        for part in reversed(key.split(".")):
            value = {part: value}
        out = merged(out, value)
    return out


class Frozen(Mapping):
    """A configuration that cannot be changed; keys are read as items or attributes."""

    def __init__(self, of: Mapping[str, Any]) -> None:
        object.__setattr__(self, "_of", {k: Frozen(v) if isinstance(v, Mapping) else v for k, v in of.items()})

    def __getitem__(self, key: str) -> Any:
        return self._of[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._of)

    def __len__(self) -> int:
        return len(self._of)

    def __getattr__(self, key: str) -> Any:
        try:
            return self._of[key]
        except KeyError:
            raise AttributeError(key) from None

    def __setattr__(self, key: str, value: Any) -> None:
        raise TypeError("the configuration is frozen")


def plain(of: Any) -> Any:
    """Nested mappings as dicts, sequences as lists."""
    if isinstance(of, Mapping):
        return {k: plain(v) for k, v in of.items()}
    return [plain(v) for v in of] if isinstance(of, (list, tuple)) else of


def value_at(of: Mapping[str, Any], key: str) -> Any:
    """The value of "A.B"; an unknown part is named in the error."""
    for part in key.split("."):
        if part not in of:
            raise KeyError(f"no {key} in the configuration: {part} is missing")
        of = of[part]
    return of


def code_version(folder: str | Path = ".") -> str:
    """The commit of the code, "unknown" where there is none."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def started(of: Mapping[str, Any], folder: str | Path, name: str = "run") -> Path:
    """A new folder for a run, with its configuration, id, version and time in config.json; the seed is set if the configuration has one."""
    at = Path(folder) / f"{time.strftime('%Y-%m-%d-%H-%M-%S')}-{name}-{uuid.uuid4().hex[:8]}"
    at.mkdir(parents=True)
    told = {"config": plain(of), "run_id": uuid.uuid4().hex, "version": code_version(), "begun": time.strftime("%Y-%m-%dT%H:%M:%S"), "hash": hashlib.sha256(json.dumps(plain(of), sort_keys=True, default=str).encode()).hexdigest()}
    part = at / ".config.json"
    part.write_text(json.dumps(told, indent=1, default=str))
    os.replace(part, at / "config.json")
    if of.get("seed") is not None:
        random.seed(of["seed"])
    return at


def logger(name: str = "quirefold", file: str | Path | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console and, if given, a file; asked for again it gets no second handler of a kind."""
    log = logging.getLogger(name)
    log.setLevel(level)
    form = logging.Formatter("[%(asctime)s %(name)s] %(levelname)s: %(message)s", "%m/%d %H:%M:%S")
    have = {getattr(h, "baseFilename", "console") for h in log.handlers}
    for key, make in (("console", logging.StreamHandler), *((((str(Path(file).absolute())), lambda: logging.FileHandler(file)),) if file else ())):
        if key not in have:
            handler = make()
            handler.setFormatter(form)
            log.addHandler(handler)
    return log


@contextmanager
def folder_or_temporary(path: str | Path | None, keep: bool = False) -> Iterator[Path]:
    """A folder of the driver's: the one given, made if it is not there, or a temporary one that goes at the end unless it is to be kept."""
    if path is not None:
        Path(path).mkdir(parents=True, exist_ok=True)
        yield Path(path)
    elif keep:
        yield Path(tempfile.mkdtemp())
    else:
        with tempfile.TemporaryDirectory() as made:
            yield Path(made)


@contextmanager
def timed(rows: list[tuple[str, float]], label: str) -> Iterator[None]:
    """Adds (label, seconds) of a block to rows, also if it fails; mean and sum by label are an aggregation over them."""
    began = time.perf_counter()
    try:
        yield
    finally:
        rows.append((label, time.perf_counter() - began))
