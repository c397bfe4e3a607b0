"""Stages of a document job: signatures, manifest, resume."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from textmill.config import resolved
from textmill.sources import load_json, save_json


@dataclass(frozen=True)
class Stage:
    """A step with an artifact; its signature covers code, settings, and the stage before it."""

    name: str
    run: Callable[[dict, str], None]
    artifact: str
    settings: tuple[str, ...] = ()
    code: tuple[str, ...] = ()
    after: str | None = None
    inputs: tuple[str, ...] = field(default=())


def digest(path: str) -> str:
    """SHA-256 of a file, or of a folder's files by name; ``missing`` if it does not exist."""
    if not os.path.exists(path):
        return "missing"
    h = hashlib.sha256()
    files = [path] if os.path.isfile(path) else sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)
    for f in files:
        if f != path:
            h.update(os.path.relpath(f, path).encode())
        with open(f, "rb") as handle:
            while block := handle.read(1 << 20):
                h.update(block)
    return h.hexdigest()


class Job:
    """The stages of one source document, in ``folder``."""

    def __init__(self, stages: list[Stage], cfg: dict, source_hash: str, folder: str):
        self.stages, self.cfg, self.source_hash, self.folder = stages, cfg, source_hash, folder
        self.manifest_path = os.path.join(folder, "manifest.json")

    def stage(self, name: str) -> Stage:
        for s in self.stages:
            if s.name == name:
                return s
        raise ValueError(f"unknown stage: {name}")

    def path(self, stage: Stage) -> str:
        return os.path.join(self.folder, stage.artifact)

    def signature(self, name: str) -> str:
        s = self.stage(name)
        parts = {"source": self.source_hash, "stage": name, "code": {f: digest(f) for f in s.code}, "settings": {k: self.cfg.get(k) for k in s.settings}, "inputs": {k: digest(str(self.cfg.get(k))) for k in s.inputs}}
        if s.after:
            parts["after"] = self.signature(s.after)
        return hashlib.sha256(json.dumps(parts, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()

    def _manifest(self) -> dict:
        try:
            found = load_json(self.manifest_path)
        except (OSError, ValueError):
            found = {}
        found = found if isinstance(found, dict) else {}
        stages = found.get("stages")
        return {"source_hash": self.source_hash, "stages": stages if isinstance(stages, dict) else {}} if found.get("source_hash", self.source_hash) == self.source_hash else {"source_hash": self.source_hash, "stages": {}}

    def mark_done(self, name: str) -> None:
        path = self.path(self.stage(name))
        if not os.path.exists(path):
            raise FileNotFoundError(f"stage {name} left no artifact: {path}")
        m = self._manifest()
        m["stages"][name] = {"signature": self.signature(name), "complete": True, "artifact_digest": digest(path)}
        save_json(m, self.manifest_path)

    def mark_incomplete(self, name: str, **details) -> None:
        m = self._manifest()
        m["stages"][name] = {"signature": self.signature(name), "complete": False} | ({"details": details} if details else {})
        save_json(m, self.manifest_path)

    def done(self, name: str) -> bool:
        """Whether a stage's artifact is there, whole, and made by the same code and settings from the same source."""
        path, entry = self.path(self.stage(name)), self._manifest()["stages"].get(name)
        if not os.path.exists(path) or not isinstance(entry, dict) or entry.get("complete", True) is not True:
            return False
        if entry.get("signature") != self.signature(name):
            return False
        return not entry.get("artifact_digest") or entry["artifact_digest"] == digest(path)

    def start(self, wanted: str | None = None) -> int:
        """Index of the stage to begin with: the one wanted, or an earlier one that isn't complete."""
        at = [s.name for s in self.stages].index(wanted) if wanted else 0
        return next((i for i, s in enumerate(self.stages[:at]) if not self.done(s.name)), at)

    def run(self, resume: bool = False, wanted: str | None = None, limited: bool = False) -> list[str]:
        """Runs the stages and returns those that ran; a failing one is marked incomplete and ends the job."""
        ran = []
        for s in self.stages[self.start(wanted) :]:
            if resume and self.done(s.name):
                continue
            try:
                s.run(self.cfg, self.path(s))
            except Exception as e:
                self.mark_incomplete(s.name, error=str(e)[:500])
                raise
            ran.append(s.name)
            if limited:
                self.mark_incomplete(s.name, limited=True)
            else:
                self.mark_done(s.name)
        return ran


@dataclass(frozen=True)
class Paths:
    """Where a document's artifacts lie: a folder named by its source's hash below the job folder of a configuration."""

    cfg: dict
    source_hash: str

    @property
    def folder(self) -> str:
        return os.path.join(resolved(str(self.cfg.get("tmp_dir") or "intermediate"), str(self.cfg.get("root") or os.getcwd())), self.source_hash)

    def of(self, *names: str) -> dict[str, str]:
        return {n: os.path.join(self.folder, n) for n in names}

    def made(self) -> str:
        """The folder, made if it is not there."""
        os.makedirs(self.folder, exist_ok=True)
        return self.folder

    def logger(self, name: str = "textmill") -> logging.Logger:
        """A logger that writes all to the configuration's log file and what matters to the console, however often it is asked for."""
        path = resolved(str(self.cfg.get("log_path") or os.path.join("log", "textmill.log")), str(self.cfg.get("root") or os.getcwd()))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        out = logging.getLogger(name)
        out.setLevel(logging.DEBUG)
        for old in list(out.handlers):
            out.removeHandler(old)
            old.close()
        for handler, level in ((logging.FileHandler(path, encoding="utf-8"), logging.DEBUG), (logging.StreamHandler(), logging.INFO)):
            handler.setLevel(level)
            handler.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s"))
            out.addHandler(handler)
        return out


def guarded(source: str, target: str, build: Callable[[str, str], None], check: Callable[[str, str], str | None]) -> str:
    """``target`` made from ``source``, never over another file, and only if it passes its check.

    ``build`` writes a file beside the target, which gets its name once ``check`` finds nothing against it; else it goes.
    """
    if os.path.realpath(source) == os.path.realpath(target):
        raise ValueError("a file can't be made from itself")
    if os.path.exists(target):
        raise FileExistsError(target)
    begun = f"{target}.{uuid.uuid4().hex}.part"
    try:
        build(source, begun)
        problem = "nothing was written" if not os.path.exists(begun) or not os.path.getsize(begun) else check(source, begun)
        if problem:
            raise ValueError(problem)
        os.link(begun, target)  # fails, unlike a rename, if the target came to be meanwhile
    finally:
        if os.path.exists(begun):
            os.unlink(begun)
    return target
