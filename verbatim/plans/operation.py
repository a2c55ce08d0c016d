"""Recoverable operations: stages with artifacts, kept in one state file next to what they write."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path


def fingerprint(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def tree_fingerprint(root: str | Path) -> str:
    """A hash of the names, sizes and contents of all files below a folder."""
    found = []
    for path in sorted(p for p in Path(root).rglob("*") if p.is_file()):
        found.append((path.relative_to(root).as_posix(), path.stat().st_size, hashlib.sha256(path.read_bytes()).hexdigest()))
    return fingerprint(found)


def outside(output: str | Path, source: str | Path) -> Path:
    """The output path, if it isn't the source or below it."""
    out, src = Path(output).resolve(), Path(source).resolve()
    if out == src or src in out.parents:
        raise ValueError(f"{output} lies inside {source}")
    return out


class Operation:
    """Stages that run in the order of their needs, resume where they stopped, and run again when what they stand on changed.

    The same id with other inputs is refused. A finished stage is taken as it is while its
    artifacts have the recorded hashes; else it and all that need it run again.
    """

    def __init__(self, root: str | Path, name: str, inputs: dict):
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"bad operation id: {name}")
        self.root = Path(root) / name
        self.root.mkdir(parents=True, exist_ok=True)
        self.path = self.root / "operation.json"
        self.stages: dict[str, tuple[Callable[[Path], list[str]], tuple[str, ...]]] = {}
        self.state = json.loads(self.path.read_text()) if self.path.exists() else {"inputs": fingerprint(inputs), "stages": {}}
        if self.state["inputs"] != fingerprint(inputs):
            raise ValueError(f"operation {name} was begun with other inputs")

    def stage(self, name: str, run: Callable[[Path], list[str]], needs: tuple[str, ...] = ()) -> None:
        """``run`` gets the operation's folder and returns the artifacts it wrote there."""
        missing = [n for n in needs if n not in self.stages]
        if missing:
            raise ValueError(f"{name} needs {missing}, which is declared later or never")
        self.stages[name] = (run, needs)

    def _hash(self, artifact: str) -> str | None:
        path = self.root / artifact
        if path.is_dir():
            return tree_fingerprint(path)
        return hashlib.sha256(path.read_bytes()).hexdigest() if path.is_file() else None

    def _save(self) -> None:
        part = self.path.with_suffix(".partial")
        part.write_text(json.dumps(self.state, indent=1, sort_keys=True))
        os.replace(part, self.path)

    def holds(self, name: str) -> bool:
        own = self.state["stages"].get(name, {})
        return own.get("status") == "complete" and all(self._hash(a) == h for a, h in own["artifacts"].items())

    def invalidate(self, name: str) -> list[str]:
        """Forget a stage and all that need it; their names."""
        gone = [name]
        for other, (_, needs) in self.stages.items():
            if set(needs) & set(gone):
                gone.append(other)
        for n in gone:
            self.state["stages"].pop(n, None)
        self._save()
        return gone

    def execute(self) -> list[str]:
        """Run what has to run; the names of the stages that did."""
        ran: list[str] = []
        for name, (run, needs) in self.stages.items():
            if self.holds(name) and not set(needs) & set(ran):
                continue
            self.invalidate(name)
            self.state["stages"][name] = {"status": "running"}
            self._save()
            try:
                artifacts = run(self.root)
                self.state["stages"][name] = {"status": "complete", "artifacts": {a: self._hash(a) for a in artifacts}}
                if None in self.state["stages"][name]["artifacts"].values():
                    raise FileNotFoundError(f"stage {name} names an artifact that isn't there")
            except BaseException as error:
                self.state["stages"][name] = {"status": "failed", "error": repr(error)}
                self._save()
                raise
            self._save()
            ran.append(name)
        return ran
