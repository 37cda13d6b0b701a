"""Accounting of test runs, and checks that a run was complete."""

from __future__ import annotations

import importlib.util
import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

SENTINEL, ACCOUNT = "RUN_COMPLETED", "account.json"


class MissingDependency(RuntimeError):
    """Something that a run needs isn't there; it fails, it doesn't skip."""


def require_dependency(name: str) -> None:
    if importlib.util.find_spec(name) is None:
        raise MissingDependency(f"{name} is needed here and isn't installed")


def dependency_info(name: str) -> dict:
    from importlib import metadata

    try:
        version = metadata.version(name)
    except metadata.PackageNotFoundError:
        version = None
    return {"name": name, "version": version, "revision": os.environ.get("BUILD_REVISION") or None}


@dataclass
class RunAccounting:
    """What a run planned and what it did. finish() writes the account and then a sentinel,
    whether tests passed or not: a run that died has no sentinel."""

    folder: str
    planned: list[str]
    results: list[dict] = field(default_factory=list)
    skips: list[dict] = field(default_factory=list)

    def record(self, file: str, test: str, passed: int = 0, failed: int = 0, error: bool = False, skipped: bool = False) -> None:
        self.results.append({"file": file, "test": test, "passed": passed, "failed": failed, "error": int(error), "skipped": int(skipped)})

    def skip(self, test: str, reason: str) -> None:
        self.skips.append({"test": test, "reason": reason})

    def start(self) -> None:
        for name in (SENTINEL, ACCOUNT):
            Path(self.folder, name).unlink(missing_ok=True)

    def finish(self) -> dict:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        out = asdict(self) | {"files_missing": sorted({*self.planned} - {r["file"] for r in self.results})}
        Path(self.folder, ACCOUNT).write_text(json.dumps(out))
        Path(self.folder, SENTINEL).write_text("done\n")
        return out


def verify_accounting(folder: str, least_assertions: int = 1) -> list[str]:
    """What speaks against a run: no sentinel, no account, planned files that didn't run,
    files without an assertion, fewer assertions than expected. Empty: complete."""
    if not Path(folder, SENTINEL).exists():
        return ["no sentinel: the run didn't end"]
    if not Path(folder, ACCOUNT).exists():
        return ["no account"]
    account = json.loads(Path(folder, ACCOUNT).read_text())
    made: dict[str, int] = {}
    for r in account["results"]:
        made[r["file"]] = made.get(r["file"], 0) + r["passed"] + r["failed"] + r["error"]
    out = [f"{f} didn't run" for f in account["planned"] if f not in made]
    out += [f"{f} asserts nothing" for f, n in made.items() if n == 0]
    if sum(made.values()) < least_assertions:
        out.append(f"{sum(made.values())} assertions, fewer than {least_assertions}")
    return out


def summary(verdicts: list[dict]) -> str:
    total = {k: sum(v[k] or 0 for v in verdicts) for k in ("passed", "failed", "error", "skipped")}
    lines = [f"{v['file']}: {v['verdict']}" for v in verdicts]
    return "\n".join([*lines, ", ".join(f"{n} {k}" for k, n in total.items())])
