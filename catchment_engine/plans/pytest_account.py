"""A pytest plugin that writes the account of a run to the folder in RUN_ACCOUNT_DIR; without
it nothing is written. Use: pytest -p catchment_engine.plans.pytest_account"""

from __future__ import annotations

import os

from .accounting import RunAccounting

_runs: list[RunAccounting] = []


def pytest_collection_finish(session) -> None:
    folder = os.environ.get("RUN_ACCOUNT_DIR")
    if folder:
        run = RunAccounting(folder, sorted({item.nodeid.split("::")[0] for item in session.items}))
        run.start()
        _runs[:] = [run]


def pytest_runtest_logreport(report) -> None:
    if not _runs or (report.when != "call" and report.passed):
        return
    file = report.nodeid.split("::")[0]
    error = report.failed and report.when != "call"
    _runs[0].record(file, report.nodeid, int(report.passed), int(report.failed and not error), error, report.skipped)
    if report.skipped:
        reason = report.longrepr[2] if isinstance(report.longrepr, tuple) else str(report.longrepr)
        _runs[0].skip(report.nodeid, reason)


def pytest_sessionfinish(session) -> None:
    if _runs:
        _runs.pop().finish()
