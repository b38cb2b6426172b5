"""One line of JSON for each event of a run, on the standard error stream; standard output belongs to results.

Lines of a run share its run id, so that a run can be put together from them. Without handle() nothing is written.
"""

from __future__ import annotations

import contextvars
import json
import logging
import sys
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

log = logging.getLogger("tessera")
_context: contextvars.ContextVar[dict] = contextvars.ContextVar("tessera_context", default={})


class Lines(logging.Formatter):
    """timestamp, level, message, what the run and the event add."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        entry = {"timestamp": at, "level": {"WARNING": "warn"}.get(record.levelname, record.levelname.lower()), "message": record.getMessage()}
        return json.dumps(entry | _context.get() | getattr(record, "context", {}), ensure_ascii=False)


def handle(level: int = logging.INFO) -> None:
    """Write lines to the standard error stream from now on; asked twice, once."""
    if not any(isinstance(h.formatter, Lines) for h in log.handlers):
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(Lines())
        log.addHandler(handler)
    log.setLevel(level)
    log.propagate = False


@contextmanager
def run(**context) -> Iterator[str]:
    """All lines within carry a run id and context."""
    name = uuid.uuid4().hex
    token = _context.set(_context.get() | {"runId": name} | context)
    try:
        yield name
    finally:
        _context.reset(token)


def event(message: str, **context) -> None:
    log.info(message, extra={"context": context})


@contextmanager
def stage(name: str, **context) -> Iterator[dict]:
    """Logs the start and the end of a stage, how long it took, and what the caller puts into the dictionary; an error is logged and goes on."""
    found: dict = {}
    began = time.monotonic()
    event("stage started", stage=name, **context)
    try:
        yield found
    except Exception as e:
        log.error("stage failed", extra={"context": {"stage": name, "durationMs": round(1000 * (time.monotonic() - began)), "error": str(e).split("\n", 1)[0]}})
        raise
    event("stage complete", stage=name, durationMs=round(1000 * (time.monotonic() - began)), **context, **found)
