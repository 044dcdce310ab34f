"""Logging to the console and, where a path is given, to a file that rolls over into compressed ones."""

from __future__ import annotations

import gzip
import logging
import os
import shutil
from logging.handlers import RotatingFileHandler

FORMAT = "%(asctime)s %(levelname)s %(name)s %(message)s"


def _packed(source: str, target: str) -> None:
    with open(source, "rb") as a, gzip.open(target, "wb") as b:
        shutil.copyfileobj(a, b)
    os.remove(source)


def setup(level: str = "INFO", path: str | None = None, most: int = 10 << 20, keep: int = 5) -> logging.Logger:
    """The logger `quillmill`, set up anew. Driver only: executors log through Spark."""
    log = logging.getLogger("quillmill")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    log.setLevel(level)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        rolling = RotatingFileHandler(path, maxBytes=most, backupCount=keep, encoding="utf-8")
        rolling.namer, rolling.rotator = (lambda name: name + ".gz"), _packed
        handlers.append(rolling)
    for h in handlers:
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    return log
