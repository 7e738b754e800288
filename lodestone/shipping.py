"""Sends this package to the executors where they do not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_sent: set[str] = set()


def ship(spark) -> None:
    """Once for each application: add the package's sources as a Python file, unless PYTHONPATH, which the workers share, has them."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if context.applicationId in _sent or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _sent.add(context.applicationId)
    target = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")  # served by the driver
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(Path(__file__).parent.rglob("*.py")):
            out.write(p, str(p.relative_to(root)))
    context.addPyFile(target)
