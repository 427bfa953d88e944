"""Where networks plug in: detectors and recognisers as functions over batches, one session a worker.

No weights come with this package, so recognition quality isn't checked here; the interface is, by stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

_SESSIONS: dict[tuple, Any] = {}
METHODS = {"fast": "ctc", "ctc": "ctc", "accurate": "decoder", "decoder": "decoder", "beam": "beam"}


def session(key: tuple, make: Callable[[], Any]) -> Any:
    """One object for each key in a worker process."""
    if key not in _SESSIONS:
        _SESSIONS[key] = make()
    return _SESSIONS[key]


def method(name: Column) -> Column:
    """The decode method that a name stands for; an unknown one raises."""
    n, out = F.lower(T.strip(name)), None
    for alias, what in METHODS.items():
        out = F.when(n == alias, what) if out is None else out.when(n == alias, what)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown decode method: "), name)))


def recognise(regions: DataFrame, key: tuple, make: Callable[[], Callable[[pd.DataFrame], list[tuple[str, float]]]], strict: bool = False) -> DataFrame:
    """Adds text, confidence and error by a model over batches of regions. A batch that fails gives error rows, or with
    ``strict`` no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = session(key, make)(b)
                yield b.assign(text=[t for t, _ in got], confidence=[float(c) for _, c in got], error=None)
            except Exception as e:  # noqa: BLE001  a region's failure is data
                if not strict:
                    yield b.assign(text="", confidence=0.0, error=str(e))

    base = regions.drop("text", "confidence", "error")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInPandas(run, f"{names}, text string, confidence double, error string")


def detect(images: DataFrame, detectors: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Boxes by the first detector that can be planned; the next one stands in for one that raises."""
    last: Exception | None = None
    for d in detectors:
        try:
            return d(images)
        except Exception as e:  # noqa: BLE001
            last = e
    raise RuntimeError("no detector worked") from last
