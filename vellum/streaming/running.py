"""Streams of regions and tokens: running text, kept as state for each document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "image_id int, line_number int, text string, cumulative_text string"
STATE = "cumulative string, cy double, h double, begun boolean"


def running_text(regions: DataFrame) -> DataFrame:
    """Each region that has text and no error, with its document's text so far.

    Regions join the line of the one before if their centres are within 0.8 of the larger height. Regions of a document
    must arrive in order over micro-batches; within one they are put in order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, cy, h, begun = state.get if state.exists else ("", 0.0, 0.0, False)
        rows = pd.concat(list(frames)).sort_values("line_number")
        out = []
        for r in rows.itertuples():
            if pd.isna(r.error) and r.text:
                mid = r.y + r.h / 2
                lead = "" if not begun else " " if abs(mid - cy) < 0.8 * max(r.h, h) else "\n"
                text, cy, h, begun = text + lead + r.text, mid, float(r.h), True
                out.append((key[0], r.line_number, r.text, text))
        state.update((text, cy, h, begun))
        yield pd.DataFrame(out, columns=["image_id", "line_number", "text", "cumulative_text"])

    return regions.groupBy("image_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def token_stream(tokens: DataFrame) -> DataFrame:
    """Each token (doc, step, token) with its document's text so far."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (text,) = state.get if state.exists else ("",)
        rows = pd.concat(list(frames)).sort_values("step")
        upto = []
        for t in rows["token"]:
            text += t
            upto.append(text)
        state.update((text,))
        yield pd.DataFrame({"doc": key[0], "step": rows["step"].to_numpy(), "token": rows["token"].to_numpy(), "cumulative_text": upto})

    return tokens.groupBy("doc").applyInPandasWithState(run, "doc int, step int, token string, cumulative_text string", "text string", "append", GroupStateTimeout.NoTimeout)


def character_stream(tokens: DataFrame) -> DataFrame:
    """Each token (doc, region, step, token, last: whether it is the document's last) with its region's number, whether it
    opens or closes a region, and the document's text so far; a token that closes a region is known by ``closes``.

    Tokens of a document must arrive in order over micro-batches; regions are joined by a line feed.
    """
    out = "doc int, step int, token string, region_number int, region_start boolean, region_finished boolean, document_finished boolean, cumulative_text string"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, region, number = state.get if state.exists else ("", -1, 0)
        got = []
        for r in pd.concat(list(frames)).sort_values("step").itertuples():
            start = number == 0 or r.region != region
            if start:
                text, region, number = text + ("\n" if number else ""), int(r.region), number + 1
            text += r.token
            got.append((key[0], r.step, r.token, number, start, bool(r.closes), bool(r.last), text))
        state.update((text, region, number))
        yield pd.DataFrame(got, columns=["doc", "step", "token", "region_number", "region_start", "region_finished", "document_finished", "cumulative_text"])

    return tokens.groupBy("doc").applyInPandasWithState(run, out, "text string, region int, number int", "append", GroupStateTimeout.NoTimeout)


def final_texts(chunks: DataFrame) -> DataFrame:
    """The last text of each document and its number of steps, from running rows (batch, or complete/update mode)."""
    return chunks.groupBy("doc").agg(F.max_by("cumulative_text", "step").alias("text"), F.count("*").alias("steps"))


def event_windows(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, late rows dropped after the watermark."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
