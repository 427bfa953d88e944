"""Documents to text: boxes by a detector, texts by a recogniser, put together; in batches and as streams."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import layout
from vellum.plans import models
from vellum.streaming import running

Detector = Callable[[DataFrame], DataFrame]


class Reader:
    """Reads images (image_id, and what its models need).

    detectors: functions of images that give boxes (image_id, x, y, w, h, confidence); the first that works is used.
    ordered: whether their boxes come as lines already; else they are put in reading order and merged vertically.
    recogniser: a key and a function that makes the model, once a worker (see models.recognise).
    """

    def __init__(self, detectors: list[Detector], recogniser: tuple[tuple, Callable[[], Any]], ordered: bool = True) -> None:
        self.detectors, self.recogniser, self.ordered = detectors, recogniser, ordered

    def lines(self, images: DataFrame) -> DataFrame:
        """(image_id, line_number, x, y, w, h, det_confidence): lines in reading order, numbered from 1."""
        found = models.detect(images, self.detectors)
        if not self.ordered:
            numbered = found.withColumn("box_id", F.row_number().over(layout.image().orderBy("y", "x", "w", "h")))
            found = layout.merge_vertical(layout.reading_order(numbered))
        order = layout.image().orderBy("pos") if "pos" in found.columns else layout.image().orderBy("y", "x", "w", "h")
        return found.select("image_id", F.row_number().over(order).alias("line_number"), *"xywh", F.col("confidence").alias("det_confidence"))

    def regions(self, images: DataFrame, strict: bool = False) -> DataFrame:
        """Lines with text, confidence and error; numbers are given before failures, so those leave gaps."""
        return models.recognise(self.lines(images).join(images, "image_id"), *self.recogniser, strict=strict)

    def text(self, images: DataFrame) -> DataFrame:
        """(image_id, text) of each image with a region, words and lines put together."""
        return layout.document_text(self.regions(images).where(F.col("error").isNull() & (F.length("text") > 0)))

    def results(self, images: DataFrame) -> DataFrame:
        """Regions that were read, with the document's text up to each."""
        return layout.cumulative_text(self.regions(images))

    @staticmethod
    def running(regions: DataFrame) -> DataFrame:
        """The same over a stream of regions."""
        return running.running_text(regions)


def detect_text_lines(boxes: DataFrame, width: int, height: int) -> DataFrame:
    return layout.detect(boxes, width, height, "line")


def detect_text_words(boxes: DataFrame, width: int, height: int) -> DataFrame:
    return layout.detect(boxes, width, height, "word")


def detect_text_blocks(boxes: DataFrame, width: int, height: int) -> DataFrame:
    return layout.detect(boxes, width, height, "block")
