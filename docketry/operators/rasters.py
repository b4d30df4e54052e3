"""Repairs of page pictures: rows of pixels in, rows of pixels out. What decodes a picture is the source's business."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

INK = 120


def stretched(gray: np.ndarray, *, least_range=80) -> np.ndarray:
    """A flat page's greys spread over the whole range; others as they are."""
    low, high = np.percentile(gray, (1.0, 99.0))
    a, b = int(gray.min()), int(gray.max())
    if high - low >= least_range or a == b:
        return gray
    return np.rint((gray.astype(float) - a) * 255.0 / (b - a)).astype(np.uint8)


def left_margins(gray: np.ndarray) -> np.ndarray:
    """(row, first column with ink) of every row that has any."""
    ink = gray < INK
    rows = np.flatnonzero(ink.any(axis=1))
    return np.stack((rows, ink[rows].argmax(axis=1)), axis=1)


def robust_line(points: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """(slope, shift) of x over y with the least sum of absolute distances, by reweighting."""
    y, x = points[:, 0].astype(float), points[:, 1].astype(float)
    slope, shift = 0.0, float(np.median(x))
    for _ in range(rounds):
        weight = 1 / np.maximum(1e-3, np.abs(x - slope * y - shift))
        middle_y, middle_x = np.average(y, weights=weight), np.average(x, weights=weight)
        spread = np.average((y - middle_y) ** 2, weights=weight)
        new = float(np.average((y - middle_y) * (x - middle_x), weights=weight) / spread) if spread else 0.0
        done = abs(new - slope) < 1e-9
        slope, shift = new, float(middle_x - new * middle_y)
        if done:
            break
    return slope, shift


def realigned(gray: np.ndarray) -> tuple[np.ndarray, int]:
    """Strips that slipped sideways, put back: every row's left margin onto one line. The picture and how many rows moved."""
    margins = left_margins(gray)
    if len(margins) < 10:
        return gray, 0
    slope, shift = robust_line(margins)
    out, moved, width = gray.copy(), 0, gray.shape[1]
    for y, x in margins.tolist():
        by = round(slope * y + shift - x)
        if by == 0:
            continue
        out[y] = 255
        if abs(by) < width:  # else nothing of the row would stay
            if by > 0:
                out[y, by:] = gray[y, :-by]
            else:
                out[y, :by] = gray[y, -by:]
            moved += 1
    return out, moved


def repair_pages(pages: DataFrame) -> DataFrame:
    """pages (case_id, page_no, height, width, pixels binary) -> the same, stretched and realigned, with `moved`; pixels of another size than height x width stay as they are."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            out, moved = [], []
            for height, width, raw in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if raw is None or not height or not width or len(raw) != height * width:
                    out.append(raw)
                    moved.append(0)
                    continue
                picture, n = realigned(stretched(np.frombuffer(raw, dtype=np.uint8).reshape(height, width)))
                out.append(picture.tobytes())
                moved.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary()), pa.array(moved, pa.int32())], ["case_id", "page_no", "height", "width", "pixels", "moved"])

    return pages.select("case_id", "page_no", "height", "width", "pixels").mapInArrow(run, "case_id string, page_no int, height int, width int, pixels binary, moved int")


def margins_of(pages: DataFrame) -> DataFrame:
    """pages -> (case_id, page_no, y, x): left margins as rows."""
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for case_id, page_no, height, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if raw is not None and height and width and len(raw) == height * width:
                    found = left_margins(np.frombuffer(raw, dtype=np.uint8).reshape(height, width))
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([case_id] * n, pa.string()), pa.array([page_no] * n, pa.int32()), pa.array(found[:, 0], pa.int32()), pa.array(found[:, 1], pa.int32())], ["case_id", "page_no", "y", "x"])

    return pages.select("case_id", F.col("page_no").cast("int"), F.col("height").cast("int"), F.col("width").cast("int"), "pixels").mapInArrow(run, "case_id string, page_no int, y int, x int")
