"""Packet files: a directory scan, and a decoder that can be plugged in. What cannot be decoded is a row with an error, never a failed query."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

PAGES = "case_id string, page_no int, visible_native string, hidden string, ocr_text string, rapid_text string, ocr_confidence double, is_scanned boolean, error string"


def scan_packets(spark: SparkSession, path: str) -> DataFrame:
    """(path, case_id, content) of the *.pdf files of a directory, not of those below it. Rows have no order: what needs one sorts by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("case_id"), "content")


def decode(files: DataFrame, decoder: Callable[[str, bytes], Iterable[dict]]) -> DataFrame:
    """Pages of every packet. decoder(case_id, content) yields dicts with the columns of PAGES; an exception becomes one row with an error."""
    ship(files.sparkSession)
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [tuple(part.split(" ")) for part in PAGES.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for case_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [{"case_id": case_id, **page} for page in decoder(case_id, content)]
                except Exception as e:  # noqa: BLE001 - isolation of a packet is the contract
                    rows.append({"case_id": case_id, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields])

    return files.select("case_id", "content").mapInArrow(run, PAGES)


def pymupdf_decoder(case_id: str, content: bytes):
    """Native text of each page with PyMuPDF, where it is installed. Spans are judged by `operators.ingest` when the spans table is wanted instead."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as document:
        for number, page in enumerate(document, 1):
            yield {"page_no": number, "visible_native": page.get_text("text"), "hidden": "", "ocr_text": "", "rapid_text": "", "ocr_confidence": 0.0, "is_scanned": not page.get_text("text").strip()}


def trusted_pages(pages: DataFrame) -> DataFrame:
    """Decoded pages -> what extraction may read: instructions scrubbed, hidden text reduced to a flag."""
    from ..operators.ingest import instructs, is_scanned, scrub

    seen = F.lit(False)
    for c in ("visible_native", "ocr_text", "rapid_text"):
        seen = seen | F.coalesce(instructs(F.col(c)), F.lit(False))
    clean = {c: scrub(F.coalesce(c, F.lit(""))) for c in ("visible_native", "ocr_text", "rapid_text")}
    flagged = pages.where("error is null").withColumn("injection_seen", seen | (F.length(F.trim(F.coalesce("hidden", F.lit("")))) > 0))
    scanned = is_scanned(F.coalesce("visible_native", F.lit("")))
    return flagged.withColumn("is_scanned", scanned).withColumns(clean).drop("hidden", "error")
