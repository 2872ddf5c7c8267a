"""Measurements written in echocardiography notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.values import capture, masked_number, parse_time

# --- fixed values: note patterns, first group is the captured text -----------------------
TIME_PATTERN = r"Date/Time: [\[\]0-9*-]+ at ([0-9:]+)"
NUMBER_PATTERNS = {
    "height": r"Height: \(in\) (.*?)\n",
    "weight": r"Weight \(lb\): (.*?)\n",
    "bsa": r"BSA \(m2\): (.*?) m2\n",
    "bpsys": r"BP \(mm Hg\): ([0-9]+)/[0-9]+?\n",
    "bpdias": r"BP \(mm Hg\): [0-9]+/([0-9]+?)\n",
    "hr": r"HR \(bpm\): ([0-9]+?)\n",
}
TEXT_PATTERNS = {
    "indication": r"Indication: (.*?)\n",
    "bp": r"BP \(mm Hg\): (.*?)\n",
    "status": r"Status: (.*?)\n",
    "test": r"Test: (.*?)\n",
    "doppler": r"Doppler: (.*?)\n",
    "contrast": r"Contrast: (.*?)\n",
    "technicalquality": r"Technical Quality: (.*?)\n",
}
CATEGORY = "Echo"


def note_time(date, text):
    """Timestamp from the note's date and the clock time in its text."""
    clock = capture(text, TIME_PATTERN)
    return parse_time(F.concat(date.cast("string"), F.lit(" "), clock), "yyyy-MM-dd HH:mm")


def echo_notes(notes: DataFrame) -> DataFrame:
    """One row per echo note; masked numbers become null. The whole text is searched."""
    text = F.col("text")
    return notes.filter(F.col("category") == CATEGORY).select(
        "row_id", "subject_id", "hadm_id", "chartdate", note_time(F.col("chartdate"), text).alias("charttime"),
        *[masked_number(capture(text, p)).alias(n) for n, p in NUMBER_PATTERNS.items()],
        *[capture(text, p).alias(n) for n, p in TEXT_PATTERNS.items()],
    )
