"""Fixed limits that the checks and readers share."""

from __future__ import annotations

YEAR_MIN, YEAR_MAX = 1990, 2100
MONEY_TOLERANCE = 0.005
OCR_MIN_CHARS, OCR_MIN_WORDS, OCR_MAX_BAD_RATIO = 20, 3, 0.30
OCR_CELL_MIN_CONF, OCR_PAGE_MIN_CONF, OCR_DPI = 60, 70, 300
ROW_TOLERANCE = 3.0
STATED_COUNT_MAX = 100_000
MAX_PAGES, MAX_PAGE_POINTS = 100, 2880.0
DARK_LEVEL, OCCLUDED_SHARE, VECTOR_DPI = 60, 0.70, 100
A4_WIDTH, A4_HEIGHT, SCALE_SNAP = 595.28, 841.89, 0.02
