"""Every threshold of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # triage
    density_unit: float = 10_000.0
    image_heavy: float = 0.80
    image_some: float = 0.10
    image_light: float = 0.20
    sparse_text: float = 5.0
    dense_text: float = 10.0
    # text layer
    zero_width: float = 0.1
    tiny_font: float = 0.5
    phantom_below: float = 0.40
    ambiguous_low: float = 0.30
    ambiguous_high: float = 0.70
    invisible_cap: float = 0.5
    min_block_chars: int = 1
    # layout
    harvest_overlap: float = 0.5
    caption_pad: float = 5.0
    region_min_confidence: float = 0.3
    layout_dpi: int = 150
    coordinate_tolerance: float = 0.05
    # reading order
    bins: int = 50
    gap_fraction: float = 0.01
    max_depth: int = 20
    bands: int = 10
    column_shift: float = 0.1
    # tables
    row_gap: float = 3.0
    char_gap: float = 4.0
    column_gap_share: float = 0.02
    column_gap_least: float = 5.0
    cell_pad: float = 5.0
    min_rows: int = 2
    min_columns: int = 2
    table_overlap: float = 0.5
    default_page_width: float = 612.0
    # ocr
    ocr_dpi: int = 300
    raster_bytes: int = 50 * 1024 * 1024
    least_dpi: int = 72
    ocr_fallback_below: float = 60.0
    ocr_min_area: int = 25
    # assembly
    native_quality: float = 0.7
    # cross-page
    min_pages: int = 3
    zone_share: float = 0.1
    zone_blocks: int = 3
    default_page_height: float = 842.0
    heading_chars: int = 80
    heading_ratio: float = 1.15
    level_gap: float = 2.0
    # formatting
    max_heading_depth: int = 6
    #: True keeps the reference behaviours that look like defects: pixel boxes of OCR words, shattered words.
    compat: bool = True


DEFAULT = EngineConfig()
