"""Tunables with their defaults; pass another instance to change them."""

from __future__ import annotations

from dataclasses import dataclass


def comma_list(value: str) -> tuple[str, ...]:
    """Trimmed, non-empty items of a comma list."""
    return tuple(x.strip() for x in value.split(",") if x.strip())


@dataclass(frozen=True)
class Config:
    # retrieval
    dense_k: int = 20
    bm25_k: int = 20
    fused_k: int = 10
    final_k: int = 5
    rrf_k: int = 60
    list_cap: int = 25
    figure_candidates: int = 3
    overview_candidates: int = 2
    acronym_k: int = 10
    high: float = 0.75
    low: float = 0.40
    rerank_floor: float = -10.5
    floor_penalty: float = 0.35
    # guards and memory
    query_chars: int = 500
    answer_tokens: int = 600
    memory_messages: int = 10
    short_query_words: int = 8
    # transcripts and screens
    window_chars: int = 700
    window_seconds: float = 60.0
    overview_chars: int = 1500
    slack_seconds: float = 2.0
    carry_seconds: float = 120.0
    screen_chars: int = 1400
    figure_similarity: float = 0.90
    figures_most: int = 6
    frame_gap_seconds: float = 30.0
    scene_change: float = 0.3
    frames_most: int = 400
    ocr_min_chars: int = 15
    # sheets
    metadata_columns: int = 25
    metadata_chars: int = 200
    distinct_values: int = 12
    # pages
    band: float = 0.10
    sampled_pages: int = 5
    min_block: int = 30
    min_image_px: int = 90
    min_area: float = 0.05
    min_width_pt: float = 170
    min_height_pt: float = 120
    full_page: float = 0.90
    full_page_text: int = 450
    repeat_pages: int = 4
    caption_gap: float = 60
    context_gap: float = 180
    context_chars: int = 700
    rect_tolerance: float = 3.0
    min_drawings: int = 20
    # uploads
    upload_bytes: int = 500 * 1024 * 1024
    # sensitivity
    high_keywords: tuple[str, ...] = comma_list("salary,payroll,confidential,executive,password,credential")
    medium_keywords: tuple[str, ...] = ("internal", "restricted", "proprietary", "do not distribute", "not for distribution", "draft", "preliminary")


DEFAULT = Config()
COLLECTIONS = ("pdf", "incident", "defect", "video")
SHEET_COLLECTIONS = ("incident", "defect")
