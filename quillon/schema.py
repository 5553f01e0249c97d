"""Schemas of the engine's datasets."""

from __future__ import annotations

ELEMENTS = (
    "doc_id string, ordinal int, id string, page int, bbox array<double>, kind string, text string, font_size double, bold boolean, "
    "level int, rows array<array<string>>, row_boxes array<array<double>>, header array<string>, table_id string, extraction string, confidence double, excluded boolean"
)
CASES = "query string, category string, case_id string, intent string, model_answer string, answer_evidence array<array<string>>, relevant array<struct<source string, pages array<int>>>"
CHUNKS = (
    "id string, doc_id string, section_id string, section_path array<string>, kind string, text string, context string, "
    "element_ids array<string>, token_count int, ordinal int, previous_id string, next_id string, table_id string, row_range array<int>, row_fragment boolean"
)
