"""Spark types of the engine's tables and the domains of their string columns."""

from __future__ import annotations

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
CONFIDENCE = "struct<text_quality:double,order_quality:double,type_quality:double,method_score:double,final:double>"

PAGE = "doc_id string, page_num int, width double, height double, text string, image_boxes array<" + BBOX + ">"
RAW_BLOCK = (
    "doc_id string, page_num int, block_no int, type int, bbox " + BBOX + ", "
    "lines array<struct<spans:array<struct<font:string,size:double,chars:array<struct<c:string,bbox:" + BBOX + ">>>>>>"
)
BLOCK = (
    "doc_id string, page_num int, seq int, block_id string, text string, bbox " + BBOX + ", block_type string, "
    "extraction_method string, confidence " + CONFIDENCE + ", parent_id string, language string, script_direction string"
)
REGION = "doc_id string, page_num int, region_seq int, bbox " + BBOX + ", label string, confidence double"
RULED_TABLE = "doc_id string, page_num int, table_no int, bbox " + BBOX + ", rows array<array<string>>"
OCR_WORD = "doc_id string, page_num int, i int, text string, conf double, `left` int, top int, width int, height int, block_num int, par_num int"
WARNING = "doc_id string, page_num int, stage int, seq int, msg string"
ERROR = "path string, message string"

BLOCK_TYPES = ("body", "heading", "table", "figure", "caption", "header", "footer", "footnote")
METHODS = ("pymupdf_direct", "surya_layout", "surya_ocr", "tesseract_ocr")
NATIVE = ("pymupdf_direct", "tesseract_ocr")
TRIAGE = ("text_native", "ocr_needed", "hybrid")

DEFAULTS = {"text_quality": 1.0, "order_quality": 0.8, "type_quality": 0.7, "method_score": 1.0, "final": 0.0}
