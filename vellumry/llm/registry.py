"""Queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import op3_chat_masks
from .decontamination import op2_contaminated
from .language_id import op1_language
from .license_scan import op9_licenses
from .media_columns import ORACLE as MEDIA_ORACLE
from .media_columns import op4_webp_pixels
from .minhash_dedup import op7_near_duplicates
from .packing import op6_packed
from .pii import op8_private_data
from .substring_dedup import op10_repeated_passages
from .url_reputation import ORACLE as URL_ORACLE
from .url_reputation import op5_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_contaminated": op2_contaminated,
    "op3_chat_masks": op3_chat_masks,
    "op4_webp_pixels": op4_webp_pixels,
    "op5_url_filter": op5_url_filter,
    "op6_packed": op6_packed,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_private_data": op8_private_data,
    "op9_licenses": op9_licenses,
    "op10_repeated_passages": op10_repeated_passages,
}

ORACLE_SQL: dict[str, str] = {"op4_webp_pixels": MEDIA_ORACLE, "op5_url_filter": URL_ORACLE}
