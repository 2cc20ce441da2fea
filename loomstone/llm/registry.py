"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    boosted_quality, centroid_langid, chosen_path, filter_audit, host_trust, line_chunks, projection_passes, snapshot_diff, source_mixing, string_tiling, token_files, warc_archive, weighted_sampling,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_roundtrip": warc_archive.op1_warc_roundtrip,
    "op2_token_files": token_files.op2_token_files,
    "op3_boosted_quality": boosted_quality.op3_boosted_quality,
    "op4_string_tiling": string_tiling.op4_string_tiling,
    "op5_line_chunks": line_chunks.op5_line_chunks,
    "op6_chosen_path": chosen_path.op6_chosen_path,
    "op7_source_mixing": source_mixing.op7_source_mixing,
    "op8_centroid_langid": centroid_langid.op8_centroid_langid,
    "op9_weighted_sampling": weighted_sampling.op9_weighted_sampling,
    "op10_host_trust": host_trust.op10_host_trust,
    "op11_snapshot_diff": snapshot_diff.op11_snapshot_diff,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_projection_passes": projection_passes.op13_projection_passes,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_roundtrip": warc_archive.OP1_SQL,
    "op5_line_chunks": line_chunks.OP5_SQL,
    "op6_chosen_path": chosen_path.OP6_SQL,
    "op11_snapshot_diff": snapshot_diff.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_projection_passes": projection_passes.OP13_SQL,
}
