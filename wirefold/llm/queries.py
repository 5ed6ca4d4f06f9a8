"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from wirefold.llm import (clustering, conversation_repair, decontaminate, exact_dedup, langid, packing, pii, quality,
                          sentencepieces, simhash, tool_calls, url_filter, warc)

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_warc": warc.op3_warc,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_tool_calls": tool_calls.op5_tool_calls,
    "op6_simhash": simhash.op6_simhash,
    "op7_language": langid.op7_language,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_pii": pii.op10_pii,
    "op11_repair": conversation_repair.op11_repair,
    "op12_pieces": sentencepieces.op12_pieces,
    "op13_centroids": clustering.op13_centroids,
}

ORACLE = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op13_centroids": clustering.OP13_SQL,
}
