"""Queries of the text operators and of the pipeline, and the SQL that they are held against.

``secret_base_spans``, ``media_payload`` and ``bpe_round_trip`` are no operators: each runs the whole operator of its name's kind
and shows the columns that SQL can express, so that these are held against SQL over whole tables too.
"""

from __future__ import annotations

import corpus_pipeline
from eventloom.llm.bpe import BPE_ROUND_TRIP_SQL, bpe_round_trip, op8_bpe
from eventloom.llm.decontaminate import OP10_SQL, op10_benchmark_decontamination
from eventloom.llm.flac import MEDIA_PAYLOAD_SQL, media_payload, op4_media_columns
from eventloom.llm.html_text import OP9_SQL, op9_html_extraction
from eventloom.llm.language import op1_language_id
from eventloom.llm.licenses import OP7_SQL, op7_license_scans
from eventloom.llm.ngram_join import OP2_SQL, op2_ngram_jaccard
from eventloom.llm.secrets import BASE_SPANS_SQL, base_spans, op5_secret_scans
from eventloom.llm.toxicity import op3_toxicity
from eventloom.llm.urls import OP6_SQL, op6_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_ngram_jaccard, op3_toxicity, op4_media_columns, op5_secret_scans,
        op6_url_filters, op7_license_scans, op8_bpe, op9_html_extraction, op10_benchmark_decontamination,
    )
} | {"pipeline": corpus_pipeline.run, "secret_base_spans": base_spans, "media_payload": media_payload, "bpe_round_trip": bpe_round_trip}
ORACLES = {
    "op2_ngram_jaccard": OP2_SQL, "op6_url_filters": OP6_SQL, "op7_license_scans": OP7_SQL, "op9_html_extraction": OP9_SQL,
    "op10_benchmark_decontamination": OP10_SQL, "secret_base_spans": BASE_SPANS_SQL, "media_payload": MEDIA_PAYLOAD_SQL, "bpe_round_trip": BPE_ROUND_TRIP_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
