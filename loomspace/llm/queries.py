"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontamination, lattice, licences, packing, quality, repeats, resampling, secrets, similarity, token_counts, turns, url_templates, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_license_scan": licences.query,
    "op3_decontamination": decontamination.query,
    "op4_token_counts": token_counts.query,
    "op5_jaccard_join": similarity.query,
    "op6_warc_revisits": warc.query,
    "op7_secret_scan": secrets.query,
    "op8_lm_scores": lattice.query,
    "op9_suffix_dedup": repeats.query,
    "op10_quality_rules": quality.query,
    "op11_url_filter": url_templates.query,
    "op12_importance_resampling": resampling.query,
    "op13_conversation_repair": turns.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontamination.SQL,
    "op5_jaccard_join": similarity.SQL,
    "op6_warc_revisits": warc.SQL,
    "op9_suffix_dedup": repeats.SQL,
    "op11_url_filter": url_templates.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_conversation_repair": turns.SQL,
}
