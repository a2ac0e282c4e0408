"""Queries of this subpackage and their SQL."""

from . import decontamination, jaccard_join, line_dedup, mixing, periodic_runs, quality_rules, secret_scan, sharding
from . import spelling_variants, token_counts, toxicity, url_filters, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_ngram_jaccard_join": jaccard_join.query,
    "op3_mixing": mixing.query,
    "op4_warc": warc.query,
    "op5_secret_scan": secret_scan.query,
    "op6_url_filters": url_filters.query,
    "op7_quality_rules": quality_rules.query,
    "op8_sharding": sharding.query,
    "op9_token_counts": token_counts.query,
    "op10_decontamination": decontamination.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_toxicity": toxicity.query,
    "op13_periodic_runs": periodic_runs.query,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_ngram_jaccard_join": jaccard_join.SQL,
    "op3_mixing": mixing.SQL,
    "op4_warc": warc.SQL,
    "op6_url_filters": url_filters.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op11_spelling_variants": spelling_variants.SQL,
}
