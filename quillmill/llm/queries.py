"""The queries of this subpackage over the test tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import ann, audit, bpe, exact_dedup, line_crf, near_dup, packing, periodic, quality, sharding, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_sharding": sharding.query,
    "op3_packing": packing.query,
    "op4_url_filter": url_filter.query,
    "op5_warc": warc.query,
    "op6_quality": quality.query,
    "op7_near_dup": near_dup.query,
    "op8_ann": ann.query,
    "op9_bpe": bpe.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_periodic": periodic.query,
    "op12_audit": audit.query,
    "op13_line_crf": line_crf.query,
}
SQL = {"op4_url_filter": url_filter.SQL, "op5_warc": warc.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_audit": audit.SQL}
