"""The queries opN_<name> of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact, gam, lines, packing, perplexity, revisits, secrets, simhash, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_near_dedup,
        packing.op2_packing,
        bpe.op3_bpe_encode_decode,
        revisits.op4_warc_revisits,
        toxicity.op5_toxicity,
        lines.op6_line_dedup,
        exact.op7_exact_dedup,
        perplexity.op8_quality_rules,
        secrets.op9_secret_scans,
        gam.op10_quality_classifier,
    )
}

ORACLE_SQL: dict[str, str] = {"op4_warc_revisits": revisits.OP4_SQL, "op7_exact_dedup": exact.OP7_SQL, "op9_secret_scans": secrets.OP9_SQL}
