"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, html, itq, licenses, lm, minhash, packing, quality, secrets


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
        "op6_lm_score": lm.op6_lm_score,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_html_extract": html.op9_html_extract,
        "op10_itq_near_dedup": itq.op10_itq_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op5_minhash_near_dedup": minhash.SQL, "op10_itq_near_dedup": itq.SQL}
