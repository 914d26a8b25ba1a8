"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from tessera.llm import classlm, decontam, langid, media, neardup, ngramjoin, packing, periodic, pii, secrets, spelling, substring, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_media": media.op1_media,
        "op2_language_id": langid.op2_language_id,
        "op3_decontamination": decontam.op3_decontamination,
        "op4_secret_ledger": secrets.op4_secret_ledger,
        "op5_warc": warc.op5_warc,
        "op6_pii": pii.op6_pii,
        "op7_substring_dedup": substring.op7_substring_dedup,
        "op8_class_lm": classlm.op8_class_lm,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_minhash_neardup": neardup.op10_minhash_neardup,
        "op11_ngram_join": ngramjoin.op11_ngram_join,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": decontam.OP3_SQL,
        "op4_secret_ledger": secrets.OP4_SQL,
        "op5_warc": warc.OP5_SQL,
        "op7_substring_dedup": substring.OP7_SQL,
        "op10_minhash_neardup": neardup.OP10_SQL,
        "op11_ngram_join": ngramjoin.OP11_SQL,
        "op12_periodic_runs": periodic.OP12_SQL,
        "op13_spelling_variants": spelling.OP13_SQL,
    }
