"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from docloom.llm import ann, fim, fingerprints, idcoder, langid, licenses, mixing, pieces, pii, quality, simhash_dedup, urls, variants

QUERIES = {
    "op1_ann": ann.query,
    "op2_simhash_dedup": simhash_dedup.query,
    "op3_pii": pii.query,
    "op4_mixing": mixing.query,
    "op5_token_ids": idcoder.query,
    "op6_licenses": licenses.query,
    "op7_quality": quality.query,
    "op8_sentencepiece": pieces.query,
    "op9_language_id": langid.query,
    "op10_fingerprints": fingerprints.query,
    "op11_url_filter": urls.query,
    "op12_fill_in_middle": fim.query,
    "op13_spelling_variants": variants.query,
}

#: The search of op1 is approximate at every size; tests hold it against brute force.
ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.SQL, "op12_fill_in_middle": fim.SQL}
