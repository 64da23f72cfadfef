"""The subpackage's registered queries, and DuckDB SQL where it can express one."""

from __future__ import annotations

from . import alignment, bpe, html_text, mixing, packing, quality_classifier, quality_rules, simhash, spelling, spotsigs, token_files, toxicity, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_html_text": html_text.op2_html_text,
    "op3_warc": warc.op3_warc,
    "warc_history": warc.warc_history,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "op9_bpe": bpe.op9_bpe,
    "op10_token_files": token_files.op10_token_files,
    "op11_alignment": alignment.op11_alignment,
    "op12_mixing": mixing.op12_mixing,
    "op13_spelling": spelling.op13_spelling,
}

#: The other operators need a tokenizer, XXH64, crc32, zstandard, a fitted model, random rounding or Spark's own hashes, which SQL doesn't have;
#: tests hold them against brute force, round trips and held-out labels.
ORACLE_SQL: dict[str, str] = {"op3_warc": warc.ORACLE_SQL}
