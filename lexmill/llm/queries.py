"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from lexmill.llm import bpe, decontaminate, infill, licenses, lines, manifest, pieces, pii, sharding, simhash, topk, toxicity, warc

QUERIES = {
    "op1_lines": lines.op1_lines,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_topk": topk.op4_topk,
    "op5_kd_shards": sharding.op5_kd_shards,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_warc": warc.op7_warc,
    "op8_pii": pii.op8_pii,
    "op9_licenses": licenses.op9_licenses,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_sentencepiece": pieces.op12_sentencepiece,
    "op13_merkle": manifest.op13_merkle,
}
SQL = {
    "op4_topk": topk.OP4_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op11_fill_in_middle": infill.OP11_SQL,
    "op13_merkle": manifest.OP13_SQL,
}
