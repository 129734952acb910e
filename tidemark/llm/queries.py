"""Queries of the training-data operators and, where SQL expresses them, their DuckDB equivalents."""

from __future__ import annotations

from tidemark.llm import ann, bpe, conversations, decontam, filter_audit, html_blocks, minhash, packing, pst, quality, suffix_dedup, toxicity, warc

QUERIES = {
    "op5_minhash_join": minhash.op5,
    "op1_warc_revisits": warc.op1,
    "op2_suffix_tree": pst.op2,
    "op3_toxicity": toxicity.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op6_block_join_ann": ann.op6,
    "op7_bpe_codec": bpe.op7,
    "op10_quality": quality.op10,
    "op8_html_blocks": html_blocks.op8,
    "op9_decontamination": decontam.op9,
    "op11_packing": packing.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_conversation_repair": conversations.op13,
}

ORACLES = {
    "op1_warc_revisits": warc.OP1_SQL,
    "op6_block_join_ann": ann.OP6_SQL,
    "op5_minhash_join": minhash.OP5_SQL,
    "op9_decontamination": decontam.OP9_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
