"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, divergence, langid, minhash, pii, quality, simhash, substring, toxicity, trie, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat_format": chat.op2_chat_format,
    "op3_quality": quality.op3_quality,
    "op4_fingerprints": minhash.op4_fingerprints,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_pii": pii.op6_pii,
    "op7_langid": langid.op7_langid,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
    "op11_divergence": divergence.op11_divergence,
    "op12_warc": warc.op12_warc,
    "op13_trie": trie.op13_trie,
}

ORACLE_SQL = {"op2_chat_format": chat.OP2_SQL, "op8_decontaminate": decontaminate.op8_sql(), "op11_divergence": divergence.OP11_SQL, "op12_warc": warc.OP12_SQL, "op13_trie": trie.OP13_SQL}
