"""Queries of this subpackage: name -> Spark function, and SQL where SQL can
express the whole result."""

from __future__ import annotations

from penprint.llm.bytebpe import op11_byte_bpe
from penprint.llm.decontaminate import op5_decontaminate
from penprint.llm.fingerprints import op9_fingerprints
from penprint.llm.jaccard import op6_jaccard_join
from penprint.llm.katz import op7_language_model
from penprint.llm.language import op4_language_id
from penprint.llm.licenses import OP1_SQL, op1_license_scan
from penprint.llm.packing import op8_packing
from penprint.llm.prefixes import OP12_SQL, op12_prefix_trie
from penprint.llm.repair import OP13_SQL, op13_conversation_repair
from penprint.llm.substrings import OP3_SQL, op3_substring_dedup
from penprint.llm.suffixes import op2_suffix_dedup
from penprint.llm.tokenfile import op10_token_files

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_model": op7_language_model,
    "op8_packing": op8_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_token_files": op10_token_files,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
