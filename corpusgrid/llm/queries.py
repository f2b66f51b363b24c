"""Queries of the operators of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from corpusgrid.llm import decontaminate, divergence, licenses, quality, ranked
from corpusgrid.llm.bpe import op4_bpe
from corpusgrid.llm.decontaminate import op13_decontamination
from corpusgrid.llm.divergence import op11_source_divergence
from corpusgrid.llm.embeddings import op8_embedding_near_dedup
from corpusgrid.llm.html import op7_html_extraction
from corpusgrid.llm.jaccard import op9_jaccard_join
from corpusgrid.llm.langid import op3_language_id
from corpusgrid.llm.licenses import op6_license_scan
from corpusgrid.llm.mixing import op5_mixing
from corpusgrid.llm.pii import op10_pii
from corpusgrid.llm.quality import op1_quality_rules
from corpusgrid.llm.ranked import op12_ranked_search
from corpusgrid.llm.suffixes import op2_suffix_dedup

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_html_extraction": op7_html_extraction,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_pii": op10_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_decontamination": op13_decontamination,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op6_license_scan": licenses.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op12_ranked_search": ranked.ORACLE_SQL,
    "op13_decontamination": decontaminate.ORACLE_SQL,
}
