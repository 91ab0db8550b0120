"""The queries of this subpackage: name to function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from graphlens.llm import chat, fim, jaccard, lexical, topk, warc
from graphlens.llm.chat import op6_chat_formatting
from graphlens.llm.credentials import op11_secret_scans
from graphlens.llm.fim import op12_fill_in_middle
from graphlens.llm.jaccard import op2_jaccard_join
from graphlens.llm.lexical import op13_ranked_lexical_search
from graphlens.llm.lm import op4_lm_scoring
from graphlens.llm.mixing import op3_mixing_sources
from graphlens.llm.packing import op10_best_fit_packing
from graphlens.llm.quality import op9_quality_rules
from graphlens.llm.sharding import op5_sharding
from graphlens.llm.topk import op1_exact_topk
from graphlens.llm.urls import op7_url_filters
from graphlens.llm.warc import op8_warc

QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mixing_sources": op3_mixing_sources,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_sharding": op5_sharding,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_url_filters": op7_url_filters,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_secret_scans": op11_secret_scans,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ranked_lexical_search": op13_ranked_lexical_search,
}

ORACLES: dict[str, str] = {
    "op1_exact_topk": topk.ORACLE,
    "op2_jaccard_join": jaccard.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op8_warc": warc.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_ranked_lexical_search": lexical.ORACLE,
}
