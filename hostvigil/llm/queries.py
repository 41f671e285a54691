"""Registered queries of the training-data operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostvigil.llm.bpe import op6_bpe
from hostvigil.llm.decontaminate import op1_decontamination
from hostvigil.llm.embedding_dedup import ORACLE as EMBEDDING_ORACLE
from hostvigil.llm.embedding_dedup import op12_embedding_dedup
from hostvigil.llm.html_text import op10_html_text
from hostvigil.llm.prefix_trie import ORACLE as TRIE_ORACLE
from hostvigil.llm.prefix_trie import op11_prefix_trie
from hostvigil.llm.quality import ORACLE, op9_quality_rules
from hostvigil.llm.resampling import ORACLE as RESAMPLING_ORACLE
from hostvigil.llm.resampling import op13_importance_resampling
from hostvigil.llm.sharding import op5_sharding
from hostvigil.llm.simhash import op3_simhash
from hostvigil.llm.suffix_dedup import op7_suffix_dedup
from hostvigil.llm.suffix_tree_lm import op8_suffix_tree_lm
from hostvigil.llm.token_counts import op2_token_counts
from hostvigil.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_token_counts, op3_simhash, op4_toxicity, op5_sharding, op6_bpe, op7_suffix_dedup, op8_suffix_tree_lm, op9_quality_rules, op10_html_text, op11_prefix_trie, op12_embedding_dedup, op13_importance_resampling)}

ORACLE_SQL: dict[str, str] = {"op9_quality_rules": ORACLE, "op11_prefix_trie": TRIE_ORACLE, "op12_embedding_dedup": EMBEDDING_ORACLE, "op13_importance_resampling": RESAMPLING_ORACLE}
