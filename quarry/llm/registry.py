"""Queries of this package by name, and the SQL that DuckDB compares them with."""

from quarry.llm.bpe import op9_bpe
from quarry.llm.decontaminate import OP6_SQL, op6_benchmark_decontamination
from quarry.llm.html_text import op8_html_text
from quarry.llm.license_scan import op2_license_scan
from quarry.llm.merkle import OP12_SQL, op12_merkle_manifest
from quarry.llm.ngram_join import OP5_SQL, op5_ngram_join
from quarry.llm.phrases import OP11_SQL, op11_phrase_mining
from quarry.llm.quality_classifier import op10_quality_classifier
from quarry.llm.quality_rules import op4_quality_rules
from quarry.llm.sharding import op1_balanced_shards
from quarry.llm.simhash import op13_simhash_near_dedup
from quarry.llm.suffix_dedup import OP3_SQL, op3_suffix_dedup
from quarry.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_balanced_shards": op1_balanced_shards,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_join": op5_ngram_join,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_html_text": op8_html_text,
    "op9_bpe": op9_bpe,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}
ORACLES = {"op3_suffix_dedup": OP3_SQL, "op5_ngram_join": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op11_phrase_mining": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
