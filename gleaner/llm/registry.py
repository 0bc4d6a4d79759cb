"""The queries of the pipeline operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontamination, exact_dedup, language_id, lexical_search, line_dedup, mixing, privacy, quality_rules, quality_trees, simhash, spelling, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality_trees.op4_quality,
    "op5_language": language_id.op5_language,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_token_output": token_files.op7_token_output,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_privacy": privacy.op10_privacy,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_spelling": spelling.op12_spelling,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op13_exact_dedup": exact_dedup.OP13_SQL,
}
