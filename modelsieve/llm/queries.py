"""Registered queries of this folder and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modelsieve.llm.op1_arc import SQL as OP1_SQL
from modelsieve.llm.op1_arc import op1_arc_to_warc
from modelsieve.llm.op10_quality import op10_quality_bayes
from modelsieve.llm.op11_sketch import SQL as OP11_SQL
from modelsieve.llm.op11_sketch import op11_threshold_sketch
from modelsieve.llm.op12_whitening import op12_jacobi_davidson_whitening
from modelsieve.llm.op13_merkle import SQL as OP13_SQL
from modelsieve.llm.op13_merkle import op13_merkle_butterfly
from modelsieve.llm.op2_sentencepiece import op2_sentencepiece_n_best
from modelsieve.llm.op3_chat import SQL as OP3_SQL
from modelsieve.llm.op3_chat import op3_chat_events
from modelsieve.llm.op4_epsilon_grid import SQL as OP4_SQL
from modelsieve.llm.op4_epsilon_grid import op4_epsilon_grid_join
from modelsieve.llm.op5_wrapper import op5_wrapper_induction
from modelsieve.llm.op6_simhash import op6_simhash_pigeonring
from modelsieve.llm.op7_secrets import op7_secret_automaton
from modelsieve.llm.op8_outliers import op8_mcd_outliers
from modelsieve.llm.op9_packing import op9_packing_cutting_stock

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_sentencepiece_n_best": op2_sentencepiece_n_best,
    "op3_chat_events": op3_chat_events,
    "op4_epsilon_grid_join": op4_epsilon_grid_join,
    "op5_wrapper_induction": op5_wrapper_induction,
    "op6_simhash_pigeonring": op6_simhash_pigeonring,
    "op7_secret_automaton": op7_secret_automaton,
    "op8_mcd_outliers": op8_mcd_outliers,
    "op9_packing_cutting_stock": op9_packing_cutting_stock,
    "op10_quality_bayes": op10_quality_bayes,
    "op11_threshold_sketch": op11_threshold_sketch,
    "op12_jacobi_davidson_whitening": op12_jacobi_davidson_whitening,
    "op13_merkle_butterfly": op13_merkle_butterfly,
}

ORACLE: dict[str, str] = {
    "op1_arc_to_warc": OP1_SQL,
    "op3_chat_events": OP3_SQL,
    "op4_epsilon_grid_join": OP4_SQL,
    "op11_threshold_sketch": OP11_SQL,
    "op13_merkle_butterfly": OP13_SQL,
}
