"""The queries of this subpackage and their SQL."""

import corpus_pipeline

from . import decontaminate, epsilon_grid, fuzzy_lines, language_id, minhash_join, poisson_mix, quality_rules, repeat_tree, secret_scan, token_file

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_poisson_mix_whole": poisson_mix.op1_poisson_mix_whole,
    "op1_poisson_mix": poisson_mix.op1_poisson_mix,
    "op2_epsilon_grid": epsilon_grid.op2_epsilon_grid,
    "op3_token_file": token_file.op3_token_file,
    "op4_minhash_join": minhash_join.op4_minhash_join,
    "op5_fuzzy_lines": fuzzy_lines.op5_fuzzy_lines,
    "op6_repeat_tree": repeat_tree.op6_repeat_tree,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_language_id": language_id.op8_language_id,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

SQL = {"op1_poisson_mix": poisson_mix.OP1_SQL, "op1_poisson_mix_whole": poisson_mix.OP1_WHOLE_SQL}
