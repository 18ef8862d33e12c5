"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each result
as Parquet in the shared folder and rereads it, so a lost executor costs no more than a stage's tasks; when it
ends, only its result and the token files stay there.

Defined results: documents with a null or empty text, or one without letters, go in the first stage, as their
language isn't known. Rows that share a doc_id stay or go together in the second stage, by the group of any of
them; a null doc_id stays. Repeated rows are decided alike and mixed alike. The mixture is stored in its global
order, and the token files hold it in that order: a row of the result is a copy of a document, start is its place.
Extra columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from tidelog.llm import decontaminate, language_id, minhash_join, poisson_mix, token_file
from tidelog.llm.common import drop, table, tidy, written

STAGES = [
    ("language_id", language_id.stage),
    ("minhash_near_dedup", minhash_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("mixing_to_target_weights", poisson_mix.stage),
    ("token_id_output", token_file.stage),
]

#: Trained models, signatures, alignments and a tokenizer have no SQL form; tests hold run() against plain code.
ORACLE_SQL = None


@tidy
def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop(before)
    return docs
