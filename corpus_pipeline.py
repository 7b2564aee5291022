"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet
in the shared folder and reads again as the next stage's docs, so that a lost executor costs
no earlier stage. All but the last return the columns of documents:

- language: documents in no learned language go;
- exact copies: of equal texts the row with the largest id stays;
- near copies: of each class of near duplicates the least id stays;
- secrets: each secret is replaced by its kind in angle brackets;
- packing: one row for each piece of a document in a sequence.
"""

from __future__ import annotations

from tessella.llm.common import table, written
from tessella.llm.exact_dedup import exact_dedup_stage
from tessella.llm.jaccard_join import near_dedup_stage
from tessella.llm.langid import langid_stage
from tessella.llm.packing import packing_stage
from tessella.llm.secrets import secrets_stage

STAGES = [
    ("language", langid_stage),
    ("exact_copies", exact_dedup_stage),
    ("near_copies", near_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
