"""Corpus preparation: five stages over documents, each stored as Parquet and read again by the next.

toxicity -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from fleettrack.llm.pipeline import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Toxicity is a fitted model, and packing needs a tokenizer: no SQL has these rows; tests hold run() against a plain version.
ORACLE_SQL = None
