"""The training-data pipeline: five stages from raw documents to packed sequences.

Each stage takes all that its predecessor kept and gives documents again, but
for the last, which gives the pieces of packed sequences.
"""

from __future__ import annotations

from tracelake.llm import decontaminate, language, lines, nearcopies, packing
from tracelake.llm.common import table, written

#: Near copies: shingles of five words, sets 80 % alike.
WIDTH, PERCENT = 5, 80


def identify(spark, docs, sf_dir):
    """Documents whose language is not identified go."""
    return language.keep_identified(docs, language.fit(docs))


def dedup_lines(spark, docs, sf_dir):
    """Repeated and almost repeated lines go, and documents with nothing else."""
    return lines.clean(docs)


def dedup_documents(spark, docs, sf_dir):
    """Of each group of near copies one document stays."""
    return nearcopies.keep_one(docs, WIDTH, PERCENT)


def decontaminate_texts(spark, docs, sf_dir):
    """Documents with two benchmark items or more go; passages of one item are cut out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Pieces of documents in sequences of 1,024 tokens."""
    return packing.pack_public(docs)


STAGES = [("language", identify), ("lines", dedup_lines), ("near_copies", dedup_documents), ("decontamination", decontaminate_texts), ("packing", pack)]
#: Scoring in numpy, edit-distance classes and tokenising have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
