"""From raw documents to packed sequences, in five stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, as_own, own_columns, read
from scanforge.llm.line_dedup import apply_bitmaps, keep_bitmaps
from scanforge.llm.mixture_packing import pack_mixture, reads_files
from scanforge.llm.pfair import in_mixed_order, mix_sources, root_weights
from scanforge.llm.probminhash import drop_near_documents
from scanforge.llm.queries import PIECES, TOKENIZER
from scanforge.llm.weak_quality import quality


def _beside(docs: DataFrame, *used: str) -> list[str]:
    """The columns that a stage only carries, as one, so that their names clash with no result's."""
    return [c for c in docs.columns if c not in used]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality(docs.select("text", as_own(docs)), carry=["own"]).where("kept").select(*own_columns(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that loses all of them stays, empty. ``n_chars``, if there, follows the text."""
    carried = docs.select("doc_id", "text", as_own(docs, _beside(docs, "text")))
    found = apply_bitmaps(carried, keep_bitmaps(docs))
    lost = F.col("n_dropped") > 0
    new = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(lost, F.length("kept_text").cast(kind)).otherwise(F.col("own.n_chars"))
    return found.select(*(new[c].alias(c) if c in new else F.col("own").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the mixture of sources."""
    used = ("doc_id", "text", "source")
    mixed = in_mixed_order(mix_sources(docs.select(*used, as_own(docs, [*_beside(docs, *used), "doc_id"]))))
    return mixed.select(*(F.col(c) if c in used else F.col("own").getField(c).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens: each source in the order that the mixture gave it, by the same weights.

    The order is read from the files that the stage before wrote and the rows' places in them, whichever task reads
    them; no text is shuffled for it.
    """
    docs = docs.select("doc_id", "text", "source")
    return pack_mixture(docs, TOKENIZER, weights=root_weights(docs), in_file_order=reads_files(docs)).select(*PIECES)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Expectation-maximisation, MinHash and token ids are beyond SQL; tests/llm has the whole in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return docs
