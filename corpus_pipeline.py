"""A training-corpus pipeline: language ID, near-duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  Columns of
docs other than doc_id, text and lang pass through unread, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomix.llm import decontaminate, langid, packing
from fathomix.llm.common import bound_batches, hint_if_small, materialise, table
from fathomix.llm.jaccard_join import JaccardJoin
from fathomix.llm.queries import tokenizer_path

#: Arrow batches of the stages, in bytes: one executor serves all stages in turn, so each has to leave
#: memory to the next.
BATCH = 2 << 20

#: A text whose cosine with its best language stays below this has no language of the corpus.
LEAST_SCORE = 0.03


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter (null and empty texts among them), or like
    no learnt language, go.  Repeated rows and rows with a null doc_id or lang are judged alike; a
    null lang isn't learnt from, and without any lang all documents go."""
    bound_batches(spark, BATCH)
    model = langid.train(docs.filter(~langid.held_out()).select("lang", "text"))
    marked = langid.predict(docs.withColumnsRenamed({c: f"d_{c}" for c in docs.columns if c in ("lang_pred", "score")}), model)
    kept = marked.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group linked at 80 % of five-word
    shingles.

    Texts without words are in no group and stay, as do rows with a null doc_id.  Of rows with one
    doc_id and one text the first in column order stays; other texts under that doc_id stay too."""
    bound_batches(spark, BATCH)
    groups = JaccardJoin(5, 80, 100).join(docs)
    gone = materialise(groups.filter("component_id != doc_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(hint_if_small(gone, 2_000_000), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    text = F.coalesce("text", F.lit(""))
    first = kept.join(hint_if_small(repeated, 2_000_000), "doc_id", "left_semi").groupBy("doc_id", text.alias("_t")).agg(F.min(F.struct(*docs.columns)).alias("_r"))
    first = first.select(*(F.col("_r")[c].alias(c) for c in docs.columns))
    return kept.join(hint_if_small(repeated, 2_000_000), "doc_id", "left_anti").select(*docs.columns).unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  All rows of a doc_id go together; rows with a null
    doc_id, null and empty texts stay."""
    bound_batches(spark, BATCH)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left: a row for each piece.  A null text is empty and still has
    its end id; repeated rows are documents of their own."""
    bound_batches(spark, BATCH)
    return packing.pack_documents(docs, tokenizer_path(), 2048, 0)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Cosines of random vectors, exact set joins over recursion and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's output written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
