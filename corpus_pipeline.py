"""From raw documents to training pieces: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the
shared folder and reads again as the next stage's docs. All but the last return the columns
of documents, whatever further columns there are. Null and empty texts are one group of
copies; rows without or with a repeated doc_id are judged one by one; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrollup.llm import exact_dedup, jaccard_join, mixing, pieces, queries, toxicity
from fieldrollup.llm.common import Staging, staged, sweep, table

#: The near-duplicate stage: five words and a similarity of 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where("predicted = 0").select("row.*")


def _identified(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and a column that tells their rows apart.

    That is doc_id, unless ids are null or repeated; rows are numbered then, in a table of
    their own, so that each row is judged and none is lost with another.
    """
    n, distinct = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if n == distinct:
        return docs, "doc_id"
    name = "row_id"
    while name in docs.columns:
        name = f"_{name}"
    return Staging(spark, "rows").write(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _only(docs: DataFrame, row_id: str, kept: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs whose id is among the kept ones. Both sides grow with the input: a merge join."""
    ids = kept.select(F.col("doc_id").alias("_kept_id")).hint("merge")
    return docs.join(ids, F.col(row_id) == F.col("_kept_id"), "left_semi").select(*[F.col(f"`{c}`") for c in columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    rows, row_id = _identified(spark, docs)
    return _only(rows, row_id, exact_dedup.exact_duplicates(rows, id_col=row_id).where("kept"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near duplicates."""
    rows, row_id = _identified(spark, docs)
    found = jaccard_join.jaccard_components(rows, id_col=row_id, words=NEAR_WORDS, percent=NEAR_PERCENT)
    return _only(rows, row_id, found.where("doc_id = component_id"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; a document is there as often as passes take it."""
    return mixing.mix(docs, queries.domain_levels(), queries.WEIGHTS).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, exact) for each row, as often as it is there; ids may be null."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL expresses neither the models nor the merges; see tests/llm for the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        before = staged(spark)
        docs = stage.write(step(spark, docs, sf_dir), f"stage{k}")
        sweep(spark, [x for x in staged(spark) if x not in before])
        if k:
            stage.drop(f"stage{k - 1}")
    return docs
