"""A corpus through the operators of ``gleaner.llm``, stage by stage.

Every stage takes all that the one before kept and returns the columns of
``documents``, whatever others its input has; the last returns where each document's
ids lie in the token file. Null, empty and very long texts, null sources, repeated
rows and empty tables go through every stage: a null text is an empty one, rows that
repeat an id are judged by that id and stay or go together, and a row without an id
stays until it is written, for no stage can name it. What each stage makes of them is
said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.decontamination import benchmark_matches
from gleaner.llm.mixing import repeat_by_mix
from gleaner.llm.near_duplicates import near_duplicates
from gleaner.llm.quality import held_out, score_quality, train_quality
from gleaner.llm.queries import tokenizer_path
from gleaner.llm.storage import Workspace, join_checked
from gleaner.llm.token_blocks import read_token_file, write_token_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids to drop are broadcast up to this number (under 8 MB) and shuffled beyond.
MOST_BROADCAST_IDS = 200_000


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The documents whose id is not in ``ids``."""
    ids = Workspace(docs.sparkSession, name).keep(ids.select("doc_id").distinct(), "dropped")
    return join_checked(docs, ids, "doc_id", "left_anti", MOST_BROADCAST_IDS).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more).

    Null and empty texts have a score like others, by what the labels say of such
    features. Labels of unknown documents teach nothing; without labels of both
    kinds the model scores all alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    return without(docs, score_quality(docs, model).where("predicted = 0"), "quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate group
    (similarity of 0.8 or more).

    Texts without words are in no group, so they stay; rows that repeat an id are no
    duplicates of one another and stay. Texts of fewer than five words are one
    shingle, their whole sequence.
    """
    return without(docs, near_duplicates(docs, percent=80).where("not kept"), "near")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (80 % of its shingles).

    Texts and items without words hold and are held by nothing; repeated items count
    once; without items all documents stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, benchmark_matches(docs, items), "contaminated")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is one of its own; texts without words weigh nothing and follow
    their source's whole passes. Rows that repeat an id share their place in the
    source's order, so they are taken alike.
    """
    return repeat_by_mix(docs).select(*COLUMNS)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token file; doc_id, start, n_tokens and ids_crc32 read from it.

    A null or empty text has its end id alone; rows without an id come first, those
    that repeat one follow one another; without documents the file has no chunks.
    """
    folder = Workspace(spark, "tokens").path("ids")
    write_token_file(docs, folder, tokenizer_path())
    return read_token_file(spark, folder)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_blocks", token_blocks),
]

#: Learning, MinHash and the tokenizer have no SQL form; the tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
