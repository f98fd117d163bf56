"""A corpus pipeline: five stages, each on all that the one before it kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorlake.llm.common import table, written
from tremorlake.llm.decontamination import benchmark_hits
from tremorlake.llm.jaccard_join import ngram_jaccard_join
from tremorlake.llm.packing import packed_documents
from tremorlake.llm.substring_dedup import substring_dedup
from tremorlake.llm.toxicity import SAMPLE_BYTES, SAMPLE_ROWS, fit, labelled_sample, score, split_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and key: the id, or for a null id a number from 2**62 on made of the text, so that such rows take part like others."""
    of_text = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    return docs.select(COLUMNS).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), of_text))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3.

    Null and empty texts have the score of the intercept; null ids are scored and never learned from; texts of any length are
    scored whole; repeated rows share one fate; without labels, or with no document, nothing fails: all have the share of label 1 as
    score; columns beside COLUMNS go.
    """
    held = F.coalesce(split_of("id", 4) == 2, F.lit(False))
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", held, "doc_id", "text", SAMPLE_ROWS, SAMPLE_BYTES))
    return score(docs.select(COLUMNS), model, name="toxic_score").where("toxic_score < 0.3").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that n-gram similarity links.

    Exactly one row stays of rows equal in id and text; rows of one id with different texts stay or go together. Rows with null ids take
    part, after all others. Null and empty texts link with nothing; texts of any length are compared whole; an empty table stays
    empty; columns beside COLUMNS go.
    """
    own = _keyed(docs)
    joined = ngram_jaccard_join(own.select("key", "text"), id_col="key")
    kept = written(joined.where("key = component_id").groupBy("key").agg(F.count("*").alias("rows")), "kept")
    once = own.join(kept.where("rows = 1").select("key"), "key", "left_semi")
    more = own.join(kept.where("rows > 1").select("key"), "key", "left_semi").dropDuplicates(["key", "text"])
    return once.unionByName(more).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; a document of nothing else goes.

    Null and empty texts, and those of fewer words than a window, pass as they are; a text that loses nothing keeps its spelling, white
    space included; rows repeated whole lose each other's words, so the stage before leaves one of them; an empty table stays
    empty; columns beside COLUMNS go.
    """
    out = substring_dedup(docs.select(COLUMNS), keep=("text", "lang", "source", "n_chars"), stored=True)
    out = out.where("n_removed = 0 OR kept <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Rows of one id go together; rows with null ids are judged by text. Null and empty texts have no windows and stay; with no benchmark
    item all stay; an empty table stays empty; columns beside COLUMNS go.
    """
    own = _keyed(docs)
    hits = benchmark_hits(own.select("key", "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    hit = written(hits.where("n_hit > 0").select("key").distinct(), "hit")
    return own.join(hit, "key", "left_anti").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 4096 ids.

    A null or empty text is the end id alone; repeated rows and rows with null ids are documents of their own; an empty table
    gives no pieces; columns beside doc_id and text are ignored.
    """
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", packed),
]

#: The scores, and the ids of the tokenizer, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
