"""A corpus pipeline over documents: quality rules, line dedup, near-dedup, source mixing and encoding.

Each stage takes what its predecessor kept and returns the columns of documents, but for the last. Their results:

* quality rules: rows that no rule rejects, unchanged; null, empty and blank texts go;
* line dedup: all rows, without the lines that repeat; n_chars is the new length; a text whose lines all repeat earlier
  ones becomes empty, and its row stays;
* near-dedup: of rows whose texts are near copies the one with the least doc_id (null last); empty texts, null ones too,
  are copies of each other, so one row of them stays; the others' lines stand in earlier documents;
* source mixing: every row at least once, those of sources below their weight several times; a null source is the empty
  name; none is dropped;
* encoding: doc_id, n_tokens, token_ids and round_trip of every row; null texts have null ids.

Repeated rows and ties are treated as the operators say; an empty table gives an empty result after every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fossick.llm import lines, mixing, pieces, quality, simhash
from fossick.llm.common import remove_table, write_table
from fossick.llm.queries import SENTENCE_PIECES, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_schedule(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, SENTENCE_PIECES)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("source mixing", source_mixing), ("SentencePiece encoding", encoding)]

#: Line dedup, near-dedup and encoding can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir))
        if last:
            remove_table(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
