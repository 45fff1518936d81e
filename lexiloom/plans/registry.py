"""Named queries over the shared tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Tables whose rows are expensive, with the column they are dealt by.
DEAL_BY = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; one of long texts that has fewer scan splits than cores is dealt over the cores.

    Such a table is smaller than one split per core, so the exchange is
    bounded; a table of many splits is read as it lies.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in DEAL_BY and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, DEAL_BY[name])
    return df


# ---- SQL building blocks

def sql_tokens(col: str) -> str:
    return rf"list_filter(regexp_split_to_array({col}, '\s+'), lambda x: x <> '')"


def sql_marks(col: str) -> str:
    return sql_tokens(rf'''regexp_replace({col}, '([।॥,.!?“”‘’"()\\\[\]:;])', ' \1 ', 'g')''')


def sql_trim(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def sql_pieces(col: str, ends: str = ".") -> str:
    return rf"list_filter(list_transform(regexp_extract_all({col}, '[^{ends}]*[{ends}]|[^{ends}]+'), lambda s: {sql_trim('s')}), lambda s: s <> '')"


def sql_sentences(keep: str, source: str = "documents", col: str = "text", ends: str = ".", min_tokens: int = 3) -> str:
    """SELECT keep, sent_no, text of sentences."""
    return f"""
SELECT {keep}, sent_no, text FROM (
  SELECT {keep}, unnest(p) AS text, unnest(range(len(p))) AS sent_no
  FROM (SELECT {keep}, {sql_pieces(col, ends)} AS p FROM {source}))
WHERE len({sql_tokens('text')}) >= {min_tokens}"""


def sql_uniform(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT / 4294967296.0)"


# user turn and the assistant turn right after it
SQL_PAIRS = """
SELECT u.conv_id, u.turn, u.text AS a_text, a.text AS b_text
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, a_text, b_text): a user turn and the assistant turn right after it."""
    from pyspark.sql import functions as F

    turns = table(spark, folder, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a_text"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b_text"))
    return users.join(replies, ["conv_id", "turn"])
