"""How the driver tables stand in for candidates, corpus records and logs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate results: tasks are orders, candidates their lines in a fixed order."""
    li = table(spark, folder, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    category = F.when(F.col("l_returnflag") == "R", "verified").when(F.col("l_returnflag") == "A", "lean_rejected").when(F.col("l_linestatus") == "O", "lean_rejected").otherwise("verifier_timeout")
    return li.select(
        F.col("l_orderkey").alias("task_id"), (F.row_number().over(w) - 1).alias("candidate_index"), category.alias("category"),
        F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("generation_latency_seconds"), F.col("l_tax").alias("verification_latency_seconds"), F.col("l_extendedprice").alias("total_latency_seconds"),
        F.col("l_quantity").cast("int").alias("generated_token_count"), F.when(F.col("l_discount") < 0.05, "eos").otherwise("token_limit").alias("finish_reason"),
        (F.col("l_linenumber") == 1).alias("target_exact"), "l_suppkey", "l_partkey",
    )


CANDIDATES = f"""cand as (select l_orderkey as task_id, cast(row_number() over (partition by l_orderkey order by {', '.join(LINE_ORDER)}) - 1 as int) as candidate_index,
  case when l_returnflag = 'R' then 'verified' when l_returnflag = 'A' then 'lean_rejected' when l_linestatus = 'O' then 'lean_rejected' else 'verifier_timeout' end as category,
  case when l_tax > 0.02 then l_quantity end as generation_latency_seconds, l_tax as verification_latency_seconds, l_extendedprice as total_latency_seconds,
  cast(l_quantity as int) as generated_token_count, case when l_discount < 0.05 then 'eos' else 'token_limit' end as finish_reason, l_linenumber = 1 as target_exact, l_suppkey, l_partkey from lineitem)"""


def expected(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderpriority", "o_orderstatus", "o_custkey")


TASKS = "tasks as (select o_orderkey as task_id, count(c.task_id) as candidates, count(*) filter (where c.category = 'verified') as verified from orders left join cand c on o_orderkey = c.task_id group by o_orderkey)"


def passk_sql(n: str, c: str, k: int) -> str:
    factors = " * ".join(f"(({n}) - ({c}) - {i}) / cast(({n}) - {i} as double)" for i in range(k))
    return f"case when ({n}) < {k} then null when ({n}) - ({c}) < {k} then 1.0 else 1.0 - {factors} end"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus records: documents in files of a source, a name and references from their words."""
    d = table(spark, folder, "documents")
    words = F.split("text", " ", -1)
    return d.select(
        F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("id"), F.concat("source", F.lit("/"), (F.col("doc_id") % 20).cast("string")).alias("file_path"), words[0].alias("declaration_name"),
        F.floor(F.col("doc_id") / 20).cast("int").alias("line"), F.lit(1).alias("col"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("premises"), F.sha2("text", 256).alias("statement_fingerprint"),
        "doc_id", "text", "lang", "source", "n_chars",
    )


RECORDS = """rec as (select lpad(cast(doc_id as varchar), 8, '0') as id, source || '/' || cast(doc_id % 20 as varchar) as file_path, string_split(text, ' ')[1] as declaration_name,
  cast(doc_id // 20 as int) as line, 1 as col, string_split(text, ' ')[2:] as premises, sha256(text) as statement_fingerprint, doc_id, text, lang, source, n_chars from documents)"""

#: Labels as corpus facts: a split by hash, a relevance class by labels.
SPLIT_SQL = "case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'validation' else 'heldout' end"


def split_of(doc_id: str = "doc_id"):
    m = F.col(doc_id) % 10
    return F.when(m < 8, "train").when(m == 8, "validation").otherwise("heldout")
