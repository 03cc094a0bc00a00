"""Reads derived from the events table, and generated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The reads view, in SQL that Spark and DuckDB both run.
READS_SQL = """
SELECT event_id,
       concat('EV:', user_id, ':', event_id,
              CASE WHEN event_id % 3 = 0 THEN ''
                   WHEN event_id % 3 = 1 THEN concat(' ', event_type)
                   ELSE concat(' ', event_type, ' 1:N:0') END) AS name,
       CASE WHEN event_id % 5 = 0
              THEN concat(substr(body, 1, p - 1), substr('NRYSWKMBDHVn', 1 + event_id % 12, 1), substr(body, p + 1))
            WHEN event_id % 7 = 0 THEN lower(body)
            ELSE body END AS sequence,
       qual AS quality
FROM (SELECT event_id, user_id, event_type, substr(b, 1, l) AS body, substr(q, 1, l) AS qual,
             CAST(1 + event_id % l AS INT) AS p
      FROM (SELECT event_id, user_id, event_type, CAST(event_id % 80 AS INT) + 17 AS l,
                   translate(concat(md5(concat('a', event_id)), md5(concat('b', event_id)), md5(concat('c', event_id))),
                             '0123456789abcdef', 'ACGTACGTACGTACGT') AS b,
                   translate(concat(md5(concat('q', event_id)), md5(concat('r', event_id)), md5(concat('s', event_id))),
                             '0123456789abcdef', '!#*+4579<?BCDGIJ') AS q
            FROM {events}) x) y
"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, name, sequence, quality) with string fields."""
    return spark.sql(READS_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def generated(spark: SparkSession, n: int, length: int = 150) -> DataFrame:
    """(i, name, sequence, quality) of n synthetic reads: bases by position, an N at regular places, and scores from 5 to 39."""
    i, j = F.col("i"), F.sequence(F.lit(0), F.lit(length - 1))
    base = lambda p: F.when((31 * i + 17 * p) % 100 == 0, "N").otherwise(F.substr(F.lit("ACGT"), ((7 * i + 13 * p) % 4 + 1).cast("int"), F.lit(1)))
    score = lambda p: F.char((3 * i + 11 * p) % 35 + 38)
    name = F.concat(F.lit("INSTRUMENT:RUN:FLOWCELL:1:1101:"), (1000 + F.floor(i / 100)).cast("string"), F.lit(":"), (2000 + i % 100).cast("string"), F.lit(" 1:N:0:ATCACG"))
    return spark.range(n).select(F.col("id").alias("i")).select("i", name.alias("name"), F.array_join(F.transform(j, base), "").alias("sequence"), F.array_join(F.transform(j, score), "").alias("quality"))
