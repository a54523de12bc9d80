"""Packed files of few rows: labels of several parts read back as one sequence."""

import __spark_entry__
from comparing import duck, same

from millrace.operators import records

SF = "/root/testdata/sf0.001"


def test_index_goes_on_from_part_to_part(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    for rows_of_a_file in (50, 65_536):
        same(records.read_packed(vectors, rows_of_a_file), duck(SF), __spark_entry__.oracle_sql()["src_packed_read"])


def test_query_beyond_one_part(spark):
    con = duck(SF)
    con.execute("create or replace view embeddings as select vec_id * 1000 as vec_id, embedding, label from '" + SF + "/embeddings.parquet'")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id * 1000 as vec_id", "embedding", "label")
    same(records.src_packed_read(Moved(vectors)), con, __spark_entry__.oracle_sql()["src_packed_read"])


class Moved:
    """The exchange's entities with these embeddings."""

    def __init__(self, embeddings):
        self.embeddings = embeddings
