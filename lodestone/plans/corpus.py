"""Inputs of the catalogue's queries, made from the tables at hand. The SQL here is plain enough for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Short reaction texts: a row of lineitem each, ASCII only.
REACTIONS = """
select cast(ok as varchar(20)) || '-' || cast(ln as varchar(20)) || '-' || cast(pk as varchar(20)) || '-' || cast(sk as varchar(20)) || '-' || cast(q as varchar(20)) || '-' || cast(price as varchar(20)) as doc_id, ok as paper,
  'The iron catalyst with ' || case pk % 4 when 0 then 'Xyl-BINAP' when 1 then 'josiphos' when 2 then 'DPPE' else 'a new ligand' end
  || ' was tested on ' || case sk % 3 when 0 then 'aryl ketone' when 1 then 'imine' else 'a substrate' end || '. Runs under molecular hydrogen at '
  || cast(1 + pk % 97 as varchar(20)) || case when pk % 2 = 0 then '.5' else '' end || ' ' || case ln % 5 when 0 then 'bar' when 1 then 'atm' when 2 then 'psi' when 3 then 'MPa' else 'kPa' end
  || ' and ' || cast(20 + q % 60 as varchar(20)) || ' C for ' || cast(1 + sk % 48 as varchar(20)) || ' h in ' || case q % 4 when 0 then 'toluene' when 1 then 'THF' when 2 then 'ethyl acetate' else 'water' end
  || ' gave ' || cast(50 + q as varchar(20)) || case when q % 3 = 0 then '.' || cast(q % 10 as varchar(20)) else '' end || '% ee'
  || case when pk % 3 = 0 then '' else ' and ' || cast(30 + pk % 60 as varchar(20)) || '% yield' end || '. TON = ' || cast(100 + sk as varchar(20)) || '.'
  || case when ln % 2 = 0 then chr(10) || 'A second run gave ' || cast(40 + sk % 50 as varchar(20)) || '% yield! Then it stopped.' else '' end as text
from (select cast(l_orderkey as bigint) as ok, cast(l_linenumber as int) as ln, cast(l_partkey as bigint) as pk, cast(l_suppkey as bigint) as sk, cast(l_quantity as int) as q, cast(floor(l_extendedprice) as bigint) as price from lineitem) x
"""


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over all cores where its files fall into fewer parts than there are cores; a large table stays as its files lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dear to work off."""
    return spread(table(spark, sf_dir, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REACTIONS.replace("from lineitem", "from {lineitem}"), lineitem=texts(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
