"""Replace the first IPv4 address in a string by a host name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the address pattern.
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def address_to_name(df: DataFrame, col: str, hosts: DataFrame, ip_col: str = "ip",
                    name_col: str = "hostname", out: str | None = None) -> DataFrame:
    """Left join the first address found in ``col`` to a host dimension and substitute it.

    Text stays unchanged when no address is present or the address is unknown.
    Rows without an address are not joined: their null keys would meet in one task.
    The dimension is joined (AQE picks broadcast only when it is small at run time).
    """
    out = out or col
    found = F.regexp_extract(F.col(col), IPV4, 0)
    tmp = df.withColumn("_ip", F.when(found != "", found))
    dim = hosts.select(F.col(ip_col).alias("_ip"), F.col(name_col).alias("_name"))
    j = (tmp.where("_ip is not null").join(dim, "_ip", "left")
         .unionByName(tmp.where("_ip is null").withColumn("_name", F.lit(None).cast(dim.schema["_name"].dataType))))
    return (j.withColumn(out, F.when(F.col("_name").isNotNull(),
                                     F.replace(F.col(col), F.col("_ip"), F.col("_name")))
                         .otherwise(F.col(col)))
            .drop("_ip", "_name"))
