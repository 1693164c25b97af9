"""The given tables as a questionnaire about deliveries, and the catalogs that describe it.

Every order line is one answer sheet. What became of the goods, whether the line is paid, its discount and its amount are what the tables
hold; the follow-up questions are asked only of the lines that they concern. Some sheets lack a weight or a place in the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Design, Variable, WaveCatalog, WaveVariable

DESIGN = Design(weight="wt", stratum="stratum", psu="cluster")
#: Questionnaires by the last year in which each was used.
EARLY, MIDDLE, LATE = 1996, 1998, 2001

SENT_BACK = "outcome == 3"
PAID_BACK = "outcome == 3 & paid == 1"
MAY_CLAIM = "outcome >= 2 & outcome <= 3 & paid == 1"

CATALOG = Catalog(
    [
        Variable("outcome", "What became of the goods", None, "All lines.", (1, 2, 3), (3,), "wt",
                 "1 kept, 2 exchanged, 3 sent back.", ("refund", "wait")),
        Variable("paid", "Line is paid in full", None, "All lines.", (0, 1), (1,), "wt", "", ("refund",)),
        Variable("refund", "Money returned", MAY_CLAIM, "Paid lines whose goods were exchanged or sent back.", (0, 1, 2), (1, 2), "wt",
                 "0 none, 1 part, 2 all; shares among goods sent back need outcome == 3 & paid == 1.", ("outcome", "paid")),
        Variable("wait", "Weeks until the case was settled", SENT_BACK, "Lines whose goods were sent back.", range(1, 51), (), "wt",
                 "88 stands for cases that are still open.", ("outcome",)),
        Variable("spend", "Amount of the line in thousands", None, "All lines.", range(0, 106), (), "wt",
                 "Large amounts were sampled more often; 999 is not stated.", ()),
        Variable("cut", "Discount in percent", None, "All lines.", range(0, 11), (8, 9, 10), "wt_units",
                 "Weighted by units; 8 and more is a deep discount.", ()),
    ]
)

WAVES = WaveCatalog(
    [
        WaveVariable("sent_back", EARLY, "result", "w_line", (1, 2, 3), (1,), "categorical"),
        WaveVariable("sent_back", MIDDLE, "result", "w_line", (1, 2, 3), (1,), "categorical"),
        WaveVariable("sent_back", LATE, "outcome", "wt", (1, 2, 3), (3,), "categorical"),
        WaveVariable("paid_up", EARLY, "paid", "w_line", (0, 1), (1,), "categorical"),
        WaveVariable("paid_up", MIDDLE, "paid", "w_line", (0, 1), (1,), "categorical"),
        WaveVariable("paid_up", LATE, "paid", "wt", (0, 1), (1,), "categorical"),
        WaveVariable("discount", EARLY, "cut_pm", "w_units", range(0, 101), (), "continuous"),
        WaveVariable("discount", LATE, "cut", "wt_units", range(0, 11), (), "categorical"),  # not asked in between
    ]
)


def _whole(value: Column) -> Column:
    """``round(value)`` as a whole number, halves away from zero, without the decimal number that ``round`` makes of every value."""
    part = value - value.cast("int")
    return value.cast("int") + F.when(part.between(0.5, 1), 1).when(part.between(-1, -0.5), -1).otherwise(0)


def micro(spark: SparkSession, sf_dir: str, shipped: str = "true") -> DataFrame:
    """One answer sheet per row of ``lineitem``. ``shipped`` is a condition on ``l_shipdate``, which the scan can apply by itself."""
    k = F.col("k")
    base = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(shipped).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        F.year("l_shipdate").alias("yr"),
        F.quarter("l_shipdate").alias("q"),
        F.col("l_suppkey").alias("supplier"),
        _whole(F.col("l_discount") * 100).alias("cut"),
        _whole(F.col("l_tax") * 100).alias("tax"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("paid"),
        F.col("l_extendedprice").alias("price"),
        ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 50 + 1).cast("int").alias("weeks"),
        (F.col("l_partkey") % 15).cast("int").alias("stratum"),
        (F.col("l_orderkey") % 4).cast("int").alias("place"),
    )
    sheets = base.withColumn(
        "outcome", F.when(k % 37 == 0, 9).when(F.col("flag") == "N", 1).when(F.col("flag") == "A", 2).otherwise(3))
    concerned = F.col("outcome").between(2, 3) & (F.col("paid") == 1)
    refund = F.when(k % 43 == 0, 7).when(F.col("tax") <= 2, 0).when(F.col("tax") <= 5, 1).otherwise(2)
    return sheets.select(
        k.alias("resp_id"), "yr", "supplier", "outcome", "paid",
        F.when(concerned, refund).alias("refund"),
        F.when(F.col("outcome") == 3, F.when(k % 53 == 0, 88).otherwise(F.col("weeks"))).alias("wait"),
        F.when(k % 61 == 0, 999).otherwise(F.floor(F.col("price") / 1000).cast("int")).alias("spend"),
        "cut",
        F.when(k % 101 == 0, 9).otherwise(F.col("q")).alias("quarter"),
        "qty",
        F.when(k % 113 != 0, F.col("price") / 100).alias("wt"),
        F.when(k % 109 != 0, F.col("qty").cast("double")).alias("wt_units"),
        "stratum",
        F.when(k % 127 != 0, F.col("place")).alias("cluster"),
    )


def wave_frames(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    """Three questionnaires, every row in one of them. The last one turned the order of one question's answers round and renamed it;
    the discount was first asked in thousandths, then not at all, then in percent."""
    def between(after: int | None, last: int | None) -> str:
        parts = [f"l_shipdate >= DATE'{after + 1}-01-01'"] if after else []
        return " AND ".join(parts + ([f"l_shipdate < DATE'{last + 1}-01-01'"] if last else []))

    early, middle, late = (micro(spark, sf_dir, between(*ends)) for ends in ((None, EARLY), (EARLY, MIDDLE), (MIDDLE, None)))
    result = F.when(F.col("outcome") == 9, 9).otherwise(4 - F.col("outcome")).alias("result")
    line = F.col("wt").alias("w_line")
    return {
        EARLY: early.select(result, "paid", (F.col("cut") * 10).alias("cut_pm"), line, F.col("wt_units").alias("w_units"), "stratum", "cluster"),
        MIDDLE: middle.select(result, "paid", line, "stratum", "cluster"),
        LATE: late.select("outcome", "paid", "cut", "wt", "wt_units", "stratum", "cluster"),
    }
