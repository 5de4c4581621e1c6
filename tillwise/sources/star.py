"""Transaction lines derived from the star-schema tables (lineitem, orders, part, customer, nation)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.sources.lines import LINE_COLUMNS, PRICE_TYPE

_FROM_ORDERS = {"InvoiceDate", "CustomerID", "Country"}
_FROM_PART = {"UnitPrice", "Description"}


STAR_TABLES = ("lineitem", "orders", "part", "customer", "nation")


def star_paths(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{name}.parquet" for name in STAR_TABLES]


def star_lines(spark: SparkSession, sf_dir: str, columns: Iterable[str] = LINE_COLUMNS) -> DataFrame:
    """The line table, or just some of its columns, over the Parquet tables of a folder."""
    return lines_of_star(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), columns)


def lines_of_star(table: Callable[[str], DataFrame], columns: Iterable[str] = LINE_COLUMNS) -> DataFrame:
    """The line table, or just some of its columns, over every row of ``lineitem``; ``table`` gives a table by its name.

    Contract: every line's order and part, and that order's customer and nation, exist (``orphans`` counts
    those that do not). Then a join that would only add unwanted columns changes nothing and is not written:
    Spark drops unused columns by itself but not an unused inner join. No join carries a
    broadcast hint; whether a side is small enough is Spark's decision from the measured file
    sizes, and beyond that adaptive execution splits hot order or part keys of a sort-merge join.

    Lines are the largest table, so they are shuffled by order and by part only, with keys and flags: an order's country is
    found before the order meets its lines, and a line's texts are made from its keys after the joins.
    """
    wanted = [c for c in LINE_COLUMNS if c in set(columns)]
    is_return = F.col("l_returnflag") == "R"
    order_text = F.col("l_orderkey").cast("string")
    part_text = F.col("l_partkey").cast("string")
    # lpad cuts what is longer than its length.
    padded = F.lpad(part_text, F.greatest(F.length(part_text), F.lit(6)), F.lit("0"))

    frame = table("lineitem").select(
        (is_return & (F.col("l_linestatus") == "O")).alias("is_cancelled"),
        F.when(is_return, -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int").alias("Quantity"),
        ((F.col("l_discount") == 0) & (F.col("l_tax") == 0)).alias("is_free"),
        ((F.col("l_orderkey") % 11 == 0) | ((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 1))).alias(
            "is_anonymous"
        ),
        "l_orderkey",
        "l_partkey",
    )
    if _FROM_ORDERS & set(wanted):
        orders = table("orders")
        if "Country" in wanted:
            home = table("customer")
            nation = table("nation")
            home = home.join(nation, home.c_nationkey == nation.n_nationkey)
            orders = orders.join(home, orders.o_custkey == home.c_custkey)
        frame = frame.join(orders, frame.l_orderkey == orders.o_orderkey)
    if _FROM_PART & set(wanted):
        part = table("part")
        frame = frame.join(part, frame.l_partkey == part.p_partkey)

    derived = {
        "InvoiceNo": lambda: F.when(F.col("is_cancelled"), F.concat(F.lit("C"), order_text)).otherwise(order_text),
        "StockCode": lambda: F.when(F.col("l_partkey") % 50 == 0, F.lit("POST")).otherwise(F.concat(F.lit("SKU"), padded)),
        "Description": lambda: F.col("p_name"),
        "InvoiceDate": lambda: F.col("o_orderdate").cast("timestamp_ntz"),
        "UnitPrice": lambda: F.when(F.col("is_free"), F.lit(0)).otherwise(F.col("p_retailprice")).cast(PRICE_TYPE),
        "CustomerID": lambda: F.when(~F.col("is_anonymous"), F.col("o_custkey")),
        "Country": lambda: F.col("n_name"),
    }
    return frame.select(*[derived[c]().alias(c) if c in derived else F.col(c) for c in wanted])


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many rows break the contract of ``star_lines``, by foreign key."""

    def missing(child: str, key: str, parent: str, parent_key: str) -> Column:
        rows = spark.read.parquet(f"{sf_dir}/{child}.parquet").select(F.col(key).alias("k"))
        keys = spark.read.parquet(f"{sf_dir}/{parent}.parquet").select(F.col(parent_key).alias("k"))
        return rows.join(keys, "k", "left_anti").agg(F.count(F.lit(1))).scalar().alias(key)

    return spark.range(1).select(
        missing("lineitem", "l_orderkey", "orders", "o_orderkey"),
        missing("lineitem", "l_partkey", "part", "p_partkey"),
        missing("orders", "o_custkey", "customer", "c_custkey"),
        missing("customer", "c_nationkey", "nation", "n_nationkey"),
    )
