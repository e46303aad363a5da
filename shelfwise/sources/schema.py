"""Column types of the star schema.

The reference ships no DDL; the types follow from how each column is used
(integer averages truncate, money is exact decimal, dates are days).
"""

from pyspark.sql import types as T

FACT = T.StructType(
    [
        T.StructField("Date_SK", T.IntegerType()),
        T.StructField("Store_SK", T.IntegerType()),
        T.StructField("Product_SK", T.LongType()),
        T.StructField("Inventory_Level", T.IntegerType()),
        T.StructField("Units_Sold", T.IntegerType()),
        T.StructField("Price", T.DecimalType(10, 2)),
        T.StructField("Demand_Forecast", T.DecimalType(10, 2)),
        T.StructField("Discount", T.DecimalType(4, 2)),
        T.StructField("Holiday_Promotion", T.IntegerType()),
    ]
)

STORE = T.StructType(
    [
        T.StructField("Store_SK", T.IntegerType()),
        T.StructField("Store_ID", T.StringType()),
        T.StructField("Region", T.StringType()),
    ]
)

PRODUCT = T.StructType(
    [
        T.StructField("Product_SK", T.LongType()),
        T.StructField("Product_ID", T.StringType()),
        T.StructField("Category", T.StringType()),
    ]
)

DATE = T.StructType(
    [
        T.StructField("Date_SK", T.IntegerType()),
        T.StructField("Date", T.DateType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
    ]
)

TABLES = {"fact": FACT, "store": STORE, "product": PRODUCT, "date": DATE}
