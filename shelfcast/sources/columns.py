"""Column names and types of the tables that are read or written."""

from __future__ import annotations

from pyspark.sql import types as T

# The text columns of a sales file that the queries use.
SALES_COLUMNS = [
    "Order ID", "Order Date", "Ship Date", "Ship Mode",
    "Customer ID", "Segment", "City", "State", "Region",
    "Product ID", "Category", "Sub-Category", "Product Name",
    "Sales", "Quantity", "Discount", "Profit",
]

MEASURES = ["Sales", "Quantity", "Profit"]

FORECAST_SCHEMA = T.StructType(
    [T.StructField("Date", T.DateType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in ["Forecast_Sales", "Lower_80", "Upper_80", "Lower_95", "Upper_95"]
    ]
)

METRICS_SCHEMA = T.StructType(
    [T.StructField("Model", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in ["MAE", "RMSE", "R2", "WAPE_%", "MAPE_%"]]
)
