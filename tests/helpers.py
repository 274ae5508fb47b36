"""Small tables for the tests."""

import datetime as dt

import numpy as np

from shelfcast.functions.calendar import FEATURE_NAMES
from shelfcast.operators.features import MOMENTUM_EPSILON

LINE_SCHEMA = (
    "`Order ID` string, `Customer ID` string, `Product ID` string, `Order Date` date, "
    "Segment string, Region string, Category string, `Sub-Category` string, `Product Name` string, "
    "Sales double, Quantity int, Profit double, Discount double"
)


def day(text):
    return dt.date.fromisoformat(text)


def line(
    order="o1", customer="c1", product="p1", date="2017-01-02", segment="Consumer", region="West",
    category="Tech", sub="Phones", name="Phone", sales=10.0, quantity=1, profit=1.0, discount=0.0,
):
    return (
        order, customer, product, day(date) if date else None, segment, region, category, sub, name,
        sales, quantity, profit, discount,
    )


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), LINE_SCHEMA)


def daily(spark, values, start="2016-01-01", key=None):
    first = day(start)
    rows = [(first + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    if key is None:
        return spark.createDataFrame(rows, "Date date, Sales double")
    return spark.createDataFrame([(key, *r) for r in rows], "Region string, Date date, Sales double")


def buffer_features(spec, buffer, known, day, ddof=0):
    """Features of the next day for a batch of series, one row per series.

    ``buffer`` holds the last ``spec.memory`` values, newest last; only the newest
    ``known`` of a row count. ``day`` holds the calendar features of that day. A lag that
    reaches past a short history is the mean of that history, a window past it takes
    all of it.
    """
    width = buffer.shape[1]
    age = np.arange(width, 0, -1)

    def window(w):
        inside = age <= np.minimum(known, w)[:, None]
        return inside, inside.sum(axis=1)

    def mean_of(inside, count):
        return np.where(inside, buffer, 0.0).sum(axis=1) / np.maximum(count, 1)

    values = {name: day[:, i] for i, name in enumerate(FEATURE_NAMES)}
    whole_mean = mean_of(*window(width))
    for k in spec.lags:
        values[f"lag_{k}"] = np.where(known >= k, buffer[:, -k], whole_mean)
    for w in spec.windows:
        inside, count = window(w)
        mean = mean_of(inside, count)
        spread = np.where(inside, (buffer - mean[:, None]) ** 2, 0.0).sum(axis=1)
        deviation = np.sqrt(spread / np.maximum(count - ddof, 1))
        values[f"rolling_mean_{w}"] = mean
        values[f"rolling_std_{w}"] = np.where(count > 1, deviation, 0.0)
        values[f"rolling_min_{w}"] = np.where(inside, buffer, np.inf).min(axis=1)
        values[f"rolling_max_{w}"] = np.where(inside, buffer, -np.inf).max(axis=1)
    if spec.has_momentum:
        values["momentum_7_30"] = values["rolling_mean_7"] / (values["rolling_mean_30"] + MOMENTUM_EPSILON)
    if spec.has_lag_difference:
        values["sales_diff_1_7"] = values["lag_1"] - values["lag_7"]
    return np.column_stack([values[name] for name in spec.names])
