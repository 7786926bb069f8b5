"""Raster values in long form: dataset, row, column, value (null: no data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import col

#: Ranges of integer data types.
RANGE = {"uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 4294967295), "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647)}


def to_external(value, low: float, high: float, out_low: float, out_high: float, exponent: float = 1.0) -> Column:
    """Stored to external value: out_low + (out_high - out_low) ((v - low) / (high - low))^exponent."""
    return F.pow((col(value) - low) / (high - low), F.lit(float(exponent))) * (out_high - out_low) + out_low


def to_internal(value, low: float, high: float, out_low: float, out_high: float, exponent: float = 1.0, dtype: str | None = None) -> Column:
    """The inverse, clamped to the data type and rounded if it is an integer type."""
    x = F.pow(F.greatest(F.lit(0.0), (col(value) - out_low) / (out_high - out_low)), F.lit(1.0 / exponent)) * (high - low) + low
    if dtype in RANGE:
        x = F.round(F.greatest(F.lit(float(RANGE[dtype][0])), F.least(F.lit(float(RANGE[dtype][1])), x)))
    return x


def castable(source: str, target: str) -> bool:
    """Whether every value of a type fits another."""
    if target.startswith(("float", "complex")):
        return True
    return source in RANGE and target in RANGE and RANGE[target][0] <= RANGE[source][0] and RANGE[source][1] <= RANGE[target][1]


def mosaic(pixels: DataFrame, order: list[str]) -> DataFrame:
    """For each pixel, the last valid value in the datasets' order."""
    return pixels.where("value is not null").groupBy("row", "col").agg(F.max_by("value", F.struct(*order)).alias("value"))


#: Aggregations over the source pixels of an output pixel.
RESAMPLE = {"average": F.avg, "max": F.max, "min": F.min, "mode": F.mode, "med": F.median, "q1": lambda c: F.percentile(c, F.lit(0.25)), "q3": lambda c: F.percentile(c, F.lit(0.75)), "near": lambda c: F.min_by(c, F.struct("row", "col"))}


def resampled(pixels: DataFrame, factor: int, method: str = "average") -> DataFrame:
    """Pixels of `factor` by `factor` source pixels; without a valid one, no row."""
    if method not in RESAMPLE:
        raise ValueError(f"no such resampling: {method}")
    at = lambda c: F.floor(F.col(c) / factor).cast("long")
    return pixels.where("value is not null").groupBy(at("row").alias("out_row"), at("col").alias("out_col")).agg(RESAMPLE[method]("value").alias("value"))


def enough_valid(pixels: DataFrame, share: float) -> DataFrame:
    """Datasets of whose pixels at least this share is valid."""
    return pixels.groupBy("dataset").agg(F.count("*").alias("n"), F.count("value").alias("valid")).where(F.col("valid") >= F.col("n") * share)


def datasets_by_record(datasets: DataFrame) -> DataFrame:
    """Each record's datasets in time and id order."""
    return datasets.groupBy("record").agg(F.sort_array(F.collect_list(F.struct("datetime", "dataset"))).alias("datasets"))


def palette(value, stops: list[tuple[float, int, int, int]]) -> Column:
    """Colour struct r, g, b by linear interpolation between stops, clamped to the ends."""
    v = col(value)
    mix = lambda i, lo, hi: lo[i] + (hi[i] - lo[i]) * (v - lo[0]) / (hi[0] - lo[0])

    def channel(i: int) -> Column:
        out = F.when(v <= stops[0][0], float(stops[0][i]))
        for lo, hi in zip(stops, stops[1:], strict=False):
            out = out.when(v <= hi[0], mix(i, lo, hi))
        return F.round(out.otherwise(float(stops[-1][i]))).cast("int")

    return F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))
