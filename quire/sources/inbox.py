"""The inbox: documents as rows, from files of any store Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.names import file_name, format_of, is_supported
from quire.options import Options


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file below ``folder``: path, size, time, bytes, name and format.

    The bytes are only read if a later step selects ``content``. Every file is listed,
    whatever its type, so that unsupported ones can be reported. As usual in Spark,
    files whose name starts with ``.`` or ``_`` are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return with_format(files)


def with_format(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "source_filename": file_name(F.col("path")),
        "format": format_of(F.col("path")),
    })


def supported(docs: DataFrame, options: Options = Options()) -> DataFrame:
    return docs.where(is_supported(F.col("format"), options.supported))
