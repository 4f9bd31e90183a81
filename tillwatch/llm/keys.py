"""Keys of documents for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names no table is expected to have.
KEY = ["__doc", "__text"]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key columns: the id (null as the smallest long) and a hash of the text.

    Ids may be null or repeat; rows equal in id and text have the same key, and every
    operator gives them the same result.
    """
    return docs.withColumns({KEY[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), KEY[1]: F.xxhash64("text")})
