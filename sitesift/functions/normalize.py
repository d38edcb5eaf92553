"""NFKC + lower case.

Most text needs no Python: letters of the ranges below are unchanged by NFKC, so ``lower`` is
enough. Only rows with other code points go through an Arrow function.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code points that NFKC leaves alone and that never join a following one: ASCII, the composed
# Latin letters, plain Cyrillic, dashes and quotes, CJK ideographs.
# Runs of ASCII are an alternative of their own, because a class of one range is tested far faster.
STABLE_TEXT = (
    r"^(?:[\x{00}-\x{7F}]++|[\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}"
    r"\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{400}-\x{45F}\x{2013}\x{2014}\x{2018}-\x{201D}"
    r"\x{4E00}-\x{9FA5}]++)*+\z"
)


@F.arrow_udf(StringType())
def _nfkc_lower(values: pa.Array) -> pa.Array:
    return pa.array(
        [v if v is None else unicodedata.normalize("NFKC", v).lower() for v in values.to_pylist()],
        type=pa.string(),
    )


def fold_text(value: Column) -> Column:
    stable = (F.octet_length(value) == F.length(value)) | F.rlike(value, F.lit(STABLE_TEXT))
    # The Arrow function sees null for stable rows, so their text is not sent to Python, and gives null
    # for them alone: the test is made once, below it.
    return F.coalesce(_nfkc_lower(F.when(~stable, value)), F.lower(value))
