"""Functions over Arrow arrays."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T


@F.arrow_udf(T.StringType())
def brand_code(brand: pa.Array, name: pa.Array) -> pa.Array:
    """The brand's first letter in upper case and the length of the name."""
    first = pc.utf8_upper(pc.utf8_slice_codeunits(brand, 0, 1))
    return pc.binary_join_element_wise(first, pc.utf8_length(name).cast(pa.string()), "")
