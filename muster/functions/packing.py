"""Several columns of a row as one text, for shuffles.

A shuffled row has eight bytes for every column, and where a text begins depends on all texts
before it, so even rows that are much alike compress badly.  Their values as one text take up
about half of that on disk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, StringType, StructField

# Between two values, in place of NULL, and what stands for either sign within a text.
_BETWEEN, _ESCAPE = "\x01", "\\"
_NULL, _ESCAPES = _ESCAPE + "0", ((_ESCAPE, _ESCAPE + "e"), (_BETWEEN, _ESCAPE + "s"))


def packed(df: DataFrame, columns: Sequence[str], name: str) -> tuple[DataFrame, list[StructField]]:
    """``df`` with the texts, whole numbers and truth values among ``columns`` as one text
    ``name``, and what they were.  Others stay as they are."""
    kinds = (StringType, IntegralType, BooleanType)
    fields = [df.schema[c] for c in columns if isinstance(df.schema[c].dataType, kinds)]

    def written(f: StructField) -> Column:
        text = F.col(f.name).cast("string")
        if isinstance(f.dataType, StringType):
            for sign, escaped in _ESCAPES:
                text = F.replace(text, F.lit(sign), F.lit(escaped))
        return F.coalesce(text, F.lit(_NULL))

    text = F.concat_ws(_BETWEEN, *[written(f) for f in fields]).alias(name)
    rest = [c for c in df.columns if c not in {f.name for f in fields}]
    return df.select(*rest, text), fields


def unpacked(df: DataFrame, fields: Sequence[StructField], name: str) -> DataFrame:
    """``df`` with the columns that ``packed`` has made one text ``name``, which goes."""

    def read(f: StructField, i: int) -> Column:
        part = F.get(name, F.lit(i))
        text = part
        if isinstance(f.dataType, StringType):
            for sign, escaped in reversed(_ESCAPES):
                text = F.replace(text, F.lit(escaped), F.lit(sign))
        return F.when(part != _NULL, text.cast(f.dataType)).alias(f.name)

    # Cut once, in a projection below: Spark would cut the text for each column anew.
    cut = df.withColumn(name, F.split(name, _BETWEEN))
    cut = cut.withColumn(name, F.explode(F.array(name)))
    rest = [c for c in df.columns if c != name]
    return cut.select(*rest, *[read(f, i) for i, f in enumerate(fields)])
