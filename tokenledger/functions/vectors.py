"""Vector expressions (V1). Spark has no built-in cosine, so it is spelled with
higher-order functions; the batch matcher uses numpy inside Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenledger import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine(a, b, a_norm=None, b_norm=None) -> Column:
    """V1: dot / (|a| |b| + 1e-9) in double. Pass precomputed norms when one side
    is reused across many pairs."""
    na = _col(a_norm) if a_norm is not None else norm(a)
    nb = _col(b_norm) if b_norm is not None else norm(b)
    return dot(a, b) / (na * nb + F.lit(K.SIMILARITY_EPS))

