"""Extraction as a table function of SQL:

    SELECT r.recording_id, f.* FROM recordings r, LATERAL extract_fingerprint(r.samples, r.sample_rate, 'wang') f
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegralType, LongType, NumericType, StringType, StructType

from sonorel.configs import Haitsma, Panako, Wang
from sonorel.operators import spectral

FIELDS = {"wang": ["hash", "t_anchor"], "panako": ["hash", "t_anchor", "t_b", "t_c"], "haitsma": ["pos", "frame"]}


def register(spark: SparkSession, configs: dict | None = None, name: str = "extract_fingerprint") -> None:
    """Register the function under ``name``. Its columns follow from the algorithm, a constant: wang, panako or haitsma (with the
    options of ``configs`` if it has them), and ``error``, the code of what is wrong with a recording, which then has one row."""
    options = {"wang": Wang(), "panako": Panako(), "haitsma": Haitsma()} | (configs or {})
    fields = FIELDS

    class Extract:
        @staticmethod
        def analyze(samples: AnalyzeArgument, sample_rate: AnalyzeArgument, algorithm: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(samples.dataType, ArrayType) or not isinstance(samples.dataType.elementType, NumericType):
                raise ValueError("samples must be an array of numbers")
            if not isinstance(sample_rate.dataType, IntegralType):
                raise ValueError("the sample rate must be a whole number")
            if not algorithm.isConstantExpression or algorithm.value not in fields:
                raise ValueError(f"the algorithm must be one of {', '.join(fields)}")
            schema = StructType()
            for f in fields[algorithm.value]:
                schema = schema.add(f, LongType())
            return AnalyzeResult(schema=schema.add("error", StringType()))

        def eval(self, samples, sample_rate, algorithm):
            cfg, make = options[algorithm], {"wang": spectral.wang_hashes_of, "panako": spectral.panako_hashes_of, "haitsma": spectral.haitsma_frames_of}[algorithm]
            x = None if samples is None else np.array([np.nan if v is None else v for v in samples], np.float32)
            wrong = spectral.fault(x, sample_rate, cfg)
            if wrong:
                yield (*[None] * len(fields[algorithm]), wrong[0])
                return
            for row in zip(*[np.asarray(c, np.int64).tolist() for c in make(x, cfg)], strict=True):
                yield (*row, None)

    spark.udtf.register(name, udtf(Extract, useArrow=True))
