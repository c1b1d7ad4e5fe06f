"""Feature stages for Spark ML pipelines (V4)."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from arbora.functions import text as tf

#: A word of a bag of words: two or more word characters.
WORD = r"[\p{L}\p{N}_]{2,}"


class TextTokens(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """V4: a text column cleaned by named steps and cut into tokens, as one persistent pipeline stage.

    ``steps`` are names of :data:`arbora.functions.text.STEPS`, applied in order; tokens are
    the matches of ``pattern``, or with ``grams`` > 0 all pieces of that many characters. A
    null text has no tokens. Column expressions only: nothing leaves the JVM.
    """

    steps = Param(Params._dummy(), "steps", "names of cleaning steps, in order", TypeConverters.toListString)
    pattern = Param(Params._dummy(), "pattern", "regular expression of a token", TypeConverters.toString)
    grams = Param(Params._dummy(), "grams", "length of character pieces; 0: tokens by pattern", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, steps: list[str] | None = None,
                 pattern: str | None = None, grams: int | None = None):
        super().__init__()
        self._setDefault(steps=["lower"], pattern=WORD, grams=0)
        self._set(**self._input_kwargs)
        unknown = set(self.getOrDefault(self.steps)) - set(tf.STEPS)
        if unknown:
            raise ValueError(f"unknown steps {sorted(unknown)}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        t = F.coalesce(F.col(self.getInputCol()), F.lit(""))
        for step in self.getOrDefault(self.steps):
            t = tf.STEPS[step](t)
        n = self.getOrDefault(self.grams)
        # pieces overlap: each is what lies ahead of a place that isn't inside a character
        pattern, group = (rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))", 1) if n else (self.getOrDefault(self.pattern), 0)
        tokens = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        return dataset.withColumn(self.getOutputCol(), tokens)
