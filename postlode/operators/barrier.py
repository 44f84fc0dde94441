"""What keeps the optimizer from copying costly columns, and Python workers from taking many texts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seal(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the columns ``names`` behind a condition that is always true but not known to be.

    The optimizer pushes a filter through a projection by copying the column's whole expression
    into the filter, once per mention. For scores built from hundreds of term searches that
    copies the searches until the plan itself fills the memory. An expression that it takes for
    nondeterministic is neither copied nor merged into another, so sealed columns are computed once,
    and those that nothing reads are pruned one by one. Filters stop at the projection, so rows are best chosen before.
    """
    always = F.monotonically_increasing_id() >= 0
    return df.withColumns({n: F.when(always, F.col(n)) for n in names})


def bounded_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df``, whose session passes at most ``rows`` rows at once to Python workers from now on.

    With the default of 10,000 rows a worker's memory grows with the rows of a partition until it holds that many texts.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return df
