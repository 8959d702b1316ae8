"""What running a DataFrame took, as its final plan counted it."""

from pyspark.sql import DataFrame


def shuffled_bytes(df: DataFrame) -> int:
    """Runs ``df`` and returns the bytes that its exchanges wrote."""
    df.collect()

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(node.children().apply(k)) for k in range(node.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())
