"""Continuous mapping: the same plans over streaming sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..api import _serializers, as_plan, session
from ..errors import UnsupportedPlanError
from ..options import Options
from ..plans.lower import Lowering
from ..plans.model import Join, Plan


def stream_statements(plan: Plan | str | Mapping, options: Options | None = None, spark: SparkSession | None = None) -> DataFrame:
    """A streaming DataFrame[line]: file sources are directories to which files are added.

    Plans without real joins only, which need no state; deduplication would keep every
    statement for ever and is refused.
    """
    plan, options = as_plan(plan), options or Options()
    if options.deduplicate:
        raise UnsupportedPlanError("deduplication of a stream without end")
    if any(isinstance(n, Join) and n.pairs for n in plan.nodes):
        raise UnsupportedPlanError("a join of streams without a watermark")
    return Lowering(plan, spark or session(), options, stream=True).lines(_serializers(plan))


def start(lines: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the statements to a directory of text files, exactly once per input file."""
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
