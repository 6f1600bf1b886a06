"""Lowering of a plan to DataFrames.

Three rewrites happen on the way: equal sources are one relation, natural self-joins are
the row itself, and all serialisers over one relation are fused into a single generator,
so that a source is scanned once however many branches read it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnsupportedPlanError
from ..operators import relation as ops
from ..operators import serialize as out
from ..operators.relation import Relation
from ..options import Options
from ..sources.readers import read
from .model import Extend, Fragment, Join, Plan, Project, Rename, Serialize, Source, Target


class Lowering:
    """Lowers the nodes of one plan, each once."""

    def __init__(self, plan: Plan, spark: SparkSession, options: Options, stream: bool = False):
        self.plan, self.spark, self.options, self.stream = plan, spark, options, stream
        self._relations: dict[int, Relation] = {}
        self._sources: dict[Source, Relation] = {}

    def relation(self, node: int) -> Relation:
        for i in self.plan.order():
            if i not in self._relations and not isinstance(self.plan.nodes[i], (Serialize, Target)):
                self._relations[i] = self._lower(i)
        return self._relations[node]

    def _lower(self, i: int) -> Relation:
        node, inputs = self.plan.nodes[i], [self._relations[j] for j in self.plan.inputs[i]]
        if isinstance(node, Source):
            if node not in self._sources:
                self._sources[node] = ops.from_read(*read(self.spark, node, self.options, self.stream), tag=f"s{i}")
            return self._sources[node]
        if isinstance(node, Join):
            return ops.join(*inputs, node, tag=f"j{i}")
        if isinstance(node, Project):
            return ops.project(inputs[0], node)
        if isinstance(node, Rename):
            return ops.rename(inputs[0], node)
        if isinstance(node, Extend):
            return ops.extend(inputs[0], node, self.options.on_invalid_iri)
        assert isinstance(node, Fragment)
        return inputs[0]

    def _branches(self, serializers: list[int], make) -> list[tuple[DataFrame, list]]:
        """(frame, columns) of the serialisers; those over one frame are put together."""
        groups: dict[object, tuple[DataFrame, list]] = {}
        for i in serializers:
            r = self.relation(self.plan.inputs[i][0])
            key = id(r.df) if self.options.fuse_siblings else i
            groups.setdefault(key, (r.df, []))[1].extend(make(r, self.plan.nodes[i], self.options))
        return list(groups.values())

    def _union(self, frames: list[DataFrame], empty: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], empty)

    def lines(self, serializers: list[int]) -> DataFrame:
        """DataFrame[line] of all statements of the serialisers, deduplicated if asked for."""
        o = self.options
        if o.deduplicate and o.dedup_scope == "record":
            made = []
            for i in serializers:
                r = self.relation(self.plan.inputs[i][0])
                if columns := out.statements(r, self.plan.nodes[i], o):
                    made.append(out.records(r.df, columns))
            return self._union(made, "record array<string>").dropDuplicates().select(F.explode("record").alias("line"))
        frames = [f for df, columns in self._branches(serializers, out.statements) for f in out.explode(df, columns, "line")]
        lines = self._union(frames, "line string")
        return lines.dropDuplicates(["line"]) if o.deduplicate else lines

    def quads(self, serializers: list[int]) -> DataFrame:
        """DataFrame[subject, predicate, object, graph] of the same statements."""
        frames = [f for df, columns in self._branches(serializers, out.quads) for f in out.explode(df, columns, "q")]
        quads = self._union(frames, "q struct<subject:string,predicate:string,object:string,graph:string>").select("q.*")
        return quads.dropDuplicates() if self.options.deduplicate else quads

    def sinks(self) -> dict[tuple[str, str | None], list[int]]:
        """Serialisers by the place they write to; forced places take all, and equal targets are one."""
        o, found = self.options, {}
        for i in self.plan.targets():
            node = self.plan.nodes[i]
            if o.force_to_std_out:
                key = ("StdOut", None)
            elif o.force_to_file is not None:
                key = ("File", o.force_to_file)
            elif node.kind == "StdOut" or node.kind == "File" and node.path:
                key = (node.kind, node.path if node.kind == "File" else None)
            else:
                raise UnsupportedPlanError(f"target type {node.kind!r}" + " without a path" * (node.kind == "File"))
            found.setdefault(key, []).extend(self.plan.inputs[i])
        return found
