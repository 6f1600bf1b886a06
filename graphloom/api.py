"""The library's entry points."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .errors import UnsupportedPlanError
from .operators.sinks import to_file, to_stdout
from .options import Options
from .plans.lower import Lowering
from .plans.model import Plan, Serialize
from .rml.translate import rml_to_plan
from .shexml.translate import shexml_to_plan


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def as_plan(plan: Plan | str | Mapping) -> Plan:
    """A plan as it is (validated), or read from a JSON document."""
    if isinstance(plan, Plan):
        plan.validate()
        return plan
    return Plan.from_json(plan)


def _serializers(plan: Plan) -> list[int]:
    return [i for i, n in enumerate(plan.nodes) if isinstance(n, Serialize)]


def statements(plan: Plan | str | Mapping, options: Options | None = None, spark: SparkSession | None = None) -> DataFrame:
    """DataFrame[line]: the N-Triples or N-Quads lines of all serialisers of the plan."""
    plan = as_plan(plan)
    return Lowering(plan, spark or session(), options or Options()).lines(_serializers(plan))


def quads(plan: Plan | str | Mapping, options: Options | None = None, spark: SparkSession | None = None) -> DataFrame:
    """DataFrame[subject, predicate, object, graph] of the same statements, terms in N-Quads syntax."""
    plan = as_plan(plan)
    return Lowering(plan, spark or session(), options or Options()).quads(_serializers(plan))


def relation(plan: Plan, node: int, options: Options | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The rows of one relational node, under their logical names."""
    plan = as_plan(plan)
    r = Lowering(plan, spark or session(), options or Options()).relation(node)
    return r.df.select(*[t.column.alias(k) for k, t in r.scope.items()])


def run(plan: Plan | str | Mapping, options: Options | None = None, spark: SparkSession | None = None) -> None:
    """Writes every target's statements. All inputs and targets are checked before anything is written."""
    plan = as_plan(plan)
    lowering = Lowering(plan, spark or session(), options or Options())
    made = [(key, lowering.lines(serializers)) for key, serializers in lowering.sinks().items()]
    for (kind, path), lines in made:
        to_stdout(lines) if kind == "StdOut" else to_file(lines, path)


def translate(text: str, language: str = "rml") -> Plan:
    """A mapping document as a plan."""
    made = {"rml": rml_to_plan, "shexml": shexml_to_plan}.get(language.lower())
    if made is None:
        raise UnsupportedPlanError(f"mapping language {language!r}")
    return made(text)
