"""The plan graph: operators with ordered inputs, read from JSON and validated."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from ..errors import PlanError, UnsupportedPlanError


@dataclass(frozen=True)
class Source:
    path: str
    source_type: str = "File"
    formulation: str = "CSVRows"
    options: tuple[tuple[str, str], ...] = ()
    iterator: str = ""


@dataclass(frozen=True)
class Project:
    attributes: tuple[str, ...]


@dataclass(frozen=True)
class Fragment:
    """Fan-out: every consumer gets every row; the labels don't matter."""


@dataclass(frozen=True)
class Rename:
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Join:
    pairs: tuple[tuple[str, str], ...]
    alias: str
    kind: str = "InnerJoin"
    predicate: str = "Equal"


@dataclass(frozen=True)
class Extend:
    functions: Mapping[str, Mapping] = field(hash=False)


@dataclass(frozen=True)
class Serialize:
    template: str
    format: str = "NQuads"


@dataclass(frozen=True)
class Target:
    kind: str = "StdOut"
    path: str | None = None


Operator = Source | Project | Fragment | Rename | Join | Extend | Serialize | Target
_INPUTS = {Source: (0, 0), Project: (1, 1), Fragment: (1, 1), Rename: (1, 1), Join: (2, 2), Extend: (1, 1), Serialize: (1, 1), Target: (1, None)}
_FORMATS = ("NQuads", "NTriples")


def _source(c: Mapping) -> Source:
    iterator = c.get("root_iterator") or {}
    options = c.get("options") or {}
    return Source(c["path"], c.get("source_type", "File"), iterator.get("reference_formulation", "CSVRows"), tuple(sorted((k, str(v)) for k, v in options.items())), iterator.get("reference") or "")


def _target(c: Mapping) -> Target:
    return Target(c.get("target_type", "StdOut"), c.get("path") or (c.get("configuration") or {}).get("path"))


_READERS = {
    "SourceOp": _source,
    "ProjectOp": lambda c: Project(tuple(c["projection_attributes"])),
    "FragmentOp": lambda c: Fragment(),
    "RenameOp": lambda c: Rename(tuple((a, b) for a, b in (c.get("rename_pairs") or {}).items())),
    "JoinOp": lambda c: Join(tuple((a, b) for a, b in c["left_right_attr_pairs"]), c["join_alias"], c.get("join_type", "InnerJoin"), c.get("predicate_type", "Equal")),
    "ExtendOp": lambda c: Extend({k.removeprefix("?"): v for k, v in c.items()}),
    "SerializerOp": lambda c: Serialize(c["template"], c.get("format", "NQuads")),
    "TargetOp": _target,
}


class Plan:
    """A DAG of operators. ``add`` returns a node's number; inputs are in order, left before right."""

    def __init__(self) -> None:
        self.nodes: list[Operator] = []
        self.inputs: list[list[int]] = []

    def add(self, operator: Operator, *inputs: int) -> int:
        self.nodes.append(operator)
        self.inputs.append(list(inputs))
        return len(self.nodes) - 1

    @classmethod
    def from_json(cls, document: str | Mapping) -> Plan:
        """Reads and validates a plan document; nodes are numbered by position, edge order is input order."""
        if isinstance(document, str):
            try:
                document = json.loads(document)
            except ValueError as e:
                raise PlanError(f"the plan is no JSON: {e}") from None
        plan = cls()
        for i, node in enumerate(document.get("nodes", ())):
            operator = node.get("operator") or {}
            reader = _READERS.get(operator.get("type"))
            if reader is None:
                raise UnsupportedPlanError(f"operator {operator.get('type')!r} of node {i}")
            try:
                plan.add(reader(operator.get("config") or {}))
            except KeyError as e:
                raise PlanError(f"node {i} ({operator['type']}) lacks {e}") from None
        for edge in document.get("edges", ()):
            start, end = edge[0], edge[1]
            if not all(isinstance(x, int) and 0 <= x < len(plan.nodes) for x in (start, end)):
                raise PlanError(f"edge {start} to {end} leads to no node")
            plan.inputs[end].append(start)
        plan.validate()
        return plan

    def validate(self) -> None:
        """Arity, known kinds and acyclicity."""
        for i, (node, inputs) in enumerate(zip(self.nodes, self.inputs, strict=True)):
            least, most = _INPUTS[type(node)]
            if len(inputs) < least or most is not None and len(inputs) > most:
                raise PlanError(f"node {i} ({type(node).__name__}) has {len(inputs)} inputs")
            if isinstance(node, Serialize) and node.format not in _FORMATS:
                raise UnsupportedPlanError(f"format {node.format!r} of node {i}; known are {', '.join(_FORMATS)}")
            if isinstance(node, Join):
                self._validate_join(i, node)
            if isinstance(node, Target):
                for j in inputs:
                    if not isinstance(self.nodes[j], Serialize):
                        raise PlanError(f"target {i} reads from node {j}, which is no serializer")
        self.order()

    @staticmethod
    def _validate_join(i: int, node: Join) -> None:
        if node.predicate != "Equal":
            raise UnsupportedPlanError(f"join predicate {node.predicate!r} of node {i}")
        if node.kind not in ("InnerJoin", "NaturalJoin"):
            raise UnsupportedPlanError(f"join type {node.kind!r} of node {i}")
        if node.kind == "InnerJoin" and not node.pairs:
            raise PlanError(f"inner join {i} has no attribute pairs")

    def order(self) -> Sequence[int]:
        """The nodes, inputs first; raises on a cycle."""
        done: dict[int, bool] = {}
        out: list[int] = []
        for root in range(len(self.nodes)):
            todo = [(root, False)]
            while todo:
                i, left = todo.pop()
                if left:
                    done[i] = True
                    out.append(i)
                elif i not in done:
                    done[i] = False
                    todo.append((i, True))
                    for j in self.inputs[i]:
                        if done.get(j) is False:
                            raise PlanError(f"nodes {i} and {j} are on a cycle")
                        todo.append((j, False))
        return out

    def targets(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if isinstance(n, Target)]
