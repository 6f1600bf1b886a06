"""Relations, and the operators that map relations to relations.

A relation is a DataFrame and a scope: logical names, each with a term over the frame's
physical columns. Names never pass through Spark's resolution, so projections and aliases
cost nothing and several branches share one DataFrame, hence one scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError, UnsupportedPlanError
from ..functions.terms import Compiler, Term
from ..plans.model import Extend, Join, Project, Rename
from . import fanout


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    scope: Mapping[str, Term]


def from_read(df: DataFrame, names: list[str], characters: list[str], tag: str) -> Relation:
    """Physical columns get names that no other relation has; of equal logical names the first is bound."""
    df = df.toDF(*[f"{tag}_{i}" for i in range(len(names))])
    scope: dict[str, Term] = {}
    for i, name in enumerate(names):
        scope.setdefault(name, stored(df, f"{tag}_{i}", characters=characters[i]))
    return Relation(df, scope)


def stored(df: DataFrame, column: str, **more) -> Term:
    """The text of a physical column."""
    text = F.col(column) if isinstance(df.schema[column].dataType, T.StringType) else F.col(column).cast("string")
    return Term(text, stored=column, **more)


def project(r: Relation, node: Project) -> Relation:
    missing = [a for a in node.attributes if a not in r.scope]
    if missing:
        raise PlanError(f"no column {', '.join(map(repr, missing))}; there are {', '.join(sorted(r.scope)) or 'none'}")
    return Relation(r.df, {a: r.scope[a] for a in node.attributes})


def rename(r: Relation, node: Rename) -> Relation:
    to = dict(node.pairs)
    if missing := to.keys() - r.scope.keys():
        raise PlanError(f"no column {', '.join(map(repr, sorted(missing)))} to rename")
    return Relation(r.df, {to.get(k, k): t for k, t in r.scope.items()})


def extend(r: Relation, node: Extend, on_invalid_iri: str) -> Relation:
    """Exactly the given columns; the input's aren't passed through."""
    compiler = Compiler(r.scope, on_invalid_iri)
    return Relation(r.df, {name: compiler.compile(spec) for name, spec in node.functions.items()})


def join(left: Relation, right: Relation, node: Join, tag: str) -> Relation:
    """Left columns as they are and right columns named ``<alias>_<name>``; a bag-semantics equi-join over all pairs.

    A natural join without pairs is the row itself, if both sides are the same relation.
    """
    prefixed = lambda scope: {f"{node.alias}_{k}": t for k, t in scope.items()}
    if node.kind == "NaturalJoin" and not node.pairs:
        if left.df is not right.df:
            raise UnsupportedPlanError("a natural join of different sources")
        return Relation(left.df, {**left.scope, **prefixed(right.scope)})
    for side, scope in ((0, left.scope), (1, right.scope)):
        for pair in node.pairs:
            if pair[side] not in scope:
                raise PlanError(f"no join column {pair[side]!r} on the {'right' if side else 'left'}")
    # only what is in scope goes on; fresh names on both sides make self-joins unambiguous
    names = {s: {k: f"{tag}{s}_{i}" for i, k in enumerate(r.scope)} for s, r in (("l", left), ("r", right))}
    # columns are shuffled in their own types and become text afterwards
    carry = lambda r, s: r.df.select(*[(F.col(t.stored) if t.stored else t.column).alias(names[s][k]) for k, t in r.scope.items()])
    l_df, r_df = carry(left, "l"), carry(right, "r")
    frames = {"l": l_df, "r": r_df}
    term = lambda s, k, t: stored(frames[s], names[s][k], kind=t.kind, characters=t.characters)
    on = []
    for a, b in node.pairs:
        x, y = names["l"][a], names["r"][b]
        same = l_df.schema[x].dataType == r_df.schema[y].dataType and isinstance(l_df.schema[x].dataType, (T.IntegralType, T.BooleanType, T.DateType, T.StringType))
        # equal text, which for these types is equal value
        on.append((F.col(x), F.col(y)) if same else (term("l", a, left.scope[a]).column, term("r", b, right.scope[b]).column))
    # where a row meets many, columns become text before they meet
    text = [[term(s, k, t).column.alias(names[s][k]) for k, t in r.scope.items()] for s, r in (("l", left), ("r", right))]
    if on and (df := fanout.join((l_df, [x for x, _ in on]), (r_df, [y for _, y in on]), text, [(names["l"][a], names["r"][b]) for a, b in node.pairs])) is not None:
        frames = {"l": df, "r": df}
    else:
        df = l_df.join(r_df, [x == y for x, y in on], "inner")
    scope = {k: term("l", k, t) for k, t in left.scope.items()} | prefixed({k: term("r", k, t) for k, t in right.scope.items()})
    return Relation(df, scope)
