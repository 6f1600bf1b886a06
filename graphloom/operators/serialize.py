"""Rendering of terms and statements, and the explode that turns rows into statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.templates import Part, parse_statements, terms_of
from ..functions.terms import ANY, BLANK, IRI, LITERAL, Term
from ..options import Options
from ..plans.model import Serialize
from .relation import Relation

#: Statements built by one generator; more would make too long a method of generated code.
CHUNK = 50
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"))


def render(term: Term, options: Options) -> Column:
    c = term.column
    if term.kind == IRI:
        return F.concat(F.lit("<"), c, F.lit(">"))
    if term.kind == BLANK:
        return F.concat(F.lit("_:"), c)
    if term.kind != LITERAL:
        return c
    if options.escape_literals and term.characters == ANY:
        for old, new in _ESCAPES:
            c = F.replace(c, F.lit(old), F.lit(new))
    out = F.concat(F.lit('"'), c, F.lit('"'))
    if options.typed_literals and term.language is not None:
        out = F.concat(out, F.lit("@"), term.language)
    elif options.typed_literals and term.datatype is not None:
        out = F.concat(out, F.lit("^^<"), term.datatype, F.lit(">"))
    return out


def _fill(parts: Sequence[Part], r: Relation, options: Options) -> Column:
    def one(p: Part) -> Column:
        if not p.variable:
            return F.lit(p.text)
        if p.text not in r.scope:
            raise PlanError(f"the template names ?{p.text}; there are {', '.join(sorted(r.scope)) or 'none'}")
        return render(r.scope[p.text], options)

    return F.concat(*map(one, parts))


def statements(r: Relation, node: Serialize, options: Options) -> list[Column]:
    """One column per statement of the template: its line, null where a term is null."""
    return [_fill(parts, r, options) for parts in parse_statements(node.template)]


def quads(r: Relation, node: Serialize, options: Options) -> list[Column]:
    """One struct per statement: subject, predicate, object and graph (null in a triple)."""
    out = []
    for parts in parse_statements(node.template):
        terms = [_fill(t, r, options) for t in terms_of(parts)]
        terms += [F.lit(None).cast("string")] * (4 - len(terms))
        whole = terms[0].isNotNull() & terms[1].isNotNull() & terms[2].isNotNull()
        out.append(F.when(whole, F.struct(*[t.alias(n) for t, n in zip(terms, ("subject", "predicate", "object", "graph"), strict=True)])))
    return out


def explode(df: DataFrame, columns: Sequence[Column], name: str) -> list[DataFrame]:
    """All values that aren't null, in as few generators as codegen allows."""
    out = []
    for at in range(0, len(columns), CHUNK):
        chunk = columns[at : at + CHUNK]
        # a filter on a generated column isn't pushed below, where it would compute the statement again
        out.append(df.select(F.explode(F.array(*chunk)).alias(name)).where(F.col(name).isNotNull()))
    return out


def records(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """One array per row: its statements that aren't null."""
    return df.select(F.filter(F.array(*columns), lambda x: x.isNotNull()).alias("record")).where(F.size("record") > 0)
