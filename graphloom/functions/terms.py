"""Function specifications of a plan, compiled to typed Catalyst columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError, UnsupportedPlanError
from .iri import always_absolute, resolve, uri_encode
from .templates import Part, parse_template

IRI, LITERAL, BLANK, STRING = "iri", "lit", "blank", "str"
ANY, PLAIN, UNRESERVED = "any", "plain", "unreserved"


@dataclass(frozen=True)
class Term:
    """A column with its RDF term kind; literals may have a datatype or language column.

    characters: UNRESERVED if percent-encoding leaves every value alone, PLAIN if at least
    no character needs an escape in a literal, else ANY. stored: the physical column, in its
    own type, whose text this is.
    """

    column: Column
    kind: str = STRING
    datatype: Column | None = None
    language: Column | None = None
    characters: str = ANY
    stored: str | None = None


@dataclass(frozen=True)
class Compiler:
    """Compiles function documents against the names in scope."""

    scope: Mapping[str, Term]
    on_invalid_iri: str = "keep"

    def name(self, name: str) -> Column:
        if name not in self.scope:
            raise PlanError(f"no column {name!r}; there are {', '.join(sorted(self.scope)) or 'none'}")
        return self.scope[name].column

    def compile(self, spec: Mapping) -> Term:
        kind = spec.get("type")
        made = _BUILDERS.get(kind)
        if made is None:
            raise UnsupportedPlanError(f"function type {kind!r}")
        try:
            return made(self, spec)
        except KeyError as e:
            raise PlanError(f"function {kind} lacks {e}") from None

    def text(self, spec: Mapping) -> Column:
        return self.compile(spec).column

    def fill(self, parts: Sequence[Part], value: Callable[[str], Column]) -> Column:
        columns = [value(p.text) if p.variable else F.lit(p.text) for p in parts]
        return F.concat(*columns) if columns else F.lit("")


def _constant(c: Compiler, spec: Mapping) -> Term:
    return Term(F.lit(spec["value"]))


def _reference(c: Compiler, spec: Mapping) -> Term:
    column = c.name(spec["value"])
    return Term(column, characters=c.scope[spec["value"]].characters)


def _template(c: Compiler, spec: Mapping) -> Term:
    return Term(c.fill(parse_template(spec["value"]), c.name))


def _template_functions(c: Compiler, spec: Mapping) -> Term:
    inner = dict(spec["variable_function_pairs"])

    def value(name: str) -> Column:
        if name not in inner:
            raise PlanError(f"template {spec['template']!r} has no function for {name!r}")
        return c.text(inner[name])

    return Term(c.fill(parse_template(spec["template"]), value))


def _uri_encode(c: Compiler, spec: Mapping) -> Term:
    inner = c.compile(spec["inner_function"])
    return Term(inner.column if inner.characters == UNRESERVED else uri_encode(inner.column), characters=UNRESERVED if inner.characters == UNRESERVED else PLAIN)


def _fixed_text(spec: Mapping) -> list[str | None] | None:
    """The literal pieces of a function whose other pieces are all percent-encoded (None), or None."""
    if spec.get("type") == "Constant":
        return [spec["value"]]
    if spec.get("type") == "TemplateFunctionValue":
        inner = dict(spec["variable_function_pairs"])
        parts = parse_template(spec["template"])
        if all(not p.variable or inner.get(p.text, {}).get("type") == "UriEncode" for p in parts):
            return [None if p.variable else p.text for p in parts]
    return None


def _iri(c: Compiler, spec: Mapping) -> Term:
    inner, fixed = spec["inner_function"], _fixed_text(spec["inner_function"])
    value = c.text(inner)
    # where no value can make the IRI invalid, nothing is checked at run time
    if fixed is not None and always_absolute(fixed):
        return Term(value, IRI)
    return Term(resolve(value, spec.get("base_iri"), c.on_invalid_iri), IRI)


def _blank(c: Compiler, spec: Mapping) -> Term:
    return Term(c.text(spec["inner_function"]), BLANK)


def _literal(c: Compiler, spec: Mapping) -> Term:
    extra = {k: c.text(spec[f]) for k, f in (("datatype", "dtype_function"), ("language", "langtype_function")) if spec.get(f)}
    inner = c.compile(spec["inner_function"])
    return Term(inner.column, LITERAL, **extra, characters=inner.characters)


def _args(c: Compiler, spec: Mapping) -> list[Column]:
    found = spec.get("inner_functions") or spec.get("arguments") or [spec["inner_function"]]
    return [c.text(f) for f in found]


def _concatenate(c: Compiler, spec: Mapping) -> Term:
    args, separator = _args(c, spec), spec.get("separator") or ""
    if separator:
        args = [x for a in args for x in (F.lit(separator), a)][1:]
    return Term(F.concat(*args))


def _replace(c: Compiler, spec: Mapping) -> Term:
    return Term(F.replace(c.text(spec["inner_function"]), F.lit(spec["search"]), F.lit(spec["replacement"])))


#: FnO functions by IRI: columns in, column out. Register more with ``register_function``.
_FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register_function(iri: str, build: Callable[..., Column]) -> None:
    """Makes ``build(*columns) -> Column`` available to FnO calls of ``iri``."""
    _FUNCTIONS[iri] = build


def _fno(c: Compiler, spec: Mapping) -> Term:
    iri = spec.get("function") or spec.get("fno_identifier")
    if iri not in _FUNCTIONS:
        raise UnsupportedPlanError(f"function {iri!r} isn't registered")
    return Term(_FUNCTIONS[iri](*_args(c, spec)))


_BUILDERS: dict[str, Callable[[Compiler, Mapping], Term]] = {
    "Constant": _constant,
    "Reference": _reference,
    "TemplateString": _template,
    "TemplateFunctionValue": _template_functions,
    "UriEncode": _uri_encode,
    "Iri": _iri,
    "BlankNode": _blank,
    "Literal": _literal,
    # beyond the base language
    "Concatenate": _concatenate,
    "Lower": lambda c, s: Term(F.lower(c.text(s["inner_function"]))),
    "Upper": lambda c, s: Term(F.upper(c.text(s["inner_function"]))),
    "Replace": _replace,
    "FnO": _fno,
}
