"""Plan-time parsers of IRI templates and of statement templates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import TemplateError


@dataclass(frozen=True)
class Part:
    """A piece of a template: literal text, or the name of a variable."""

    text: str
    variable: bool = False


def parse_template(template: str) -> list[Part]:
    r"""Literal and variable parts of ``http://h/{name}``; ``\{``, ``\}`` and ``\\`` are escapes and ``{}`` is nothing."""
    parts: list[Part] = []
    text, name = "", None
    symbols = iter(template)
    for c in symbols:
        if c == "\\":
            c = next(symbols, "")
            if c not in ("{", "}", "\\"):
                raise TemplateError(f"\\{c} is no escape in template {template!r}")
        elif c == "{":
            if name is not None:
                raise TemplateError(f"a brace opens within braces in template {template!r}")
            if text:
                parts.append(Part(text))
            text, name = "", ""
            continue
        elif c == "}":
            if name is None:
                raise TemplateError(f"a brace closes that isn't open in template {template!r}")
            if name:
                parts.append(Part(name, True))
            name = None
            continue
        if name is None:
            text += c
        else:
            name += c
    if name is not None:
        raise TemplateError(f"a brace stays open in template {template!r}")
    return [*parts, Part(text)] if text else parts


# <...> and "..." are opaque, so that a question mark in an IRI starts no variable
_STATEMENT = re.compile(r"<[^<>\n]*>|\"(?:[^\"\\\n]|\\.)*\"|\?(?P<name>[^\s^@?<>\"]+)|\s+|.", re.S)


def parse_statements(template: str) -> list[list[Part]]:
    """The statements of a serializer template, one per line that isn't blank, each as parts."""
    out = []
    for line in template.split("\n"):
        parts: list[Part] = []
        for m in _STATEMENT.finditer(line.strip()):
            if m["name"]:
                parts.append(Part(m["name"], True))
            elif parts and not parts[-1].variable:
                parts[-1] = Part(parts[-1].text + m[0])
            else:
                parts.append(Part(m[0]))
        if parts:
            out.append(parts)
    return out


def terms_of(statement: list[Part]) -> list[list[Part]]:
    """A statement's terms (3 or 4) without the closing dot, each as parts."""
    terms: list[list[Part]] = [[]]
    for part in statement:
        if part.variable:
            terms[-1].append(part)
            continue
        for piece in re.findall(r"<[^<>]*>|\"(?:[^\"\\]|\\.)*\"|\s+|[^\s<\"]+", part.text):
            if piece.isspace():
                terms.append([])
            else:
                terms[-1].append(Part(piece))
    terms = [t for t in terms if t and t != [Part(".")]]
    if len(terms) not in (3, 4):
        raise TemplateError(f"a statement has {len(terms)} terms, not 3 or 4")
    return terms
