import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.errors import TemplateError
from graphloom.functions.templates import Part, parse_statements, parse_template, terms_of


def shown(template):
    return [("{%s}" if p.variable else "%s") % p.text for p in parse_template(template)]


@pytest.mark.parametrize(
    "template, parts",
    [
        ("http://h/{name}", ["http://h/", "{name}"]),
        ("plain", ["plain"]),
        ("{a}{b}", ["{a}", "{b}"]),
        ("x{a}y{b}", ["x", "{a}", "y", "{b}"]),
        (r"\{{a}\}", ["{", "{a}", "}"]),
        (r"{a\}b}", ["{a}b}"]),
        (r"\\{a}", ["\\", "{a}"]),
        ("a{}b", ["ab"]),
        ("", []),
    ],
)
def test_templates(template, parts):
    got = shown(template)
    assert "".join(got) == "".join(parts)
    assert [g for g in got if g.startswith("{") and len(g) > 1] == [p for p in parts if p.startswith("{") and len(p) > 1]


@pytest.mark.parametrize("template", ["{a{b}}", r"\n", "{a", "a}", "a\\"])
def test_bad_templates(template):
    with pytest.raises(TemplateError):
        parse_template(template)


@given(st.text(), st.text(min_size=1))
def test_escaping_round_trips(text, name):
    esc = lambda s: s.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}")
    parts = parse_template(f"{esc(text)}{{{esc(name)}}}")
    assert parts == ([Part(text)] if text else []) + [Part(name, True)]


def test_statements():
    two = parse_statements("?s <http://h/x?a=1> ?o .\n\n  ?s ?p \"a ?b\" ?g .\n")
    assert [[p.text for p in s if p.variable] for s in two] == [["s", "o"], ["s", "p", "g"]]
    assert two[0][1].text == " <http://h/x?a=1> "


def test_typed_statement_terms():
    (one,) = parse_statements("?s <p> ?o^^<http://t> .")
    assert [[p.text for p in t] for t in terms_of(one)] == [["s"], ["<p>"], ["o", "^^", "<http://t>"]]
    with pytest.raises(TemplateError):
        terms_of(parse_statements("?s ?p .")[0])
