import itertools
import json
import random
from collections import Counter

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from graphloom.api import quads, relation, run, statements, translate
from graphloom.errors import PlanError, SourceError, UnsupportedPlanError
from graphloom.options import Options
from graphloom.plans.lower import Lowering
from graphloom.plans.model import Extend, Join, Plan, Project, Serialize, Source, Target
from graphloom.queries import const, emit, enc, iri, lit, ref, tpl


def lines(df):
    return sorted(r[0] for r in df.collect())


def csv(tmp_path, name, text, **how):
    (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    return Source(str(tmp_path / name), **how)


def rows_of(spark, source, options=None):
    plan = Plan()
    df = relation(plan, plan.add(source), options, spark)
    return df.columns, [tuple(r) for r in df.collect()]


# --- sources ---


def test_csv_dialect(spark, tmp_path):
    text = '﻿a,b\n"x, y","say ""hi"""\n"two\nlines", pad \n\nback\\slash,\n'
    assert rows_of(spark, csv(tmp_path, "d.csv", text)) == (["a", "b"], [("x, y", 'say "hi"'), ("two\nlines", " pad "), ("back\\slash", "")])


def test_csv_empty_fields_are_text(spark, tmp_path):
    assert rows_of(spark, csv(tmp_path, "e.csv", 'a,b\n,""\n')) == (["a", "b"], [("", "")])


def test_header_only_and_empty_files(spark, tmp_path):
    assert rows_of(spark, csv(tmp_path, "h.csv", "label\n")) == (["label"], [])
    assert rows_of(spark, csv(tmp_path, "z.csv", ""))[1] == []


@pytest.mark.parametrize("bad", ["1", "1,2,3"])
def test_ragged_rows_fail(spark, tmp_path, bad):
    with pytest.raises((PySparkException, Py4JJavaError), match="(?i)malformed"):
        rows_of(spark, csv(tmp_path, "r.csv", f"a,b\n1,2\n{bad}\n"))


def test_headers_bind_by_position(spark, tmp_path):
    source = csv(tmp_path, "n.csv", "ID,id,a.b,,ID\n1,2,3,4,5\n")
    plan = Plan()
    at = plan.add(source)
    out = [emit(plan, at, {"s": iri(const("urn:s")), "o": lit(ref(n))}, "?s <urn:p> ?o .") for n in ("ID", "id", "a.b", "")]
    assert len(out) == 4
    assert lines(statements(plan, spark=spark)) == [f'<urn:s> <urn:p> "{i}" .' for i in (1, 2, 3, 4)]


def test_paths(spark, tmp_path, monkeypatch):
    csv(tmp_path, "p.csv", "a\n1\n")
    assert rows_of(spark, Source("p.csv"), Options(working_dir_hint=str(tmp_path)))[1] == [("1",)]
    monkeypatch.chdir(tmp_path)
    assert rows_of(spark, Source("p.csv"))[1] == [("1",)]
    with pytest.raises(SourceError, match="File not found"):
        rows_of(spark, Source("missing.csv"))


def test_typed_sources(spark, tmp_path):
    spark.sql("SELECT 1 AS n, CAST(1.50 AS DECIMAL(9,2)) AS d, true AS b, CAST(NULL AS STRING) AS z").write.parquet(str(tmp_path / "t.parquet"))
    assert rows_of(spark, Source(str(tmp_path / "t.parquet"), "File", "Parquet")) == (["n", "d", "b", "z"], [("1", "1.50", "true", None)])
    (tmp_path / "j.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(rows_of(spark, Source(str(tmp_path / "j.json"), "File", "JSONPath"))[1]) == [("1",), ("2",)]
    (tmp_path / "x.xml").write_text("<r><row><a>1</a></row><row><a>2</a></row></r>")
    assert sorted(rows_of(spark, Source(str(tmp_path / "x.xml"), "File", "XMLPath", (("rowTag", "row"),)))[1]) == [("1",), ("2",)]


# --- joins ---


def join_of(spark, tmp_path, left, right, pairs, kind="InnerJoin"):
    plan = Plan()
    at = plan.add(Join(tuple(pairs), "j", kind), plan.add(csv(tmp_path, "l.csv", left)), plan.add(csv(tmp_path, "r.csv", right)))
    df = relation(plan, at, spark=spark)
    return df.columns, sorted(tuple(r) for r in df.collect())


def test_join_matches_nested_loops(spark, tmp_path):
    rng = random.Random(3)
    table = lambda: [tuple(rng.choice(["", "a", "b", "c"]) for _ in range(3)) for _ in range(30)]
    left, right = table(), table()
    text = lambda head, rows: "\n".join([head, *(",".join(f'"{x}"' for x in r) for r in rows)]) + "\n"
    columns, got = join_of(spark, tmp_path, text("a,b,v", left), text("w,b,a", right), [("a", "a"), ("b", "b")])
    assert columns == ["a", "b", "v", "j_w", "j_b", "j_a"]
    assert Counter(got) == Counter(x + y for x, y in itertools.product(left, right) if (x[0], x[1]) == (y[2], y[1]))


def test_self_join_with_a_condition_is_a_join(spark, tmp_path):
    plan = Plan()
    at = plan.add(csv(tmp_path, "e.csv", "id,boss\n1,\n2,1\n3,1\n"))
    df = relation(plan, plan.add(Join((("boss", "id"),), "m"), at, at), spark=spark)
    assert sorted(tuple(r) for r in df.select("id", "m_id").collect()) == [("2", "1"), ("3", "1")]


def test_natural_join_is_the_row_itself(spark, tmp_path):
    plan, source = Plan(), csv(tmp_path, "s.csv", "id,sport\n1,x\n2,x\n")
    left, right = plan.add(Project(("id",)), plan.add(source)), plan.add(Project(("sport",)), plan.add(source))
    df = relation(plan, plan.add(Join((), "join_1", "NaturalJoin"), left, right), spark=spark)
    assert sorted(tuple(r) for r in df.collect()) == [("1", "x"), ("2", "x")] and df.columns == ["id", "join_1_sport"]


def test_bad_joins(spark, tmp_path):
    with pytest.raises(UnsupportedPlanError):
        join_of(spark, tmp_path, "a\n", "b\n", [], "NaturalJoin")
    with pytest.raises(PlanError):
        join_of(spark, tmp_path, "a\n", "b\n", [])
    with pytest.raises(PlanError, match="no join column"):
        join_of(spark, tmp_path, "a\n", "b\n", [("a", "x")])
    with pytest.raises(UnsupportedPlanError):
        join_of(spark, tmp_path, "a\n", "b\n", [("a", "b")], "LeftJoin")


# --- serialisation ---


def test_literals_are_escaped(spark, tmp_path):
    plan = Plan()
    emit(plan, plan.add(csv(tmp_path, "q.csv", 'v\n"a""b\\c\nd"\n')), {"s": iri(const("urn:s")), "o": lit(ref("v"))}, "?s <urn:p> ?o .")
    assert lines(statements(plan, spark=spark)) == ['<urn:s> <urn:p> "a\\"b\\\\c\\nd" .']
    assert lines(statements(plan, Options(escape_literals=False), spark)) == ['<urn:s> <urn:p> "a"b\\c\nd" .']


def branches(tmp_path):
    plan, source = Plan(), csv(tmp_path, "b.csv", "id,k\n1,x\n2,x\n2,x\n")
    functions = {"s": iri(tpl("urn:i:{id}", "id")), "g": iri(tpl("urn:k:{k}", "k"))}
    emit(plan, plan.add(source), functions, "?g <urn:a> <urn:K> .\n?s <urn:in> ?g .")
    emit(plan, plan.add(source), functions, "?s <urn:in> ?g .")
    return plan


@pytest.mark.parametrize("fuse", [True, False])
def test_dedup_scopes(spark, tmp_path, fuse):
    kind, one, two = "<urn:k:x> <urn:a> <urn:K> .", "<urn:i:1> <urn:in> <urn:k:x> .", "<urn:i:2> <urn:in> <urn:k:x> ."
    got = lambda **o: Counter(lines(statements(branches(tmp_path), Options(fuse_siblings=fuse, **o), spark)))
    assert got() == Counter({kind: 3, one: 2, two: 4})
    assert got(deduplicate=True) == Counter([kind, one, two])
    assert got(deduplicate=True, dedup_scope="record") == Counter({kind: 2, one: 2, two: 2})


def test_siblings_share_one_scan(spark, tmp_path):
    plan = lambda fuse: statements(branches(tmp_path), Options(fuse_siblings=fuse), spark)._jdf.queryExecution().executedPlan().toString()
    assert plan(True).count("FileScan") == 1 and plan(False).count("FileScan") == 2


def test_many_statements_are_chunked(spark, tmp_path):
    plan = Plan()
    emit(plan, plan.add(csv(tmp_path, "m.csv", "v\nx\n")), {"o": lit(ref("v"))}, "\n".join(f"<urn:s> <urn:p{i}> ?o ." for i in range(120)))
    assert statements(plan, spark=spark).distinct().count() == 120


def test_quads(spark, tmp_path):
    plan = Plan()
    emit(plan, plan.add(csv(tmp_path, "g.csv", "v\nx\n")), {"o": lit(ref("v"))}, '<urn:s> <urn:p> ?o^^<urn:t> <urn:g> .\n<urn:s> <urn:p> "a b" .')
    got = sorted(tuple(r) for r in quads(plan, spark=spark).collect())
    assert got == [("<urn:s>", "<urn:p>", '"a b"', None), ("<urn:s>", "<urn:p>", '"x"^^<urn:t>', "<urn:g>")]


def test_invalid_iris(spark, tmp_path):
    plan = Plan()
    emit(plan, plan.add(csv(tmp_path, "i.csv", "v\na b\nurn:x\n")), {"s": iri(ref("v"))}, "?s <urn:p> <urn:o> .")
    assert lines(statements(plan, spark=spark)) == ["<INVALID> <urn:p> <urn:o> .", "<urn:x> <urn:p> <urn:o> ."]
    assert lines(statements(plan, Options(on_invalid_iri="drop"), spark)) == ["<urn:x> <urn:p> <urn:o> ."]


# --- documents, targets, mappings ---


def node(kind, **config):
    return {"id": "n", "operator": {"type": kind, "config": config}}


def document(path, /, **target):
    source = node("SourceOp", path=path, source_type="File", root_iterator={"reference": None, "reference_formulation": "CSVRows", "fields": [], "alias": None})
    extend = node("ExtendOp", **{"?s": iri(tpl("urn:{id}", "id")), "?o": lit(ref("name"))})
    nodes = [source, node("ProjectOp", projection_attributes=["id", "name"]), node("FragmentOp", **{"from": "default", "to": ["default"]}), extend]
    nodes += [node("SerializerOp", template="?s <urn:name> ?o .", format="NTriples"), node("TargetOp", **({"target_type": "StdOut", "data_format": "NTriples"} | target))]
    return {"nodes": nodes, "edges": [[i, i + 1, {"fragment": "default"}] for i in range(5)]}


def test_document_to_stdout_and_file(spark, tmp_path, capsys):
    csv(tmp_path, "d.csv", "id,name\n1,Ünal\n")
    text = json.dumps(document("d.csv"))
    hint = {"working_dir_hint": str(tmp_path)}
    want = '<urn:1> <urn:name> "Ünal" .\n'
    run(text, Options(**hint), spark)
    assert capsys.readouterr().out == want
    out = tmp_path / "out.nt"
    run(text, Options(force_to_file=str(out), **hint), spark)
    assert out.read_text(encoding="utf-8") == want and capsys.readouterr().out == ""
    run(text, Options(force_to_file=str(tmp_path / "no.nt"), force_to_std_out=True, **hint), spark)
    assert capsys.readouterr().out == want and not (tmp_path / "no.nt").exists()
    run(document("d.csv", target_type="File", path=str(tmp_path / "planned.nt")), Options(**hint), spark)
    assert (tmp_path / "planned.nt").read_text(encoding="utf-8") == want
    run(text, Options(force_to_file=f"{tmp_path}/parts/", **hint), spark)
    assert "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "parts").glob("part-*")) == want


def test_missing_input_leaves_outputs_alone(spark, tmp_path):
    out = tmp_path / "kept.nt"
    out.write_text("old")
    with pytest.raises(SourceError):
        run(document("gone.csv"), Options(force_to_file=str(out)), spark)
    assert out.read_text() == "old"


def test_bad_documents(spark, tmp_path):
    good = document("d.csv")
    with pytest.raises(PlanError):
        Plan.from_json("{")
    with pytest.raises(PlanError, match="no node"):
        Plan.from_json({**good, "edges": good["edges"] + [[0, 99, {}]]})
    with pytest.raises(UnsupportedPlanError):
        Plan.from_json({"nodes": [node("SortOp")], "edges": []})
    with pytest.raises(PlanError, match="lacks"):
        Plan.from_json({"nodes": [node("ProjectOp")], "edges": []})
    with pytest.raises(PlanError, match="inputs"):
        Plan.from_json({**good, "edges": good["edges"][1:]})
    with pytest.raises(PlanError, match="cycle"):
        Plan.from_json({"nodes": [node("FragmentOp"), node("FragmentOp")], "edges": [[0, 1, {}], [1, 0, {}]]})
    bad = json.loads(json.dumps(good).replace('"NTriples"', '"Turtle"'))
    with pytest.raises(UnsupportedPlanError, match="format"):
        Plan.from_json(bad)
    csv(tmp_path, "d.csv", "id,name\n1,x\n")
    hint = Options(working_dir_hint=str(tmp_path))
    with pytest.raises(UnsupportedPlanError, match="target"):
        run(document("d.csv", target_type="Kafka"), hint, spark)
    with pytest.raises(PlanError, match="no column"):
        run(json.loads(json.dumps(good).replace('["id", "name"]', '["id", "nope"]')), hint, spark)
    with pytest.raises(UnsupportedPlanError):
        statements(json.loads(json.dumps(good).replace("CSVRows", "Nope")), hint, spark)


def test_equal_sources_are_one_relation(spark, tmp_path):
    plan, source = Plan(), csv(tmp_path, "q.csv", "a\n1\n")
    a, b = plan.add(source), plan.add(Source(source.path))
    low = Lowering(plan, spark, Options())
    assert low.relation(a) is low.relation(b)


MAPPING = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> . @prefix ex: <http://ex/> . @base <http://ex/b/> .
# people and their departments
<E> a rr:TriplesMap; rml:logicalSource [ rml:source "employee.csv"; rml:referenceFormulation ql:CSV ];
  rr:subjectMap [ rr:template "http://ex/e/{eid}"; rr:class ex:Person; rr:graph ex:staff ];
  rr:predicateObjectMap [ rr:predicate ex:name, ex:label; rr:objectMap [ rml:reference "name"; rr:language "en" ]; rr:graph ex:names ];
  rr:predicateObjectMap [ rr:predicate ex:kind; rr:object "a \\"b\\"" ];
  rr:predicateObjectMap [ rr:predicate ex:worksIn; rr:objectMap [ rr:parentTriplesMap <D>; rr:joinCondition [ rr:child "dept"; rr:parent "did" ] ] ].
<D> rml:logicalSource [ rml:source "dept.csv"; rml:referenceFormulation ql:CSV ];
  rr:subjectMap [ rml:reference "did"; rr:termType rr:BlankNode ];
  rr:predicateObjectMap [ rr:predicate ex:name; rr:objectMap [ rml:reference "name"; rr:datatype <http://t> ] ] .
"""


def test_rml(spark, tmp_path):
    csv(tmp_path, "employee.csv", "eid,dept,name\n1,a,Ann B\n2,zz,Bob\n")
    csv(tmp_path, "dept.csv", "did,name\na,Art\nb,Bio\n")
    got = lines(statements(translate(MAPPING), Options(working_dir_hint=str(tmp_path), deduplicate=True, typed_literals=True), spark))
    want = []
    for i, name in ((1, "Ann B"), (2, "Bob")):
        s = f"<http://ex/e/{i}>"
        want += [f"{s} <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/Person> <http://ex/staff> ."]
        want += [f'{s} <http://ex/{p}> "{name}"@en <http://ex/{g}> .' for p in ("name", "label") for g in ("staff", "names")]
        want += [f'{s} <http://ex/kind> "a \\"b\\"" <http://ex/staff> .']
    want += ["<http://ex/e/1> <http://ex/worksIn> _:a <http://ex/staff> .", '_:a <http://ex/name> "Art"^^<http://t> .', '_:b <http://ex/name> "Bio"^^<http://t> .']
    assert got == sorted(want)


@pytest.mark.parametrize("change", [("rr:template", "rr:templates"), ("ql:CSV", "ql:Nope"), ("<D>;", "<X>;"), ("ex:label", "no:label"), ("@base", "@@")])
def test_bad_rml(change):
    with pytest.raises(PlanError):
        translate(MAPPING.replace(*change))


SHEXML = """PREFIX : <http://ex/>
SOURCE a <a.csv>  # two files with the same rows
SOURCE b <b.csv>
ITERATOR it <csvperrow> {
  FIELD id <ID>
  FIELD name <Full name>
}
EXPRESSION people <a.it UNION b.it>
:Person :[people.id] { :name [people.name] ; :knows :[people.name] }
"""


def test_shexml(spark, tmp_path):
    csv(tmp_path, "a.csv", "ID,Full name\n1,A B\n")
    csv(tmp_path, "b.csv", "ID,Full name\n2,C\n")
    got = lines(statements(translate(SHEXML, "shexml"), Options(working_dir_hint=str(tmp_path)), spark))
    assert got == sorted(x for i, n, e in ((1, "A B", "A%20B"), (2, "C", "C")) for x in (f'<http://ex/{i}> <http://ex/name> "{n}" .', f"<http://ex/{i}> <http://ex/knows> <http://ex/{e}> ."))


@pytest.mark.parametrize("change", [("UNION", "JOIN"), ("a.it", "c.it"), (":Person :[", ":Person no:["), ("csvperrow", "xpath: /a"), ("people.name] ;", "others.name] ;"), ("FIELD id", "ITERATOR id"), ("}\nEXPRESSION", "EXPRESSION")])
def test_bad_shexml(change):
    with pytest.raises(PlanError):
        translate(SHEXML.replace(*change), "shexml")


def test_cli(spark, tmp_path, capsys):
    from graphloom.cli import main

    csv(tmp_path, "employee.csv", "eid,dept,name\n1,a,Ann\n")
    csv(tmp_path, "dept.csv", "did,name\na,Art\n")
    (tmp_path / "m.ttl").write_text(MAPPING)
    assert main(["-m", str(tmp_path / "m.ttl"), "-l", "rml", "-d"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == len(set(out)) == 8
    assert main(["-m", str(tmp_path / "none.json")]) == 1
    assert "error" in capsys.readouterr().err


def test_streaming(spark, tmp_path):
    from graphloom.streaming import start, stream_statements

    (tmp_path / "in").mkdir()
    csv(tmp_path / "in", "1.csv", "id,name\n1,x\n")
    plan = Plan()
    emit(plan, plan.add(Source(str(tmp_path / "in"))), {"s": iri(tpl("urn:{id}", "id")), "o": lit(ref("name"))}, "?s <urn:n> ?o .\n?s <urn:a> <urn:T> .")

    def drain():
        start(stream_statements(plan, spark=spark), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return lines(spark.read.text(str(tmp_path / "out")))

    assert len(drain()) == 2
    csv(tmp_path / "in", "2.csv", "id,name\n2,y\n")
    assert drain() == sorted(x for i, n in (("1", "x"), ("2", "y")) for x in (f'<urn:{i}> <urn:n> "{n}" .', f"<urn:{i}> <urn:a> <urn:T> ."))
    with pytest.raises(UnsupportedPlanError):
        stream_statements(plan, Options(deduplicate=True), spark)


def test_unused_helpers_compile(spark):
    assert enc("a")["inner_function"] == ref("a")
    assert isinstance(Extend({}), Extend) and isinstance(Serialize(""), Serialize) and isinstance(Target(), Target)


def test_headers_of_all_files_are_held_against_each_other(spark, tmp_path):
    for name, text in (("a", "id,name\n1,ann\n"), ("b", "name,id\nbob,2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    plan = Plan()
    with pytest.raises(Exception, match="header"):
        relation(plan, plan.add(Source(str(tmp_path))), spark=spark).collect()


def test_lines_are_split_only_where_no_field_spans_them(spark, tmp_path):
    from graphloom.sources.readers import _spans_lines

    (tmp_path / "a.csv").write_text('id,t\n1,"a ""b"", c"\n')
    (tmp_path / "b.csv").write_text('id,t\n1,"a\nb"\n')
    assert not _spans_lines(spark, str(tmp_path / "a.csv")) and _spans_lines(spark, str(tmp_path / "b.csv"))
    for name, want in (("a", 'a "b", c'), ("b", "a\nb")):
        plan = Plan()
        assert relation(plan, plan.add(Source(str(tmp_path / f"{name}.csv"))), spark=spark).head().t == want


def test_rml_iterator_reaches_the_source():
    mapping = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://semweb.mmlab.be/ns/rml#> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> .
    <#m> rml:logicalSource [ rml:source "x.json" ; rml:referenceFormulation ql:JSONPath ; rml:iterator "$.a[*]" ] ; rr:subjectMap [ rr:template "http://e.org/{id}" ] ;
      rr:predicateObjectMap [ rr:predicate <http://e.org/p> ; rr:objectMap [ rml:reference "id" ] ] ."""
    plan = translate(mapping, "rml")
    assert [n.iterator for n in plan.nodes if isinstance(n, Source)] == ["$.a[*]"]
