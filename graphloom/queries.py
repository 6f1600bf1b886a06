"""Registered queries of the mapping engine and their oracle SQL.

Every query is a plan over the driver's tables. Numbers enter as their canonical text.
"""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import quads, relation, run, statements, translate
from .errors import MappingError
from .functions.iri import ABSOLUTE, REFERENCE
from .options import Options
from .sources.paths import scratch
from .plans.model import Extend, Fragment, Join, Plan, Project, Rename, Serialize, Source, Target

EX = "http://ex.org/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD = "http://www.w3.org/2001/XMLSchema#"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return register


# --- plan pieces -------------------------------------------------------------


def ref(name: str) -> dict:
    return {"type": "Reference", "value": name}


def const(value: str) -> dict:
    return {"type": "Constant", "value": value}


def enc(name: str) -> dict:
    return {"type": "UriEncode", "inner_function": ref(name)}


def iri(inner: dict, base: str | None = None) -> dict:
    return {"type": "Iri", "base_iri": base, "inner_function": inner}


def lit(inner: dict, datatype: str | None = None, language: dict | None = None) -> dict:
    return {"type": "Literal", "inner_function": inner, "dtype_function": const(datatype) if datatype else None, "langtype_function": language}


def tpl(template: str, *names: str) -> dict:
    return {"type": "TemplateFunctionValue", "template": template, "variable_function_pairs": [[n, enc(n)] for n in names]}


def scan(plan: Plan, sf_dir: str, table: str, *attributes: str) -> int:
    at = plan.add(Source(f"{sf_dir}/{table}.parquet", "File", "Parquet"))
    return plan.add(Project(attributes), at) if attributes else at


def emit(plan: Plan, at: int, functions: dict[str, dict], template: str) -> int:
    return plan.add(Target(), plan.add(Serialize(template), plan.add(Extend(functions), at)))


def _extended(spark: SparkSession, sf_dir: str, table: str, functions: dict[str, dict], *attributes: str, options: Options | None = None) -> DataFrame:
    plan = Plan()
    at = plan.add(Extend(functions), scan(plan, sf_dir, table, *attributes))
    return relation(plan, at, options, spark)


# --- sources and projections ---------------------------------------------------


@_query("source_csv_roundtrip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def source_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as CSV and back. The file lies in the folder that executors share."""
    path = scratch(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.option("header", True).csv(path)
    plan = Plan()
    return relation(plan, plan.add(Source(path)), spark=spark)


@_query("source_project", "SELECT c_name, c_mktsegment FROM customer")
def source_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    return relation(plan, scan(plan, sf_dir, "customer", "c_name", "c_mktsegment"), spark=spark)


@_query("source_typed_text", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS VARCHAR) AS ts, CAST(user_id AS VARCHAR) AS user_id, event_type, props FROM events")
def source_typed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    return relation(plan, scan(plan, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props"), spark=spark)


@_query("source_view", "SELECT r_name FROM region")
def source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"region_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView(name)
    plan = Plan()
    return relation(plan, plan.add(Project(("r_name",)), plan.add(Source(name, "Table", "Rows"))), spark=spark)


@_query("rename_columns", "SELECT s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    at = plan.add(Rename((("s_name", "name"), ("s_nationkey", "nation"))), scan(plan, sf_dir, "supplier", "s_name", "s_nationkey"))
    return relation(plan, at, spark=spark)


@_query("extend_replaces_schema", "SELECT p_name AS label FROM part")
def extend_replaces_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "part", {"label": ref("p_name")}, "p_name", "p_brand")


# --- functions -------------------------------------------------------------------


@_query("fn_constant", "SELECT 'http://ex.org/placedBy' AS p FROM orders")
def fn_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "orders", {"p": iri(const(f"{EX}placedBy"))})


@_query("fn_reference", "SELECT c_name AS v FROM customer")
def fn_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "customer", {"v": ref("c_name")})


@_query("fn_template_string", "SELECT 'http://ex.org/' || c_custkey || '/' || c_name AS v FROM customer")
def fn_template_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "customer", {"v": {"type": "TemplateString", "value": EX + "{c_custkey}/{c_name}"}})


@_query("fn_template_escapes", r"SELECT '{' || r_name || '}\' || r_regionkey AS v FROM region")
def fn_template_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "region", {"v": {"type": "TemplateString", "value": r"\{{r_name}\}\\{r_regionkey}{}"}})


@_query("fn_uri_encode", "SELECT CAST(doc_id AS VARCHAR) AS id, url_encode(text) AS v FROM documents")
def fn_uri_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "documents", {"id": ref("doc_id"), "v": enc("text")})


@_query("fn_template_function_value", "SELECT 'http://ex.org/' || url_encode(p_brand) || '/' || url_encode(p_name) AS v FROM part")
def fn_template_function_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "part", {"v": iri(tpl(EX + "{p_brand}/{p_name}", "p_brand", "p_name"))})


def _iri_sql(value: str, base: str | None, invalid: str = "'INVALID'") -> str:
    joined = f"'{base}' || {value}" if base else value
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    test = lambda v, p: f"regexp_matches(regexp_replace({v}, '%[0-9A-Fa-f]{{2}}', '_', 'g'), {quoted(p)})"
    return f"CASE WHEN {test(value, ABSOLUTE)} THEN {value} WHEN {test(joined, REFERENCE)} THEN {joined} ELSE {invalid} END"


@_query("fn_iri_absolute", f"SELECT {_iri_sql('url', None)} AS v FROM pages")
def fn_iri_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "pages", {"v": iri(ref("url"))})


@_query("fn_iri_base", f"SELECT {_iri_sql('c_name', EX)} AS v FROM customer")
def fn_iri_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "customer", {"v": iri(ref("c_name"), EX)})


@_query("fn_iri_invalid", f"SELECT CAST(doc_id AS VARCHAR) AS id, {_iri_sql('text', EX)} AS v FROM documents")
def fn_iri_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, sf_dir, "documents", {"id": ref("doc_id"), "v": iri(ref("text"), EX)})


@_query("fn_blank_node", "SELECT '_:c' || c_custkey || ' <http://ex.org/in> _:n' || c_nationkey || ' .' AS line FROM customer")
def fn_blank_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    blank = lambda t: {"type": "BlankNode", "inner_function": {"type": "TemplateString", "value": t}}
    emit(plan, scan(plan, sf_dir, "customer"), {"s": blank("c{c_custkey}"), "o": blank("n{c_nationkey}")}, f"?s <{EX}in> ?o .")
    return statements(plan, spark=spark)


@_query("fn_string_functions", "SELECT lower(p_name) AS l, upper(p_brand) AS u, p_brand || '-' || p_type AS c, replace(p_name, 'a', 'b') AS r FROM part")
def fn_string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda kind, name, **more: {"type": kind, "inner_function": ref(name), **more}
    both = {"type": "Concatenate", "inner_functions": [ref("p_brand"), ref("p_type")], "separator": "-"}
    return _extended(spark, sf_dir, "part", {"l": one("Lower", "p_name"), "u": one("Upper", "p_brand"), "c": both, "r": one("Replace", "p_name", search="a", replacement="b")})


# --- joins and fan-out -------------------------------------------------------------


@_query("join_inner", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(c_custkey AS VARCHAR) AS join_0_c_custkey, c_name AS join_0_c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    at = plan.add(Join((("o_custkey", "c_custkey"),), "join_0"), scan(plan, sf_dir, "orders", "o_orderkey", "o_custkey"), scan(plan, sf_dir, "customer", "c_custkey", "c_name"))
    return relation(plan, at, spark=spark)


@_query(
    "join_multi_key",
    "SELECT CAST(a.l_orderkey AS VARCHAR) AS l_orderkey, CAST(a.l_linenumber AS VARCHAR) AS l_linenumber, CAST(a.l_partkey AS VARCHAR) AS l_partkey, CAST(b.l_orderkey AS VARCHAR) AS j_l_orderkey, CAST(b.l_linenumber AS VARCHAR) AS j_l_linenumber, CAST(b.l_suppkey AS VARCHAR) AS j_l_suppkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
)
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A self-join on both parts of a key that isn't unique: bags multiply."""
    plan = Plan()
    left, right = (scan(plan, sf_dir, "lineitem", "l_orderkey", "l_linenumber", x) for x in ("l_partkey", "l_suppkey"))
    at = plan.add(Join((("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")), "j"), left, right)
    return relation(plan, at, spark=spark)


@_query(
    "join_chain",
    "SELECT c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(n_nationkey AS VARCHAR) AS n_n_nationkey, n_name AS n_n_name, CAST(n_regionkey AS VARCHAR) AS n_n_regionkey, CAST(r_regionkey AS VARCHAR) AS r_r_regionkey, r_name AS r_r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    first = plan.add(Join((("c_nationkey", "n_nationkey"),), "n"), scan(plan, sf_dir, "customer", "c_name", "c_nationkey"), scan(plan, sf_dir, "nation"))
    at = plan.add(Join((("n_n_regionkey", "r_regionkey"),), "r"), first, scan(plan, sf_dir, "region"))
    return relation(plan, at, spark=spark)


@_query("join_natural_identity", "SELECT s_name, CAST(s_suppkey AS VARCHAR) AS join_0_s_suppkey FROM supplier")
def join_natural_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    at = plan.add(Join((), "join_0", "NaturalJoin"), scan(plan, sf_dir, "supplier", "s_name"), scan(plan, sf_dir, "supplier", "s_suppkey"))
    return relation(plan, at, spark=spark)


@_query("join_self_conditional", "SELECT a.s_name AS s_name, CAST(a.s_nationkey AS VARCHAR) AS s_nationkey, b.s_name AS j_s_name, CAST(b.s_nationkey AS VARCHAR) AS j_s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def join_self_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    one = scan(plan, sf_dir, "supplier", "s_name", "s_nationkey")
    return relation(plan, plan.add(Join((("s_nationkey", "s_nationkey"),), "j"), one, one), spark=spark)


@_query(
    "join_empty_keys",
    "SELECT a.k AS k, a.n_name AS n_name, b.k AS j_k, b.r_name AS j_r_name FROM (SELECT n_name, CASE WHEN n_regionkey = 0 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS k FROM nation) a JOIN (SELECT r_name, CASE WHEN r_regionkey = 0 THEN '' ELSE CAST(r_regionkey AS VARCHAR) END AS k FROM region) b ON a.k = b.k",
)
def join_empty_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty text is a value and matches itself."""
    plan, names = Plan(), []
    for table, key, name in (("nation", "n_regionkey", "n_name"), ("region", "r_regionkey", "r_name")):
        names.append(f"{table}_{uuid.uuid4().hex}")
        k = F.when(F.col(key) == 0, "").otherwise(F.col(key).cast("string"))
        spark.read.parquet(f"{sf_dir}/{table}.parquet").select(k.alias("k"), name).createOrReplaceTempView(names[-1])
    at = plan.add(Join((("k", "k"),), "j"), *[plan.add(Source(n, "Table", "Rows")) for n in names])
    return relation(plan, at, spark=spark)


@_query(
    "fragment_fanout",
    f"SELECT '<{EX}s/' || s_suppkey || '> <{LABEL}> \"' || s_name || '\" .' AS line FROM supplier UNION ALL SELECT '<{EX}s/' || s_suppkey || '> <{EX}nation> <{EX}n/' || s_nationkey || '> .' FROM supplier",
)
def fragment_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    at = plan.add(Fragment(), scan(plan, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey"))
    subject = iri(tpl(EX + "s/{s_suppkey}", "s_suppkey"))
    emit(plan, at, {"s": subject, "o": lit(ref("s_name"))}, f"?s <{LABEL}> ?o .")
    emit(plan, at, {"s": subject, "o": iri(tpl(EX + "n/{s_nationkey}", "s_nationkey"))}, f"?s <{EX}nation> ?o .")
    return statements(plan, spark=spark)


# --- serialisation ---------------------------------------------------------------


@_query("serialize_ntriples", f"SELECT '<{EX}c/' || c_custkey || '> <{TYPE}> <{EX}Customer> .' AS line FROM customer UNION ALL SELECT '<{EX}c/' || c_custkey || '> <{LABEL}> \"' || c_name || '\" .' FROM customer")
def serialize_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    at = plan.add(Extend({"s": iri(tpl(EX + "c/{c_custkey}", "c_custkey")), "p": iri(const(LABEL)), "o": lit(ref("c_name"))}), scan(plan, sf_dir, "customer"))
    plan.add(Target(), plan.add(Serialize(f"?s <{TYPE}> <{EX}Customer> .\n?s ?p ?o .", "NTriples"), at))
    return statements(plan, spark=spark)


@_query("serialize_nquads", f"SELECT '<{EX}o/' || o_orderkey || '>' AS subject, '<{EX}status>' AS predicate, '\"' || o_orderstatus || '\"' AS object, '<{EX}g/' || o_orderpriority_enc || '>' AS graph FROM (SELECT *, url_encode(o_orderpriority) AS o_orderpriority_enc FROM orders)")
def serialize_nquads(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    functions = {"s": iri(tpl(EX + "o/{o_orderkey}", "o_orderkey")), "o": lit(ref("o_orderstatus")), "g": iri(tpl(EX + "g/{o_orderpriority}", "o_orderpriority"))}
    emit(plan, scan(plan, sf_dir, "orders"), functions, f"?s <{EX}status> ?o ?g .")
    return quads(plan, spark=spark)


@_query("serialize_typed_literal", f"SELECT '<{EX}e/' || event_id || '> <{EX}user> \"' || user_id || '\"^^<{XSD}integer> .' AS line FROM events UNION ALL SELECT '<{EX}e/' || event_id || '> <{EX}at> \"' || ts || '\"^^<{XSD}dateTime> .' FROM events")
def serialize_typed_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One datatype from the template, one from the function."""
    plan = Plan()
    functions = {"s": iri(tpl(EX + "e/{event_id}", "event_id")), "o": lit(ref("user_id")), "t": lit(ref("ts"), XSD + "dateTime")}
    emit(plan, scan(plan, sf_dir, "events"), functions, f"?s <{EX}user> ?o^^<{XSD}integer> .\n?s <{EX}at> ?t .")
    return statements(plan, Options(typed_literals=True), spark)


@_query("serialize_language", f"SELECT '<{EX}d/' || doc_id || '> <{EX}source> \"' || source || '\"@' || lang || ' .' AS line FROM documents")
def serialize_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    emit(plan, scan(plan, sf_dir, "documents"), {"s": iri(tpl(EX + "d/{doc_id}", "doc_id")), "o": lit(ref("source"), language=ref("lang"))}, f"?s <{EX}source> ?o .")
    return statements(plan, Options(typed_literals=True), spark)


@_query("serialize_escaping", rf"""SELECT '<{EX}d/' || doc_id || '> <{EX}text> "' || replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r') || '" .' AS line FROM documents""")
def serialize_escaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    emit(plan, scan(plan, sf_dir, "documents"), {"s": iri(tpl(EX + "d/{doc_id}", "doc_id")), "o": lit(ref("text"))}, f"?s <{EX}text> ?o .")
    return statements(plan, spark=spark)


@_query("null_suppression", f"SELECT '<{EX}o/' || o_orderkey || '> <{EX}open> \"' || o_custkey || '\" .' AS line FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT '<{EX}o/' || o_orderkey || '> <{TYPE}> <{EX}Order> .' FROM orders")
def null_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null term leaves out its statement and no other."""
    name = f"orders_{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("open")).createOrReplaceTempView(name)
    plan = Plan()
    emit(plan, plan.add(Source(name, "Table", "Rows")), {"s": iri(tpl(EX + "o/{o_orderkey}", "o_orderkey")), "o": lit(ref("open"))}, f"?s <{EX}open> ?o .\n?s <{TYPE}> <{EX}Order> .")
    return statements(plan, spark=spark)


# --- sinks -------------------------------------------------------------------------


def _segments(sf_dir: str) -> Plan:
    """Two statements a customer, one of which is the same for all of a segment."""
    plan = Plan()
    functions = {"g": iri(tpl(EX + "seg/{c_mktsegment}", "c_mktsegment")), "n": iri(tpl(EX + "n/{c_nationkey}", "c_nationkey"))}
    emit(plan, scan(plan, sf_dir, "customer"), functions, f"?g <{TYPE}> <{EX}Segment> .\n?g <{EX}in> ?n .")
    return plan


_SEGMENTS = f"SELECT '<{EX}seg/' || url_encode(c_mktsegment) || '> <{TYPE}> <{EX}Segment> .' AS a, '<{EX}seg/' || url_encode(c_mktsegment) || '> <{EX}in> <{EX}n/' || c_nationkey || '> .' AS b FROM customer"


@_query("sink_union", f"SELECT unnest([a, b]) AS line FROM ({_SEGMENTS})")
def sink_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(_segments(sf_dir), spark=spark)


@_query("sink_dedup_statement", f"SELECT DISTINCT unnest([a, b]) AS line FROM ({_SEGMENTS})")
def sink_dedup_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(_segments(sf_dir), Options(deduplicate=True), spark)


@_query("sink_dedup_record", f"SELECT unnest([a, b]) AS line FROM (SELECT DISTINCT a, b FROM ({_SEGMENTS}))")
def sink_dedup_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(_segments(sf_dir), Options(deduplicate=True, dedup_scope="record"), spark)


# --- whole mappings ------------------------------------------------------------------

_RML = """@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix rml: <http://semweb.mmlab.be/ns/rml#> .
@prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix ex: <http://ex.org/> .
@base <http://ex.org/base/> .
<#Nation> rml:logicalSource [ rml:source "%(dir)s/nation.parquet"; rml:referenceFormulation ql:Parquet ];
  rr:subjectMap [ rr:template "http://ex.org/n/{n_nationkey}"; rr:class ex:Nation; rr:graph ex:places ];
  rr:predicateObjectMap [ rr:predicate ex:name; rr:objectMap [ rml:reference "n_name" ] ];
  rr:predicateObjectMap [ rr:predicate ex:self; rr:objectMap [ rr:parentTriplesMap <#Nation> ] ];
  rr:predicateObjectMap [ rr:predicate ex:inRegion; rr:objectMap [
    rr:parentTriplesMap <#Region>; rr:joinCondition [ rr:child "n_regionkey"; rr:parent "r_regionkey" ] ] ] .
<#Region> rml:logicalSource [ rml:source "%(dir)s/region.parquet"; rml:referenceFormulation ql:Parquet ];
  rr:subjectMap [ rr:template "http://ex.org/r/{r_regionkey}" ];
  rr:predicateObjectMap [ rr:predicate ex:name; rr:objectMap [ rml:reference "r_name" ] ] .
"""


@_query(
    "rml_end_to_end",
    f"""SELECT '<{EX}n/' || n_nationkey || '> <{TYPE}> <{EX}Nation> <{EX}places> .' AS line FROM nation
UNION ALL SELECT '<{EX}n/' || n_nationkey || '> <{EX}name> "' || n_name || '" <{EX}places> .' FROM nation
UNION ALL SELECT '<{EX}n/' || n_nationkey || '> <{EX}self> <{EX}n/' || n_nationkey || '> <{EX}places> .' FROM nation
UNION ALL SELECT '<{EX}n/' || n_nationkey || '> <{EX}inRegion> <{EX}r/' || r_regionkey || '> <{EX}places> .' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT '<{EX}r/' || r_regionkey || '> <{EX}name> "' || r_name || '" .' FROM region""",
)
def rml_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(translate(_RML % {"dir": sf_dir}), Options(deduplicate=True), spark)


_SHEXML = """PREFIX ex: <http://ex.org/>
PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>
SOURCE suppliers <%(dir)s/supplier.parquet>
ITERATOR rows <parquet> { FIELD id <s_suppkey> FIELD name <s_name> FIELD nation <s_nationkey> }
EXPRESSION suppliers <suppliers.rows>
ex:Supplier ex:[suppliers.id] { a ex:Supplier ; ex:name [suppliers.name] @en ; ex:code [suppliers.id] xsd:integer ; ex:in @ex:Nation ; }
ex:places [[ ex:Nation ex:[suppliers.nation] { ex:kind "nation" ; } ]]
"""


@_query(
    "shexml_end_to_end",
    f"""SELECT unnest(['<{EX}' || s_suppkey || '> <{TYPE}> <{EX}Supplier> .', '<{EX}' || s_suppkey || '> <{EX}name> "' || s_name || '"@en .', '<{EX}' || s_suppkey || '> <{EX}code> "' || s_suppkey || '"^^<{XSD}integer> .', '<{EX}' || s_suppkey || '> <{EX}in> <{EX}' || s_nationkey || '> .', '<{EX}' || s_nationkey || '> <{EX}kind> "nation" <{EX}places> .']) AS line FROM supplier""",
)
def shexml_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(translate(_SHEXML % {"dir": sf_dir}, "shexml"), Options(typed_literals=True), spark)


def order_graph(sf_dir: str) -> Plan:
    """Orders, their customers and both kinds' labels in named graphs; classes are stated in every branch."""
    plan = Plan()
    orders = plan.add(Fragment(), scan(plan, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority"))
    customers = plan.add(Fragment(), scan(plan, sf_dir, "customer", "c_custkey", "c_name"))
    joined = plan.add(Join((("o_custkey", "c_custkey"),), "join_0"), orders, customers)
    order, graph = iri(tpl(EX + "order/{o_orderkey}", "o_orderkey")), iri(const(EX + "g/orders"))
    typed = f"?s <{TYPE}> <{EX}Order> ?g .\n"
    emit(plan, joined, {"s": order, "o": iri(tpl(EX + "customer/{join_0_c_custkey}", "join_0_c_custkey")), "g": graph, "h": iri(const(EX + "g/placed"))}, f"{typed}?s <{EX}placedBy> ?o ?g .\n?s <{EX}placedBy> ?o ?h .")
    emit(plan, orders, {"s": order, "o": lit(ref("o_orderpriority")), "g": graph}, f"{typed}?s <{EX}priority> ?o ?g .")
    emit(plan, customers, {"s": iri(tpl(EX + "customer/{c_custkey}", "c_custkey")), "o": lit(ref("c_name")), "g": iri(const(EX + "g/customers"))}, f"?s <{TYPE}> <{EX}Customer> ?g .\n?s <{LABEL}> ?o ?g .")
    return plan


_GRAPH_SQL = f"""SELECT unnest(['<{EX}order/' || o_orderkey || '> <{TYPE}> <{EX}Order> <{EX}g/orders> .', '<{EX}order/' || o_orderkey || '> <{EX}placedBy> <{EX}customer/' || c_custkey || '> <{EX}g/orders> .', '<{EX}order/' || o_orderkey || '> <{EX}placedBy> <{EX}customer/' || c_custkey || '> <{EX}g/placed> .']) AS line FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT unnest(['<{EX}order/' || o_orderkey || '> <{TYPE}> <{EX}Order> <{EX}g/orders> .', '<{EX}order/' || o_orderkey || '> <{EX}priority> "' || o_orderpriority || '" <{EX}g/orders> .']) FROM orders
UNION ALL SELECT unnest(['<{EX}customer/' || c_custkey || '> <{TYPE}> <{EX}Customer> <{EX}g/customers> .', '<{EX}customer/' || c_custkey || '> <{LABEL}> "' || c_name || '" <{EX}g/customers> .']) FROM customer"""


@_query("order_graph_all", _GRAPH_SQL)
def order_graph_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(order_graph(sf_dir), spark=spark)


@_query("flagship_order_graph", f"SELECT DISTINCT line FROM ({_GRAPH_SQL})")
def flagship_order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(order_graph(sf_dir), Options(deduplicate=True), spark)


# --- dialect, paths and nested sources ---------------------------------------------


@_query("source_csv_dialect", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(coalesce(text, ''), chr(13), '') AS text FROM documents")
def source_csv_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas, blanks, backslashes and line feeds within fields come back as they were."""
    path, plan = scratch(spark), Plan()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")).alias("text")).write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return relation(plan, plan.add(Source(path)), spark=spark)


def _text_file(spark: SparkSession, *lines: str) -> str:
    """A file of these lines, in a new folder of its own."""
    path = scratch(spark)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@_query("source_csv_header_only", "SELECT 0 AS rows_read, 'a,b' AS names")
def source_csv_header_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    got = relation(plan, plan.add(Source(_text_file(spark, "a,b"))), spark=spark)
    return got.agg(F.count("*").cast("int").alias("rows_read"), F.lit(",".join(got.columns)).alias("names"))


@_query("source_path_below_working_dir", "SELECT r_name FROM region")
def source_path_below_working_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan()
    at = plan.add(Project(("r_name",)), plan.add(Source("region.parquet", "File", "Parquet")))
    return relation(plan, at, Options(working_dir_hint=sf_dir), spark)


@_query("source_json_iterator", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def source_json_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations nested in regions, in one document."""
    path, plan = scratch(spark), Plan()
    nested = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    nested.agg(F.struct(F.collect_list(F.struct("nations")).alias("regions")).alias("world")).write.json(path)
    at = plan.add(Source(path, "File", "JSONPath", iterator="$.world.regions[*].nations[*]"))
    return relation(plan, plan.add(Project(("n_nationkey", "n_name")), at), spark=spark)


@_query("source_xml_iterator", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def source_xml_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, plan = scratch(spark), Plan()
    spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name").write.format("xml").options(rootTag="suppliers", rowTag="supplier").save(path)
    at = plan.add(Source(path, "File", "XMLPath", iterator="/suppliers/supplier"))
    return relation(plan, plan.add(Project(("s_suppkey", "s_name")), at), spark=spark)


# --- targets, options and the command line -------------------------------------------


def _region_names(sf_dir: str, target: Target | None = None) -> Plan:
    plan = Plan()
    made = plan.add(Extend({"s": iri(tpl(EX + "{r_regionkey}", "r_regionkey")), "o": lit(ref("r_name"))}), scan(plan, sf_dir, "region"))
    plan.add(target or Target(), plan.add(Serialize(f"?s <{LABEL}> ?o ."), made))
    return plan


_REGION_LINES = f"SELECT '<{EX}' || r_regionkey || '> <{LABEL}> \"' || r_name || '\" .' AS line FROM region"


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "line string")


@_query("target_stdout", _REGION_LINES)
def target_stdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    with contextlib.redirect_stdout(io.StringIO()) as said:
        run(_region_names(sf_dir), spark=spark)
    return _lines(spark, said.getvalue().splitlines())


@_query("target_file", _REGION_LINES)
def target_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's own file target, by a URI."""
    path = f"{scratch(spark)}/out.nt"
    run(_region_names(sf_dir, Target("File", path)), spark=spark)
    return spark.read.text(path).withColumnRenamed("value", "line")


@_query("target_forced_file", _REGION_LINES)
def target_forced_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/forced.nt"
    run(_region_names(sf_dir), Options(force_to_file=path), spark)
    return spark.read.text(path).withColumnRenamed("value", "line")


@_query("target_parts", _REGION_LINES)
def target_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/"
    run(_region_names(sf_dir), Options(force_to_file=path), spark)
    return spark.read.text(path).withColumnRenamed("value", "line")


@_query("target_precedence", "SELECT 'forced stdout, forced file, plan' AS asked, 'stdout' AS wrote UNION ALL SELECT 'forced file, plan', 'forced' UNION ALL SELECT 'plan', 'plan'")
def target_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for asked in ("forced stdout, forced file, plan", "forced file, plan", "plan"):
        base = scratch(spark)
        options = Options(force_to_std_out="stdout" in asked, force_to_file=f"{base}/forced.nt" if "forced file" in asked else None)
        with contextlib.redirect_stdout(io.StringIO()) as said:
            run(_region_names(sf_dir, Target("File", f"{base}/plan.nt")), options, spark)
        found = ["stdout"] * bool(said.getvalue())
        for name in ("forced", "plan"):
            with contextlib.suppress(Exception):
                found += [name] * bool(spark.read.text(f"{base}/{name}.nt").count())
        rows.append((asked, ",".join(found)))
    return spark.createDataFrame(rows, "asked string, wrote string")


@_query("run_json_plan", _REGION_LINES)
def run_json_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan document as text, run as a whole; the message buffer's capacity changes nothing."""
    operator = lambda kind, **config: {"id": kind, "operator": {"type": kind, "config": config}}
    source = operator("SourceOp", path="region.parquet", source_type="File", root_iterator={"reference": "", "reference_formulation": "Parquet"})
    extend = operator("ExtendOp", **{"?s": iri(tpl(EX + "{r_regionkey}", "r_regionkey")), "?o": lit(ref("r_name"))})
    nodes = [source, extend, operator("SerializerOp", template=f"?s <{LABEL}> ?o .", format="NTriples"), operator("TargetOp", target_type="StdOut")]
    document = json.dumps({"nodes": nodes, "edges": [[0, 1], [1, 2], [2, 3]]})
    with contextlib.redirect_stdout(io.StringIO()) as said:
        run(document, Options(working_dir_hint=sf_dir, message_buffer_capacity=1), spark)
    return _lines(spark, said.getvalue().splitlines())


@_query("cli_exit_codes", "SELECT * FROM (VALUES ('quiet', 0, 5), ('deduplicated', 0, 5), ('no mapping', 1, 0), ('bad plan', 1, 0)) t(call, code, lines)")
def cli_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cli import main

    operator = lambda kind, **config: {"operator": {"type": kind, "config": config}}
    source = operator("SourceOp", path=f"{sf_dir}/region.parquet", root_iterator={"reference_formulation": "Parquet"})
    good = {"nodes": [source, operator("ExtendOp", **{"?s": iri(const(EX + "all")), "?o": lit(ref("r_name"))}), operator("SerializerOp", template=f"?s <{LABEL}> ?o ."), operator("TargetOp")], "edges": [[0, 1], [1, 2], [2, 3]]}
    rows = []
    with tempfile.TemporaryDirectory() as folder:  # the mapping is a local file of the caller
        for name, document in (("good", good), ("bad", {"nodes": [operator("NoSuchOp")]})):
            with open(f"{folder}/{name}.json", "w", encoding="utf-8") as f:
                json.dump(document, f)
        calls = {"quiet": ["-m", f"{folder}/good.json", "-q"], "deduplicated": ["-m", f"{folder}/good.json", "-d", "--force-std-out"], "no mapping": ["-m", f"{folder}/none.json"], "bad plan": ["-m", f"{folder}/bad.json"]}
        for call, args in calls.items():
            with contextlib.redirect_stdout(io.StringIO()) as said, contextlib.redirect_stderr(io.StringIO()):
                code = main(args)
            rows.append((call, code, len(said.getvalue().splitlines())))
    return spark.createDataFrame(rows, "call string, code int, lines int")


# --- what is refused ------------------------------------------------------------------


def _join_plan(sf_dir: str, other: str, join: Join) -> tuple[Plan, int]:
    plan = Plan()
    return plan, plan.add(join, scan(plan, sf_dir, "nation"), scan(plan, sf_dir, other))


def _relation_of(made: tuple[Plan, int], spark: SparkSession) -> DataFrame:
    return relation(made[0], made[1], spark=spark)


def _fan_in(sf_dir: str) -> Plan:
    plan = Plan()
    both = [plan.add(Extend({"o": lit(ref(n))}), scan(plan, sf_dir, t)) for t, n in (("region", "r_name"), ("nation", "n_name"))]
    plan.add(Target(), plan.add(Serialize(f"?o <{LABEL}> ?o ."), *both))
    return plan


def _in_turtle(sf_dir: str) -> Plan:
    plan = _region_names(sf_dir)
    plan.nodes = [Serialize(n.template, "Turtle") if isinstance(n, Serialize) else n for n in plan.nodes]
    return plan


def _read_ragged(spark: SparkSession) -> None:
    plan = Plan()
    relation(plan, plan.add(Source(_text_file(spark, "a,b", "1,2", "3"))), spark=spark).collect()


_PAIR = (("n_regionkey", "r_regionkey"),)
_REFUSED: dict[str, tuple[str, Callable[[SparkSession, str], object]]] = {
    "unknown_attribute": ("error", lambda spark, d: _relation_of((p := Plan(), scan(p, d, "region", "nope")), spark)),
    "unknown_reference": ("error", lambda spark, d: _extended(spark, d, "region", {"v": ref("nope")})),
    "ragged_record": ("failure", lambda spark, d: _read_ragged(spark)),
    "missing_file": ("error", lambda spark, d: _relation_of((p := Plan(), p.add(Source(f"{d}/none.csv"))), spark)),
    "join_predicate": ("error", lambda spark, d: _relation_of(_join_plan(d, "region", Join(_PAIR, "x", "InnerJoin", "GreaterThan")), spark)),
    "join_type": ("error", lambda spark, d: _relation_of(_join_plan(d, "region", Join(_PAIR, "x", "LeftJoin")), spark)),
    "join_without_pairs": ("error", lambda spark, d: _relation_of(_join_plan(d, "region", Join((), "x")), spark)),
    "natural_join_of_two_sources": ("error", lambda spark, d: _relation_of(_join_plan(d, "region", Join((), "x", "NaturalJoin")), spark)),
    "output_format": ("error", lambda spark, d: statements(_in_turtle(d), spark=spark)),
    "serializer_fan_in": ("error", lambda spark, d: statements(_fan_in(d), spark=spark)),
    "target_without_path": ("error", lambda spark, d: run(_region_names(d, Target("File")), spark=spark)),
    "target_kind": ("error", lambda spark, d: run(_region_names(d, Target("Kafka")), spark=spark)),
    "json_iterator": ("error", lambda spark, d: _relation_of((p := Plan(), p.add(Source(f"{d}/region.parquet", "File", "JSONPath", iterator="$..x[?(@.y)]"))), spark)),
}


def _refusal(attempt: Callable[[SparkSession, str], object]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        try:
            attempt(spark, sf_dir)
            outcome = "accepted"
        except MappingError:
            outcome = "error"
        except (PySparkException, Py4JJavaError):  # found while rows are read
            outcome = "failure"
        return spark.createDataFrame([(outcome,)], "outcome string")

    return query


for _name, (_outcome, _attempt) in _REFUSED.items():
    _query(f"refuse_{_name}", f"SELECT '{_outcome}' AS outcome")(_refusal(_attempt))
