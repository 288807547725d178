"""The registered queries over the driver's tables, each with its SQL.

Every one is SPARQL over the virtual graph of the tables (sources.relational) or an operator over quads made of
them; results are cast to the types of the SQL on the same Parquet files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..engine import GraphStore, Queries
from ..sources.relational import RelationalGraph

XSD_PREFIX = "PREFIX c: <urn:c:> PREFIX t: <urn:t:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX math: <http://www.w3.org/2005/xpath-functions/math#>\n"


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str = ""


CATALOG: dict[str, Registered] = {}


def select(name: str, text: str, sql: str, decimals: dict[str, int] | None = None, **types: str):
    """Registers a SELECT: types cast the columns; decimals round doubles to decimals of so many places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Queries(RelationalGraph(spark, sf_dir)).sparql(XSD_PREFIX + text, types | dict.fromkeys(decimals or {}, "double"))
        return df.withColumns({c: F.round(F.col(c), n).cast(f"decimal(28,{n})") for c, n in (decimals or {}).items()})

    CATALOG[name] = Registered(run, sql)


def operator(name: str, sql: str = ""):
    def register(f):
        CATALOG[name] = Registered(f, sql)
        return f

    return register


def _d(x: str, n: int = 2) -> str:
    return f"CAST(round({x}, {n}) AS DECIMAL(28,{n}))"


# joins and aggregates

select(
    "jn01_bgp_customers_per_region",
    "SELECT ?rname (COUNT(*) AS ?n) { ?c c:c_nationkey ?na . ?na c:n_regionkey ?r . ?r c:r_name ?rname } GROUP BY ?rname",
    "SELECT r_name AS rname, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    n="long",
)
select(
    "agg01_pricing_summary",
    """SELECT ?flag ?status (SUM(?q) AS ?sum_qty) (SUM(?p) AS ?sum_base) (SUM(?p * (1 - ?d)) AS ?sum_disc) (AVG(?q) AS ?avg_qty) (COUNT(*) AS ?n)
    { ?l c:l_returnflag ?flag ; c:l_linestatus ?status ; c:l_quantity ?q ; c:l_extendedprice ?p ; c:l_discount ?d } GROUP BY ?flag ?status""",
    f"""SELECT l_returnflag AS flag, l_linestatus AS status, {_d('sum(l_quantity)')} AS sum_qty, {_d('sum(l_extendedprice)')} AS sum_base,
    {_d('sum(l_extendedprice * (1 - l_discount))')} AS sum_disc, {_d('avg(l_quantity)')} AS avg_qty, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    {"sum_qty": 2, "sum_base": 2, "sum_disc": 2, "avg_qty": 2}, n="long",
)
select(
    "agg02_revenue_per_nation",
    """SELECT ?nname (SUM(?p * (1 - ?d)) AS ?revenue) { ?l c:l_orderkey ?o ; c:l_extendedprice ?p ; c:l_discount ?d . ?o c:o_custkey ?c .
    ?c c:c_nationkey ?na . ?na c:n_name ?nname } GROUP BY ?nname""",
    f"""SELECT n_name AS nname, {_d('sum(l_extendedprice * (1 - l_discount))')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    {"revenue": 2},
)
select(
    "jn06_local_supplier_volume",
    """SELECT ?nname (COUNT(*) AS ?n) { ?l c:l_orderkey ?o ; c:l_suppkey ?s . ?o c:o_custkey ?c . ?c c:c_nationkey ?na . ?s c:s_nationkey ?na .
    ?na c:n_name ?nname } GROUP BY ?nname""",
    """SELECT n_name AS nname, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey AND s_nationkey = n_nationkey GROUP BY 1""",
    n="long",
)
select(
    "agg10_having_inline",
    "SELECT ?na (COUNT(?c) AS ?n) { ?c c:c_nationkey ?x . ?x c:n_name ?na } GROUP BY ?na HAVING (COUNT(?c) > 50)",
    "SELECT n_name AS na, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 50",
    n="long",
)
select(
    "agg11_having_alias",
    "SELECT ?s (AVG(?b) AS ?m) { ?c c:c_mktsegment ?s ; c:c_acctbal ?b } GROUP BY ?s HAVING (?m > 0)",
    f"SELECT c_mktsegment AS s, {_d('avg(c_acctbal)', 4)} AS m FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 0",
    {"m": 4},
)
select(
    "agg03_count_distinct",
    "SELECT ?flag (COUNT(DISTINCT ?s) AS ?n) { ?l c:l_returnflag ?flag ; c:l_suppkey ?s } GROUP BY ?flag",
    "SELECT l_returnflag AS flag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1",
    n="long",
)
select(
    "agg06_min_max_sample",
    "SELECT ?seg (MIN(?b) AS ?low) (MAX(?b) AS ?high) (MIN(?name) AS ?first) (SAMPLE(?name) AS ?any) { ?c c:c_mktsegment ?seg ; c:c_acctbal ?b ; c:c_name ?name } GROUP BY ?seg",
    f"SELECT c_mktsegment AS seg, {_d('min(c_acctbal)')} AS low, {_d('max(c_acctbal)')} AS high, min(c_name) AS first, min(c_name) AS any FROM customer GROUP BY 1",
    {"low": 2, "high": 2},
)
select(
    "agg07_group_concat",
    'SELECT ?rname (GROUP_CONCAT(?n; SEPARATOR="|") AS ?nations) { ?x c:n_regionkey ?r ; c:n_name ?n . ?r c:r_name ?rname } GROUP BY ?rname',
    "SELECT r_name AS rname, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
select(
    "agg12_over_expression",
    "SELECT (SUM(?q * 2 + 1) AS ?s) (COUNT(*) AS ?n) { ?l c:l_quantity ?q }",
    f"SELECT {_d('sum(l_quantity * 2 + 1)')} AS s, count(*) AS n FROM lineitem",
    {"s": 2}, n="long",
)
select(
    "agg13_over_union",
    "SELECT ?n (COUNT(*) AS ?k) { { ?c c:c_nationkey ?x } UNION { ?s c:s_nationkey ?x } ?x c:n_name ?n } GROUP BY ?n",
    "SELECT n_name AS n, count(*) AS k FROM (SELECT c_nationkey AS x FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON x = n_nationkey GROUP BY 1",
    k="long",
)

# filters and expressions

select(
    "flt02_numeric_range",
    "SELECT ?o ?p { ?o c:o_totalprice ?p FILTER(?p >= 100000 && ?p < 101000) }",
    f"SELECT 'urn:t:orders:' || o_orderkey AS o, {_d('o_totalprice')} AS p FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 101000",
    {"p": 2},
)
select(
    "flt03_boolean_logic",
    'SELECT (COUNT(*) AS ?n) { ?c c:c_mktsegment ?s ; c:c_acctbal ?b FILTER((?s = "BUILDING" || ?b < 0) && !(?b > 5000)) }',
    "SELECT count(*) AS n FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT (c_acctbal > 5000)",
    n="long",
)
select(
    "flt06_in",
    'SELECT ?s (COUNT(*) AS ?n) { ?o c:o_orderstatus ?s FILTER(?s IN ("F", "P", "none")) } GROUP BY ?s',
    "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P', 'none') GROUP BY 1",
    n="long",
)
select(
    "flt07_regex",
    'SELECT ?n { ?x c:n_name ?n FILTER(REGEX(?n, "^nation_1[0-4]$", "i")) }',
    "SELECT n_name AS n FROM nation WHERE regexp_matches(n_name, '^nation_1[0-4]$', 'i')",
)
select(
    "flt09_exists",
    "SELECT ?name { ?c c:c_name ?name FILTER EXISTS { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 400000) } }",
    "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
select(
    "flt09_not_exists",
    "SELECT (COUNT(*) AS ?n) { ?c c:c_name ?name FILTER NOT EXISTS { ?o c:o_custkey ?c } }",
    "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    n="long",
)
select(
    "str_functions",
    """SELECT ?n (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) (STRLEN(?n) AS ?k) (CONCAT(?n, "-", ?n) AS ?cc) (CONTAINS(?n, "AN") AS ?has) (STRSTARTS(?n, "A") AS ?st)
    (STRENDS(?n, "A") AS ?en) (SUBSTR(?n, 2, 3) AS ?sub) (REPLACE(?n, "A", "x") AS ?rep) (STRBEFORE(?n, "A") AS ?bef) (STRAFTER(?n, "A") AS ?aft) { ?x c:n_name ?n }""",
    """SELECT n_name AS n, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS k, n_name || '-' || n_name AS cc, contains(n_name, 'AN') AS has,
    starts_with(n_name, 'A') AS st, ends_with(n_name, 'A') AS en, substr(n_name, 2, 3) AS sub, replace(n_name, 'A', 'x') AS rep,
    CASE WHEN contains(n_name, 'A') THEN substr(n_name, 1, instr(n_name, 'A') - 1) ELSE '' END AS bef,
    CASE WHEN contains(n_name, 'A') THEN substr(n_name, instr(n_name, 'A') + 1) ELSE '' END AS aft FROM nation""",
    k="long", has="boolean", st="boolean", en="boolean",
)
select(
    "num_functions",
    """SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?up) (FLOOR(?b) AS ?down) (ROUND(?b) AS ?r) (-?b AS ?neg) (?b / 4 AS ?quarter) (math:sqrt(ABS(?b)) AS ?root)
    { ?c c:c_acctbal ?b }""",
    f"""SELECT 'urn:t:customer:' || c_custkey AS c, {_d('abs(c_acctbal)')} AS a, {_d('ceil(c_acctbal)')} AS up, {_d('floor(c_acctbal)')} AS down,
    {_d('floor(c_acctbal + 0.5)')} AS r, {_d('-c_acctbal')} AS neg, {_d('c_acctbal / 4', 4)} AS quarter, {_d('sqrt(abs(c_acctbal))', 4)} AS root FROM customer""",
    {"a": 2, "up": 2, "down": 2, "r": 2, "neg": 2, "quarter": 4, "root": 4},
)
select(
    "cnd01_if_coalesce",
    'SELECT ?band (COUNT(*) AS ?n) { ?c c:c_acctbal ?b BIND(IF(?b < 0, "debt", IF(?b < 5000, "low", "high")) AS ?band) } GROUP BY ?band',
    "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY 1",
    n="long",
)
select(
    "prj04_bind_join_key",
    "SELECT ?name { ?n c:n_name ?x . BIND(IRI(CONCAT(STR(t:), \"supplier:1\")) AS ?s) ?s c:s_name ?name ; c:s_nationkey ?n }",
    "SELECT s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1",
)
select(
    "str03_datatype_lang",
    "SELECT ?d ?e ?l (COUNT(*) AS ?n) { ?c c:c_acctbal ?b ; c:c_custkey ?k ; c:c_name ?name } GROUP BY (DATATYPE(?b) AS ?d) (DATATYPE(?k) AS ?e) (LANG(?name) AS ?l)",
    "SELECT 'http://www.w3.org/2001/XMLSchema#double' AS d, 'http://www.w3.org/2001/XMLSchema#integer' AS e, '' AS l, count(*) AS n FROM customer",
    n="long",
)

# optional, union, minus, values

select(
    "jn05_optional",
    "SELECT ?name (COUNT(?o) AS ?n) { ?c c:c_name ?name OPTIONAL { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 300000) } } GROUP BY ?name",
    "SELECT c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1",
    n="long",
)
select(
    "jn06_chained_optional",
    "SELECT ?n ?s ?c { ?x c:n_name ?n OPTIONAL { ?a c:s_nationkey ?x ; c:s_name ?s } OPTIONAL { ?b c:c_nationkey ?x ; c:c_name ?c ; c:c_acctbal ?k FILTER(?k > 9900) } }",
    """SELECT n_name AS n, s_name AS s, c_name AS c FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey
    LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900""",
)
select(
    "jn08_values",
    'SELECT ?n ?r { VALUES (?n ?r) { ("NATION_3" UNDEF) ("NATION_7" "ASIA") (UNDEF "AMERICA") } ?x c:n_name ?n ; c:n_regionkey ?y . ?y c:r_name ?r }',
    """SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey
    JOIN (VALUES ('NATION_3', NULL), ('NATION_7', 'ASIA'), (NULL, 'AMERICA')) v(a, b) ON (a IS NULL OR a = n_name) AND (b IS NULL OR b = r_name)""",
)
select(
    "jn10_minus",
    'SELECT ?name { ?c c:c_name ?name ; c:c_nationkey ?n MINUS { ?n c:n_regionkey ?r . ?r c:r_name "ASIA" } MINUS { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 450000) } }',
    """SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name <> 'ASIA' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
)
select(
    "set01_union",
    "SELECT ?who ?b { { ?c c:c_name ?who ; c:c_acctbal ?b FILTER(?b > 9800) } UNION { ?s c:s_name ?who ; c:s_acctbal ?b FILTER(?b > 9000) } }",
    f"SELECT c_name AS who, {_d('c_acctbal')} AS b FROM customer WHERE c_acctbal > 9800 UNION ALL SELECT s_name, {_d('s_acctbal')} FROM supplier WHERE s_acctbal > 9000",
    {"b": 2},
)
select(
    "jn04_disconnected",
    "SELECT ?a ?b { ?x c:r_name ?a . ?y c:r_name ?b FILTER(?a < ?b) }",
    "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_name < b.r_name",
)
select(
    "sub_select",
    "SELECT ?name ?n { { SELECT ?c (COUNT(*) AS ?n) { ?o c:o_custkey ?c } GROUP BY ?c } ?c c:c_name ?name FILTER(?n > 15) }",
    "SELECT c_name AS name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey WHERE n > 15",
    n="long",
)

# order, distinct, limits

select(
    "ord01_top_orders",
    "SELECT ?o ?p { ?o c:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 20 OFFSET 5",
    f"SELECT 'urn:t:orders:' || o_orderkey AS o, {_d('o_totalprice')} AS p FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, 'urn:t:orders:' || o_orderkey LIMIT 20 OFFSET 5)",
    {"p": 2},
)
select(
    "ord03_expression_key",
    "SELECT ?n { ?x c:n_name ?n } ORDER BY STRLEN(?n) ?n LIMIT 7",
    "SELECT n_name AS n FROM (SELECT n_name FROM nation ORDER BY length(n_name), n_name LIMIT 7)",
)
select(
    "dst01_distinct",
    "SELECT DISTINCT ?flag ?mode { ?l c:l_returnflag ?flag ; c:l_linestatus ?mode }",
    "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS mode FROM lineitem",
)
select(
    "top_customers",
    "SELECT ?name (SUM(?p) AS ?spent) { ?o c:o_custkey ?c ; c:o_totalprice ?p . ?c c:c_name ?name } GROUP BY ?name ORDER BY DESC(?spent) LIMIT 10",
    f"SELECT name, {_d('spent')} AS spent FROM (SELECT c_name AS name, sum(o_totalprice) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC LIMIT 10)",
    {"spent": 2},
)
select(
    "qf02_ask",
    'ASK { ?x c:n_name "NATION_3" }',
    "SELECT CASE WHEN count(*) > 0 THEN 'true' ELSE 'false' END AS _ask FROM nation WHERE n_name = 'NATION_3'",
)

# schema questions

select(
    "src13_predicate_counts",
    "SELECT ?p (COUNT(*) AS ?n) { ?s a t:nation ; ?p ?o } GROUP BY ?p",
    """SELECT p, n FROM (SELECT unnest(['urn:c:n_nationkey', 'urn:c:n_name', 'urn:c:n_regionkey', 'urn:c:within', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p,
    (SELECT count(*) FROM nation) AS n)""",
    n="long",
)
select(
    "types_count",
    "SELECT ?t (COUNT(*) AS ?n) { ?s a ?t } GROUP BY ?t",
    " UNION ALL ".join(f"SELECT 'urn:t:{t}' AS t, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
    n="long",
)

# paths

select(
    "pth12_sequence",
    "SELECT ?rname (COUNT(*) AS ?n) { ?o c:o_custkey/c:c_nationkey/c:n_regionkey ?r . ?r c:r_name ?rname } GROUP BY ?rname",
    """SELECT r_name AS rname, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    n="long",
)
select(
    "pth02_inverse",
    "SELECT ?n { <urn:t:region:1> ^c:n_regionkey/c:n_name ?n }",
    "SELECT n_name AS n FROM nation WHERE n_regionkey = 1",
)
select(
    "pth06_alternative",
    "SELECT (COUNT(*) AS ?n) { ?x (c:c_nationkey|c:s_nationkey) ?y }",
    "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n",
    n="long",
)
select(
    "pth03_plus",
    "SELECT ?x { ?x (c:n_regionkey|c:s_nationkey)+ <urn:t:region:2> }",
    """SELECT 'urn:t:nation:' || n_nationkey AS x FROM nation WHERE n_regionkey = 2
    UNION ALL SELECT 'urn:t:supplier:' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2""",
)
select(
    "pth04_star",
    "SELECT ?y { <urn:t:supplier:1> (c:s_nationkey|c:n_regionkey)* ?y }",
    """SELECT 'urn:t:supplier:1' AS y UNION ALL SELECT 'urn:t:nation:' || s_nationkey FROM supplier WHERE s_suppkey = 1
    UNION ALL SELECT 'urn:t:region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1""",
)
select(
    "pth05_optional_step",
    "SELECT ?y { <urn:t:nation:3> c:n_regionkey? ?y }",
    "SELECT 'urn:t:nation:3' AS y UNION ALL SELECT 'urn:t:region:' || n_regionkey FROM nation WHERE n_nationkey = 3",
)
select(
    "pth13_negated",
    "SELECT ?y { <urn:t:nation:3> !(c:n_regionkey|c:within|<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>) ?y }",
    "SELECT CAST(n_nationkey AS VARCHAR) AS y FROM nation WHERE n_nationkey = 3 UNION ALL SELECT n_name FROM nation WHERE n_nationkey = 3",
)


# stored quads


def _store(spark: SparkSession, sf_dir: str, columns: list[str], **settings) -> GraphStore:
    store = GraphStore(spark, **settings)
    store.put_quads(RelationalGraph(spark, sf_dir).quads([f"urn:c:{c}" for c in columns]), 0)
    return store


@operator("agg09_quads_per_predicate", "SELECT 'urn:c:c_name' AS p, count(*) AS n FROM customer UNION ALL SELECT 'urn:c:c_nationkey', count(*) FROM customer UNION ALL SELECT 'urn:c:n_name', count(*) FROM nation")
def _quads_per_predicate(spark, sf_dir):
    s = _store(spark, sf_dir, ["c_name", "c_nationkey", "n_name"])
    return s.sparql("SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p", {"n": "long"})


@operator("qf03_construct", "SELECT 'urn:t:customer:' || c_custkey AS s, 'urn:livesIn' AS p, n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _construct(spark, sf_dir):
    q = Queries(RelationalGraph(spark, sf_dir))
    df = q.construct(XSD_PREFIX + "CONSTRUCT { ?c <urn:livesIn> ?n } WHERE { ?c c:c_nationkey ?x . ?x c:n_name ?n }")
    return df.select(F.col("subject.value").alias("s"), F.col("predicate.value").alias("p"), F.col("object.value").alias("o"))


@operator("qf05_describe", "SELECT 'urn:c:n_nationkey' AS p, CAST(n_nationkey AS VARCHAR) AS o FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'urn:c:n_name', n_name FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'urn:c:n_regionkey', 'urn:t:region:' || n_regionkey FROM nation WHERE n_nationkey = 7")
def _describe(spark, sf_dir):
    s = _store(spark, sf_dir, ["n_nationkey", "n_name", "n_regionkey"])
    return s.describe("DESCRIBE <urn:t:nation:7>").select(F.col("predicate.value").alias("p"), F.col("object.value").alias("o"))


@operator("upd05_delete_insert", "SELECT 'urn:t:customer:' || c_custkey AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS o FROM customer")
def _update(spark, sf_dir):
    s = _store(spark, sf_dir, ["c_mktsegment"])
    s.update('DELETE { ?c <urn:c:c_mktsegment> ?o } INSERT { ?c <urn:c:c_mktsegment> "HOUSES" } WHERE { ?c <urn:c:c_mktsegment> ?o FILTER(?o = "BUILDING") }')
    return s.sparql("SELECT ?s ?o { ?s <urn:c:c_mktsegment> ?o }")


@operator("gr02_graph_variable", "SELECT 'urn:g:nations' AS g, count(*) AS n FROM nation UNION ALL SELECT 'urn:g:regions', count(*) FROM region")
def _graphs(spark, sf_dir):
    s = _store(spark, sf_dir, ["n_name", "r_name"])
    s.carve_graph(0, "urn:g:nations", predicate="urn:c:n_name")
    s.carve_graph(0, "urn:g:regions", predicate="urn:c:r_name")
    return s.sparql("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", {"n": "long"})


@operator("gr09_copy_move_clear", "SELECT 'urn:g:b' AS g, (SELECT count(*) FROM nation) AS n")
def _lifecycle(spark, sf_dir):
    s = _store(spark, sf_dir, ["n_name"])
    s.copy_graph(0, "urn:g:a")
    s.clear_graph(0)
    s.move_graph("urn:g:a", "urn:g:b")
    return s.sparql("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", {"n": "long"})


@operator(
    "gr13_carve_ball",
    """SELECT 'urn:t:nation:' || n_nationkey AS s, 'urn:t:region:1' AS o FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'urn:t:supplier:' || s_suppkey, 'urn:t:nation:' || s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1""",
)
def _ball(spark, sf_dir):
    s = _store(spark, sf_dir, ["n_regionkey", "s_nationkey", "c_nationkey"])
    s.update("DELETE WHERE { ?s <urn:c:c_nationkey> ?o }")
    s.carve_graph(0, "urn:g:ball", seeds=["urn:t:region:1"], max_hops=2)
    return s.sparql("SELECT ?s ?o { GRAPH <urn:g:ball> { ?s ?p ?o } }")


@operator(
    "gr15_integrity",
    """SELECT what, n FROM (SELECT unnest(['quads', 'subject_literal', 'subject_dangling', 'object_dangling', 'colliding_ids']) AS what,
    unnest([2 * (SELECT count(*) FROM nation) + 2, 1, 1, 1, 2]) AS n)""",
)
def _integrity(spark, sf_dir):
    """A clean graph, and two quads with a literal subject that bears another term's id and an object without a term."""
    s = _store(spark, sf_dir, ["n_name", "n_regionkey"])
    sick = s.quads.where("o__x = 'NATION_1' OR o__x = 'NATION_2'").withColumn("g", F.lit(3).cast("long"))
    sick = sick.withColumn("s__k", F.when(F.col("o__x") == "NATION_1", T.LITERAL).otherwise(F.col("s__k")))
    sick = sick.withColumn("o__x", F.when(F.col("s__k") == T.LITERAL, F.col("o__x")))
    s.put_quads(s.quads.withColumn("g", F.lit(3).cast("long")).unionByName(sick), 3, dedup=False)
    a = s.graph_integrity(3)
    assert s.graph_integrity(0)["clean"] and not a["clean"]
    return spark.createDataFrame([(k, a[k]) for k in ("quads", "subject_literal", "subject_dangling", "object_dangling", "colliding_ids")], "what string, n long")


_LINES = """SELECT '<urn:t:nation:' || n_nationkey || '> <urn:c:n_name> "' || n_name || '" .' AS l FROM nation
    UNION ALL SELECT '<urn:t:nation:' || n_nationkey || '> <urn:c:n_regionkey> <urn:t:region:' || n_regionkey || '> .' FROM nation"""


@operator("gr16_digest", f"SELECT sha256(string_agg(l || chr(10), '' ORDER BY l)) AS digest FROM ({_LINES})")
def _digest(spark, sf_dir):
    return spark.createDataFrame([(_store(spark, sf_dir, ["n_name", "n_regionkey"]).graph_digest(0),)], "digest string")


@operator(
    "gr16_partitioned_digest",
    f"""SELECT sha256(count(*) || ':' || {" || ':' || ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)" for i in range(4))}) AS digest
    FROM (SELECT sha256(l) AS h FROM ({_LINES}))""",
)
def _partitioned_digest(spark, sf_dir):
    return spark.createDataFrame([(_store(spark, sf_dir, ["n_name", "n_regionkey"]).partitioned_digest(0),)], "digest string")


@operator(
    "inf02_rdfs",
    """SELECT t, n FROM (SELECT 'urn:Party' AS t, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n
    UNION ALL SELECT 'urn:Client', count(*) FROM customer UNION ALL SELECT 'urn:Vendor', count(*) FROM supplier UNION ALL SELECT 'urn:Place', count(*) FROM nation
    WHERE n_nationkey IN (SELECT c_nationkey FROM customer) OR n_nationkey IN (SELECT s_nationkey FROM supplier))""",
)
def _rdfs(spark, sf_dir):
    s = _store(spark, sf_dir, ["c_nationkey", "s_nationkey"])
    s.parse_turtle(
        """@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . <urn:c:c_nationkey> rdfs:subPropertyOf <urn:in> ; rdfs:domain <urn:Client> .
        <urn:c:s_nationkey> rdfs:subPropertyOf <urn:in> ; rdfs:domain <urn:Vendor> . <urn:in> rdfs:range <urn:Place> .
        <urn:Client> rdfs:subClassOf <urn:Party> . <urn:Vendor> rdfs:subClassOf <urn:Party> ."""
    )
    s.materialize(0, "rdfs")
    return s.sparql("SELECT ?t (COUNT(DISTINCT ?x) AS ?n) { ?x a ?t } GROUP BY ?t", {"n": "long"})


@operator(
    "inf08_owl_transitive",
    """SELECT 'urn:t:customer:' || c_custkey AS x, 'urn:t:region:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _owl(spark, sf_dir):
    s = _store(spark, sf_dir, ["c_nationkey", "n_regionkey"])
    s.parse_turtle(
        """@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
        <urn:c:c_nationkey> rdfs:subPropertyOf <urn:in> . <urn:c:n_regionkey> rdfs:subPropertyOf <urn:in> . <urn:in> a owl:TransitiveProperty ."""
    )
    s.materialize(0, "owl-rl")
    return s.sparql("SELECT ?x ?r { ?x <urn:c:c_nationkey> ?n ; <urn:in> ?r . ?n <urn:c:n_regionkey> ?r }")


@operator("sh08_shacl", "SELECT 'urn:t:customer:' || c_custkey AS focus FROM customer WHERE c_acctbal < 0")
def _shacl(spark, sf_dir):
    s = _store(spark, sf_dir, ["c_acctbal", "c_name"])
    s.parse_turtle(
        """@prefix sh: <http://www.w3.org/ns/shacl#> . <urn:S> a sh:NodeShape ; sh:targetSubjectsOf <urn:c:c_name> ;
        sh:property [ sh:path <urn:c:c_acctbal> ; sh:minInclusive 0 ; sh:minCount 1 ; sh:maxCount 1 ] .""", 9,
    )
    return s.validate(0, 9, collect=False)["report"].select(F.col("focusNode").alias("focus"))


@operator("snk03_ntriples", "SELECT '<urn:t:nation:' || n_nationkey || '> <urn:c:n_name> \"' || n_name || '\" .' AS value FROM nation")
def _ntriples(spark, sf_dir):
    from ..sources.rdf import nt_lines

    return nt_lines(RelationalGraph(spark, sf_dir).quads(["urn:c:n_name"]))


@operator("src08_ntriples_round_trip", "SELECT 'urn:t:orders:' || o_orderkey AS s, o_orderstatus AS o FROM orders")
def _round_trip(spark, sf_dir):
    from ..sources.quads import with_ids
    from ..sources.rdf import nt_lines, parse_lines

    rows = parse_lines(nt_lines(RelationalGraph(spark, sf_dir).quads(["urn:c:o_orderstatus"])), "b.")
    quads = with_ids(rows.drop("graph").withColumn("g", F.lit(0).cast("long")))
    return quads.where(F.col("p") == T.id_lit(T.iri("urn:c:o_orderstatus"))).select(F.col("s__x").alias("s"), F.col("o__x").alias("o"))


from . import catalog_store  # noqa: E402, F401  registers the queries over stored graphs
