"""More registered queries: sources, sinks, graphs, updates, reasoning, validation and errors over stored graphs made of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import terms as T
from ..engine import GraphStore, Queries
from ..operators.closure import shared_dir, stage
from ..operators.paths import Paths
from ..sources import rdf
from ..sources.quads import from_triples, with_ids
from ..sources.relational import RelationalGraph
from ..streaming import ingest
from .catalog import _d, _store, operator, select

RDF_PREFIX = "PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX owl: <http://www.w3.org/2002/07/owl#> PREFIX c: <urn:c:> PREFIX x: <urn:x:> PREFIX g: <urn:g:>\n"
TURTLE = RDF_PREFIX + "PREFIX sh: <http://www.w3.org/ns/shacl#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"


def told(spark, rows):
    """Rows (what, value) of small facts."""
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "what string, value string")


def told_sql(*pairs) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS what, CAST({v} AS VARCHAR) AS value" for k, v in pairs)


# expressions over the tables

select(
    "flt04_kinds",
    """SELECT ?k (COUNT(*) AS ?n) { ?s a t:nation ; ?p ?o BIND(IF(isIRI(?o), "iri", IF(isBlank(?o), "blank", IF(isLiteral(?o), "literal", "none"))) AS ?k) } GROUP BY ?k""",
    "SELECT 'iri' AS k, 3 * count(*) AS n FROM nation UNION ALL SELECT 'literal', 2 * count(*) FROM nation",
    n="long",
)
select(
    "flt05_bound",
    "SELECT ?has (COUNT(*) AS ?n) { ?c c:c_name ?m OPTIONAL { ?o c:o_custkey ?c ; c:o_totalprice ?p FILTER(?p > 490000) } BIND(BOUND(?o) AS ?has) } GROUP BY ?has",
    "SELECT o_orderkey IS NOT NULL AS has, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 490000 GROUP BY 1",
    has="boolean", n="long",
)
select(
    "jn03_join_order",
    "SELECT ?rname (COUNT(*) AS ?n) { ?o c:o_totalprice ?p . ?r c:r_name ?rname . ?na c:n_regionkey ?r . ?o c:o_custkey ?c . ?c c:c_nationkey ?na FILTER(?p > 250000) } GROUP BY ?rname",
    """SELECT r_name AS rname, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 250000 GROUP BY 1""",
    n="long",
)
select(
    "jn06_optional_shared_variable",
    "SELECT ?x ?m { ?x c:n_name ?n OPTIONAL { ?a c:s_nationkey ?x ; c:s_name ?m } OPTIONAL { ?b c:c_nationkey ?x ; c:c_name ?m ; c:c_acctbal ?k FILTER(?k > 9000) } }",
    """WITH one AS (SELECT n_nationkey AS k, s_name AS m FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey)
    SELECT 'urn:t:nation:' || k AS x, coalesce(m, c_name) AS m FROM one LEFT JOIN customer ON c_nationkey = k AND c_acctbal > 9000 AND (m IS NULL OR m = c_name)""",
)
select(
    "jn07_optional_without_shared",
    'SELECT ?a ?b ?z { ?r c:r_name ?a OPTIONAL { ?x c:n_name ?b FILTER(?b = "NATION_4") } OPTIONAL { ?y c:n_name ?z FILTER(?z = "nowhere") } }',
    "SELECT r_name AS a, 'NATION_4' AS b, CAST(NULL AS VARCHAR) AS z FROM region",
)
select(
    "agg04_exact_decimal_sum",
    "SELECT ?s (SUM(xsd:decimal(STR(?p))) AS ?total) (MAX(xsd:decimal(STR(?p)) * 3) AS ?thrice) { ?o c:o_orderstatus ?s ; c:o_totalprice ?p } GROUP BY ?s",
    """SELECT o_orderstatus AS s, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS total, (max(CAST(o_totalprice AS DECIMAL(18,2))) * 3)::DECIMAL(28,2) AS thrice
    FROM orders GROUP BY 1""",
    total="decimal(28,2)", thrice="decimal(28,2)",
)
select(
    "agg04_large_integers",
    "SELECT (SUM(?k + 9007199254740992) AS ?s) (MAX(?k + 9007199254740992) AS ?m) { ?c c:c_custkey ?k FILTER(?k + 9007199254740992 > 9007199254740993) }",
    "SELECT CAST(sum(c_custkey + 9007199254740992) AS VARCHAR) AS s, CAST(max(c_custkey + 9007199254740992) AS VARCHAR) AS m FROM customer WHERE c_custkey > 1",
)
select(
    "agg15_canonical_text",
    "SELECT (SUM(?k) AS ?s) (AVG(?k) AS ?a) (SUM(?k / 8) AS ?e) (COUNT(*) AS ?n) (MIN(?k * 1.50) AS ?z) { ?x c:r_regionkey ?k FILTER(?k > 0) }",
    "SELECT '10' AS s, '2.5' AS a, '1.25' AS e, '4' AS n, '1.5' AS z",
)
select(
    "agg18_approx_count_distinct",
    "SELECT ?near { { SELECT (APPROX_COUNT_DISTINCT(?c) AS ?a) (COUNT(DISTINCT ?c) AS ?b) { ?o c:o_custkey ?c } } BIND(ABS(?a - ?b) <= 0.15 * ?b AS ?near) }",
    "SELECT true AS near",
    near="boolean",
)
select(
    "num04_rand",
    "SELECT (COUNT(*) AS ?n) { ?c c:c_custkey ?k BIND(RAND() AS ?r) FILTER(?r >= 0 && ?r < 1) }",
    "SELECT count(*) AS n FROM customer",
    n="long",
)
select(
    "num05_math",
    """SELECT ?c (math:exp(?b / 10000) AS ?e) (math:log(?a + 1) AS ?l) (math:pow(?b / 1000, 2) AS ?p) (math:log10(?a + 1) AS ?t) (math:sin(?b) AS ?si) (math:cos(?b) AS ?co)
    { ?c c:c_acctbal ?b BIND(ABS(?b) AS ?a) }""",
    f"""SELECT 'urn:t:customer:' || c_custkey AS c, {_d('exp(c_acctbal / 10000)', 6)} AS e, {_d('ln(abs(c_acctbal) + 1)', 6)} AS l, {_d('pow(c_acctbal / 1000, 2)', 6)} AS p,
    {_d('log10(abs(c_acctbal) + 1)', 6)} AS t, {_d('sin(c_acctbal)', 6)} AS si, {_d('cos(c_acctbal)', 6)} AS co FROM customer""",
    dict.fromkeys(("e", "l", "p", "t", "si", "co"), 6),
)
select(
    "fn_dates",
    """SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS("2020-01-02T10:00:00+05:00"^^xsd:dateTime) AS ?h) (TZ("2020-01-02T10:00:00+05:00"^^xsd:dateTime) AS ?z)
    { ?o c:o_orderdate ?d FILTER(?d >= "1998-01-01T00:00:00"^^xsd:dateTime) }""",
    """SELECT 'urn:t:orders:' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, 10::BIGINT AS h, '+05:00' AS z
    FROM orders WHERE o_orderdate >= '1998-01-01'""",
    y="long", m="long", dd="long", h="long",
)
select(
    "fn_hashes",
    """SELECT ?n (MD5(?n) AS ?a) (SHA256(?n) AS ?b) (ENCODE_FOR_URI(CONCAT(?n, " /é")) AS ?c) (COALESCE(?none, ?n) AS ?d) (DATATYPE(STRDT(?n, xsd:token)) AS ?e)
    (LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "en") AS ?f) { ?x c:n_name ?n }""",
    """SELECT n_name AS n, md5(n_name) AS a, sha256(n_name) AS b, n_name || '%20%2F%C3%A9' AS c, n_name AS d, 'http://www.w3.org/2001/XMLSchema#token' AS e, true AS f FROM nation""",
    f="boolean",
)
select(
    "pth14_nested",
    "SELECT ?r (COUNT(*) AS ?n) { ?r ^(c:s_nationkey/(c:n_regionkey|c:none)) ?s } GROUP BY ?r",
    "SELECT 'urn:t:region:' || n_regionkey AS r, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    n="long",
)


@operator("fn_registered", "SELECT n_name AS n, reverse(n_name) AS r FROM nation")
def _registered(spark, sf_dir):
    q = Queries(RelationalGraph(spark, sf_dir))
    q.register_function("urn:f:turned", F.reverse)
    return q.sparql("SELECT ?n (<urn:f:turned>(?n) AS ?r) { ?x <urn:c:n_name> ?n }")


# sources and sinks


def _turtle(spark, sf_dir) -> str:
    """The nations as Turtle; there are 25 whatever the scale."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    return TURTLE + "".join(f"<urn:t:nation:{r['n_nationkey']}> x:name \"{r['n_name']}\" ; x:key {r['n_nationkey']} .\n" for r in rows)


_TURTLE_SQL = f"""'{TURTLE.replace(chr(10), "' || chr(10) || '")}' ||
    string_agg('<urn:t:nation:' || n_nationkey || '> x:name "' || n_name || '" ; x:key ' || n_nationkey || ' .' || chr(10), '' ORDER BY n_nationkey)"""
_NAMES = "SELECT 'urn:t:nation:' || n_nationkey AS s, n_name AS n, n_nationkey AS k FROM nation"
_NAMES_Q = RDF_PREFIX + "SELECT ?s ?n ?k { ?s x:name ?n ; x:key ?k }"


@operator("src01_turtle", _NAMES)
def _parse_turtle(spark, sf_dir):
    s = GraphStore(spark)
    s.parse_turtle(_turtle(spark, sf_dir))
    return s.sparql(_NAMES_Q, {"k": "int"})


@operator("src02_turtle_verbose", f"SELECT 2 * count(*) AS triples, sha256({_TURTLE_SQL}) AS sha, 2 AS loads FROM nation")
def _parse_verbose(spark, sf_dir):
    s, text = GraphStore(spark), _turtle(spark, sf_dir)
    a, b = s.parse_turtle_verbose(text, 4), s.parse_turtle_verbose(text, 4)
    loads = s.graphs.where("graph_id = 4").first()["source_loads"]
    return spark.createDataFrame([(a["triples"] + b["triples"], b["source_sha256"], loads)], "triples long, sha string, loads int")


@operator("src03_texts_round_trip", "SELECT 'urn:d:' || doc_id AS s, md5(text) AS h FROM documents WHERE text IS NOT NULL")
def _texts(spark, sf_dir):
    """Whole texts as literals: written as N-Triples, read back from the files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL AND text IS NOT NULL")
    node = F.concat(F.lit("urn:d:"), F.col("doc_id"))
    quads = with_ids(docs.select(F.lit(T.IRI).alias("s__k"), node.alias("s__x"), F.lit("urn:x:text").alias("p__x"), F.lit(T.LITERAL).alias("o__k"), F.col("text").alias("o__x"),
                                 F.lit(T.STRING).alias("o__d"), F.lit("").alias("o__l"), F.lit(0).cast("long").alias("g")))
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    rdf.nt_lines(quads).write.text(path)
    s = GraphStore(spark)
    s.load(path, 2, "ntriples", dedup=False)
    return s.quads.select(F.col("s__x").alias("s"), F.md5("o__x").alias("h"))


@operator("src04_load_turtle_verbose", f"SELECT 2 * count(*) AS triples, 0 AS before, 2 * count(*) AS after FROM nation")
def _load_verbose(spark, sf_dir):
    path = f"{shared_dir(spark)}/turtle-{uuid.uuid4().hex}"
    spark.createDataFrame([(_turtle(spark, sf_dir),)], "value string").coalesce(1).write.text(path)
    r = GraphStore(spark).load_turtle_verbose(path, 5)
    return spark.createDataFrame([(r["triples"], r["quads_before"], r["quads_after"])], "triples long, before int, after long")


@operator("src06_stream_ingest", "SELECT 'urn:t:orders:' || o_orderkey AS s, o_orderpriority AS o FROM orders")
def _stream(spark, sf_dir):
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    quads = RelationalGraph(spark, sf_dir).quads(["urn:c:o_orderpriority"])
    rdf.nt_lines(quads).write.text(f"{root}/in")
    ingest.ingest(spark, f"{root}/in", f"{root}/out").awaitTermination(600)
    return ingest.read_ingested(spark, f"{root}/out").select(F.col("s__x").alias("s"), F.col("o__x").alias("o"))


@operator(
    "streaming_predicate_counts",
    """SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS p, count(*) AS n FROM events GROUP BY 1, 2""",
)
def _windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("p__x"), F.col("ts").cast("timestamp_ntz").alias("arrived"))
    return ingest.predicate_counts(events).select(F.col("window.start").alias("start"), F.col("p__x").alias("p"), "n")


@operator("src10_sniff", told_sql(("lines", "'ntriples'"), ("turtle", "'turtle'"), ("comment", "'turtle'"), ("quads", "'ntriples'")))
def _sniff(spark, sf_dir):
    lines = [r[0] for r in rdf.nt_lines(RelationalGraph(spark, sf_dir).quads(["urn:c:n_name"])).collect()]
    heads = {"lines": "\n".join(lines), "turtle": _turtle(spark, sf_dir), "comment": "# only a comment\n", "quads": "# c\n" + lines[0][:-1] + "<urn:g:1> ."}
    return told(spark, [(k, rdf.sniff(v)) for k, v in heads.items()])


@operator("src11_trig", "SELECT 'urn:g:' || n_regionkey AS g, n_name AS n FROM nation UNION ALL SELECT 'none', 'plain'")
def _trig(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    text = RDF_PREFIX + "x:a x:name \"plain\" .\n" + "".join(f"GRAPH g:{r['n_regionkey']} {{ <urn:t:nation:{r['n_nationkey']}> x:name \"{r['n_name']}\" }}\n" for r in rows)
    s = GraphStore(spark)
    s.parse_trig(text)
    return s.sparql(RDF_PREFIX + 'SELECT ?g ?n { { GRAPH ?g { ?s x:name ?n } } UNION { ?s x:name ?n FILTER(?n = "plain") BIND("none" AS ?g) } }')


@operator("src12_nquads", "SELECT 'urn:g:' || n_regionkey AS g, '🎉é' || chr(92) || 'u0041' || chr(9) || n_name AS n FROM nation")
def _nquads(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    text = "".join(f"<urn:t:nation:{r['n_nationkey']}> <urn:x:name> \"\\U0001F389\\u00E9\\\\u0041\\t{r['n_name']}\" <urn:g:{r['n_regionkey']}> .\n" for r in rows)
    s = GraphStore(spark)
    s.parse_nquads(text)
    return s.sparql(RDF_PREFIX + "SELECT ?g ?n { GRAPH ?g { ?s x:name ?n } }")


@operator(
    "src14_put_quad",
    told_sql(("new", 1), ("again", 0), ("count", "(SELECT count(*) FROM nation) + 1"), ("other", 1), ("term", "'NATION_7'"), ("nothing", "'None'")),
)
def _put_quad(spark, sf_dir):
    """put_quad, count_quads, put_term and get_term."""
    s = _store(spark, sf_dir, ["n_name"])
    triple = (T.iri("urn:x:a"), T.iri("urn:c:n_name"), T.literal("new"))
    rows = [("new", s.put_quad(*triple)), ("again", s.put_quad(*triple)), ("count", s.count_quads(0))]
    s.put_quad(*triple, graph=3)
    rows += [("other", s.count_quads(3)), ("term", s.get_term(s.put_term(T.literal("NATION_7")))), ("nothing", s.get_term(12345))]
    return told(spark, rows)


@operator(
    "snk01_construct_rows",
    "SELECT 'urn:t:customer:' || c_custkey AS s, n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 UNION ALL SELECT 'one', 'row'",
)
def _construct_rows(spark, sf_dir):
    """What CONSTRUCT gives, put back row by row (one) and as a batch; blank node labels are shared inside a batch."""
    q = Queries(RelationalGraph(spark, sf_dir))
    df = q.construct("CONSTRUCT { ?c <urn:x:in> ?n } WHERE { ?c <urn:c:c_nationkey> ?x ; <urn:c:c_acctbal> ?b . ?x <urn:c:n_name> ?n FILTER(?b < 0) }")
    s = GraphStore(spark)
    s.put_construct_rows([r.asDict(True) for r in df.collect()], 1)
    node, iri = {"type": "bnode", "value": "n"}, lambda x: {"type": "iri", "value": x}
    s.put_construct_rows([{"subject": node, "predicate": iri("urn:x:a"), "object": {"type": "literal", "value": "one"}},
                          {"subject": node, "predicate": iri("urn:x:b"), "object": {"type": "literal", "value": "row"}}], 2)
    s.put_construct_row({"subject": node, "predicate": iri("urn:x:b"), "object": {"type": "literal", "value": "another"}}, 2)
    return s.sparql("SELECT ?s ?o { { GRAPH ?g { ?s <urn:x:in> ?o } } UNION { ?n <urn:x:a> ?s ; <urn:x:b> ?o } }")


@operator("snk04_source_digest", f"SELECT sha256({_TURTLE_SQL}) AS sha, 1 AS loads FROM nation")
def _source_digest(spark, sf_dir):
    s = GraphStore(spark)
    s.parse_turtle(_turtle(spark, sf_dir), 2)
    return s.graphs.where("graph_id = 2").select(F.col("source_sha256").alias("sha"), F.col("source_loads").alias("loads"))


# joins, groups and paths over stored graphs


@operator("jn02_same_variable_twice", "SELECT 'urn:t:nation:' || n_nationkey AS x FROM nation WHERE n_regionkey = 1")
def _same_variable(spark, sf_dir):
    s = _store(spark, sf_dir, ["n_regionkey"])
    s.update("INSERT { ?n <urn:x:self> ?n } WHERE { ?n <urn:c:n_regionkey> <urn:t:region:1> }")
    return s.sparql("SELECT ?x { ?x ?p ?x }")


def _regions(spark, sf_dir, columns=("n_name", "n_regionkey")) -> GraphStore:
    """Nations of regions 0 and 1 in graphs of their own, and all of them in the default graph."""
    s = _store(spark, sf_dir, list(columns))
    for r in (0, 1):
        s.update(RDF_PREFIX + f"INSERT {{ GRAPH g:{r} {{ ?n c:n_name ?m }} }} WHERE {{ ?n c:n_regionkey <urn:t:region:{r}> ; c:n_name ?m }}")
    return s


@operator("jn09_values_graph", "SELECT 'urn:g:1' AS g, n_name AS n FROM nation WHERE n_regionkey = 1")
def _values_graph(spark, sf_dir):
    return _regions(spark, sf_dir).sparql(RDF_PREFIX + "SELECT ?g ?n { VALUES ?g { g:1 g:9 } GRAPH ?g { ?x c:n_name ?n } }")


@operator("agg14_group_by_graph", "SELECT 'urn:g:' || n_regionkey AS g, 2 * count(*) AS n FROM nation WHERE n_regionkey < 2 GROUP BY 1")
def _group_graph(spark, sf_dir):
    return _regions(spark, sf_dir).sparql(RDF_PREFIX + "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { { ?x c:n_name ?n } UNION { ?y c:n_name ?n } } } GROUP BY ?g", {"n": "long"})


@operator(
    "gr03_composition",
    """SELECT 'optional' AS how, count(*) AS n FROM nation UNION ALL SELECT 'found', count(*) FROM nation WHERE n_regionkey < 2
    UNION ALL SELECT 'minus', count(*) FROM nation WHERE n_regionkey >= 2 UNION ALL SELECT 'union', count(*) FROM nation WHERE n_regionkey < 2
    UNION ALL SELECT 'exists', count(*) FROM nation WHERE n_regionkey = 1""",
)
def _composition(spark, sf_dir):
    s = _regions(spark, sf_dir)
    base = "?x c:n_regionkey ?r"
    bodies = {
        "optional": f"{base} OPTIONAL {{ GRAPH ?g {{ ?x c:n_name ?m }} }}", "found": f"{base} OPTIONAL {{ GRAPH ?g {{ ?x c:n_name ?m }} }} FILTER(BOUND(?g))",
        "minus": f"{base} MINUS {{ GRAPH ?g {{ ?x c:n_name ?m }} }}", "union": "{ GRAPH g:0 { ?x c:n_name ?m } } UNION { GRAPH g:1 { ?x c:n_name ?m } }",
        "exists": f"{base} FILTER EXISTS {{ GRAPH g:1 {{ ?x c:n_name ?m }} }}",
    }
    out = None
    for how, body in bodies.items():
        df = s.sparql(RDF_PREFIX + f'SELECT ?how (COUNT(*) AS ?n) {{ {body} BIND("{how}" AS ?how) }} GROUP BY ?how', {"n": "long"})
        out = df if out is None else out.unionByName(df)
    return out


@operator(
    "gr04_datasets",
    """SELECT 'from' AS how, count(*) AS n FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'merged', count(*) FROM nation WHERE n_regionkey < 2
    UNION ALL SELECT 'named', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'hidden', 0 UNION ALL SELECT 'empty', 0""",
)
def _datasets(spark, sf_dir):
    s = _regions(spark, sf_dir)
    cases = {
        "from": ("FROM g:0", "?x c:n_name ?m"), "merged": ("FROM g:0 FROM g:1", "?x c:n_name ?m"), "named": ("FROM g:0 FROM NAMED g:1", "GRAPH ?g { ?x c:n_name ?m }"),
        "hidden": ("FROM NAMED g:0", "GRAPH g:1 { ?x c:n_name ?m }"), "empty": ("FROM NAMED g:0", "?x c:n_name ?m"),
    }
    out = None
    for how, (clauses, body) in cases.items():
        df = s.sparql(RDF_PREFIX + f"SELECT (COUNT(*) AS ?n) {clauses} {{ {body} }}", {"n": "long"}).withColumn("how", F.lit(how))
        out = df if out is None else out.unionByName(df)
    return out.select("how", "n")


@operator(
    "gr05_lifecycle",
    told_sql(
        ("add id", "'True'"), ("add id again", "'False'"), ("add iri", 6), ("same iri", 6), ("bind", 9), ("id of", 9), ("iri of", "'urn:g:nine'"), ("iri of none", "'None'"),
        ("copied", "(SELECT count(*) FROM nation)"), ("dropped", "(SELECT count(*) FROM nation)"), ("left", 0), ("unknown iri", "'GraphError'"), ("default", "'GraphError'"),
        ("lock", "'True'"), ("locked", "'Locked'"), ("unlock", "'True'"), ("cleared", "(SELECT count(*) FROM nation)"),
    ),
)
def _graph_steps(spark, sf_dir):
    """add_graph, graph_id, graph_iri, copy, drop, clear, lock and their refusals."""
    s = _store(spark, sf_dir, ["n_name"])

    def refused(f):
        try:
            f()
        except Exception as e:
            return type(e).__name__
        return "accepted"

    rows = [
        ("add id", s.add_graph(5)), ("add id again", s.add_graph(5)), ("add iri", s.add_graph("urn:g:six")), ("same iri", s.add_graph("urn:g:six")), ("bind", s.add_graph(9, "urn:g:nine")),
        ("id of", s.graph_id("urn:g:nine")), ("iri of", s.graph_iri(9)), ("iri of none", s.graph_iri(77)), ("copied", s.copy_graph(0, 5)), ("dropped", s.drop_graph(5)), ("left", s.count_quads(5)),
        ("unknown iri", refused(lambda: s.drop_graph("urn:g:none"))), ("default", refused(lambda: s.drop_graph(0))), ("lock", s.lock_graph(0, "audit")),
        ("locked", refused(lambda: s.clear_graph(0))), ("unlock", s.unlock_graph(0)), ("cleared", s.clear_graph(0)),
    ]
    return told(spark, rows)


@operator("obs06_save_open", "SELECT 'urn:g:' || n_regionkey AS g, count(*) AS n FROM nation WHERE n_regionkey < 2 GROUP BY 1")
def _save_open(spark, sf_dir):
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    _regions(spark, sf_dir).save(path)
    return GraphStore.open(spark, path).sparql("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?x ?p ?o } } GROUP BY ?g", {"n": "long"})


@operator("pth08_zero_length", "SELECT 'urn:t:nation:' || n_nationkey AS x FROM nation UNION ALL SELECT DISTINCT 'urn:t:region:' || n_regionkey FROM nation")
def _zero_length(spark, sf_dir):
    return _store(spark, sf_dir, ["n_regionkey"]).sparql("SELECT ?x { ?x <urn:x:none>* ?x }")


@operator("pth09_depth_guard", told_sql(("pairs", 54), ("cut", 1), ("policy", "'PathTruncated'")))
def _depth(spark, sf_dir):
    """A chain of the nations in the order of their keys, followed three steps far."""
    s = GraphStore(spark, max_depth=3, on_truncation="count")
    s.put_quads(from_triples(spark, [(T.iri(f"urn:n:{i}"), T.iri("urn:x:next"), T.iri(f"urn:n:{i + 1}")) for i in range(19)]), 0)
    n = s.sparql("SELECT (COUNT(*) AS ?n) { ?x <urn:x:next>+ ?y }").first()[0]
    rows = [("pairs", n), ("cut", s.stats()["path_depth_truncations"])]
    s.paths = Paths(3, "error")
    try:
        s.sparql("SELECT * { ?x <urn:x:next>+ ?y }")
    except RuntimeError as e:
        rows.append(("policy", type(e).__name__))
    return told(spark, rows)


@operator("pth11_closed_graphs", told_sql(("both", "(SELECT count(*) FROM nation) * 2 + 1 + 3"), ("one", "(SELECT count(*) FROM nation) * 2 + 1"), ("after", "(SELECT count(*) FROM nation) * 3 + 3")))
def _closed(spark, sf_dir):
    """Nations under region 0 under the world: closed in graph 0, a chain of two in graph 1 that is not."""
    s = GraphStore(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    s.parse_turtle(TURTLE + "".join(f"<urn:n:{r['n_nationkey']}> rdfs:subClassOf x:region .\n" for r in rows) + "x:region rdfs:subClassOf x:world .")
    s.parse_turtle(TURTLE + "x:a rdfs:subClassOf x:b . x:b rdfs:subClassOf x:c .", 1)
    s.materialize(0, "rdfs")
    n = lambda body: s.sparql(RDF_PREFIX + f"SELECT (COUNT(*) AS ?n) {{ {body} }}").first()[0]
    out = [("both", n("?x rdfs:subClassOf+ ?y"))]
    s.drop_graph(1)
    s.materialize(0, "rdfs")
    out.append(("one", n("?x rdfs:subClassOf+ ?y")))
    s.update(RDF_PREFIX + "INSERT DATA { x:world rdfs:subClassOf x:all }")
    out.append(("after", n("?x rdfs:subClassOf+ ?y")))
    return told(spark, out)


# forms


@operator("qf04_construct_where", "SELECT 'urn:t:nation:' || n_nationkey AS s, 'urn:c:n_name' AS p, n_name AS o FROM nation")
def _construct_where(spark, sf_dir):
    df = Queries(RelationalGraph(spark, sf_dir)).construct("CONSTRUCT WHERE { ?x <urn:c:n_name> ?n }")
    return df.select(F.col("subject.value").alias("s"), F.col("predicate.value").alias("p"), F.col("object.value").alias("o"))


@operator("qf05_describe_blank", "SELECT 'urn:x:name' AS p, n_name AS o FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'urn:x:has', 'node' FROM nation WHERE n_regionkey = 1")
def _describe_blank(spark, sf_dir):
    """A resource whose nations are blank nodes: they come with it."""
    s = _store(spark, sf_dir, ["n_name", "n_regionkey"])
    s.update(RDF_PREFIX + "INSERT { GRAPH g:r { ?r x:has _:n . _:n x:name ?m } } WHERE { ?n c:n_regionkey ?r ; c:n_name ?m }")
    found = s.describe(RDF_PREFIX + "DESCRIBE <urn:t:region:1> { GRAPH g:r { ?s ?p ?o } }")
    return found.select(F.col("predicate.value").alias("p"), F.when(F.col("object.type") == "bnode", "node").otherwise(F.col("object.value")).alias("o"))


@operator("qf07_parse_explain", told_sql(("form", "'SELECT'"), ("variables", "'n'"), ("pushed", "'True'"), ("pruned", "'True'"), ("cached", 1), ("cleared", 1)))
def _parse_explain(spark, sf_dir):
    q = Queries(RelationalGraph(spark, sf_dir))
    text = "SELECT ?n { ?o <urn:c:o_custkey> ?c ; <urn:c:o_totalprice> ?n FILTER(?n > 400000) }"
    shape, plan = q.sparql_parse(text), q.explain(text)
    pushed = "GreaterThan" in plan.split("PushedFilters")[1].split("\n")[0]
    rows = [("form", shape["form"]), ("variables", ",".join(shape["variables"])), ("pushed", pushed), ("pruned", "o_comment" not in plan and "o_orderdate" not in plan)]
    return told(spark, [*rows, ("cached", len(q._parsed)), ("cleared", q.plan_cache_clear())])


@operator(
    "error_contract",
    told_sql(
        ("syntax", "'SparqlError'"), ("untranslatable", "'Unsupported'"), ("service", "'SparqlError'"), ("distinct order", "'SparqlError'"), ("wrong form", "'SparqlError'"), ("not construct", "'SparqlError'"),
        ("unbound template", "'SparqlError'"), ("using", "'SparqlError'"), ("load", "'SparqlError'"), ("turtle", "'RdfSyntaxError'"), ("base", "'RdfSyntaxError'"), ("strict trig", "'GraphError'"),
        ("profile", "'GraphError'"), ("mode", "'ValidationError'"), ("no target", "'ValidationError'"), ("same graphs", "'GraphError'"), ("negative id", "'GraphError'"), ("unknown function", "'Unsupported'"),
    ),
)
def _errors(spark, sf_dir):
    s = _store(spark, sf_dir, ["r_name"])
    cases = {
        "syntax": lambda: s.sparql("SELECT ?x { ?x ?p }"), "untranslatable": lambda: s.sparql("SELECT ?x { ?x ?p ?o FILTER(REGEX(?o, ?p)) }"),
        "service": lambda: s.sparql("SELECT * { SERVICE <urn:x:s> { ?s ?p ?o } }"), "distinct order": lambda: s.sparql("SELECT DISTINCT ?x { ?x ?p ?o } ORDER BY ?o"),
        "wrong form": lambda: s.sparql("CONSTRUCT WHERE { ?x ?p ?o }"), "not construct": lambda: s.construct("SELECT ?x { ?x ?p ?o }"),
        "unbound template": lambda: s.construct("CONSTRUCT { ?x ?p ?z } WHERE { ?x ?p ?o }"), "using": lambda: s.update("DELETE { ?x ?p ?o } USING <urn:g:1> WHERE { ?x ?p ?o }"),
        "load": lambda: s.update("LOAD <urn:x:f>"), "turtle": lambda: s.parse_turtle("<urn:x:a> <urn:x:b> ."), "base": lambda: s.parse_turtle("<a> <b> <c> .", base="not absolute"),
        "strict trig": lambda: s.parse_trig("<urn:g:new> { <urn:x:a> <urn:x:b> 1 }", strict=True), "profile": lambda: s.materialize(0, "owl-full"), "mode": lambda: s.validate(0, 0, "other"),
        "no target": lambda: s.validate(0, 0), "same graphs": lambda: s.copy_graph(0, 0), "negative id": lambda: s.clear_graph(-1),
        "unknown function": lambda: s.sparql("SELECT (<urn:f:none>(?o) AS ?y) { ?x ?p ?o }"),
    }
    rows = []
    for name, f in cases.items():
        try:
            f()
            rows.append((name, "accepted"))
        except (ValueError, RuntimeError) as e:
            rows.append((name, type(e).__name__))
    return told(spark, rows)


# updates

_ALL = "SELECT ?s ?p ?o { ?s ?p ?o }"


@operator(
    "upd01_insert_data",
    """SELECT 'urn:t:nation:' || n_nationkey AS s, 'urn:c:n_name' AS p, n_name AS o FROM nation UNION ALL SELECT 'urn:x:a', 'urn:c:n_name', 'new'
    UNION ALL SELECT 'summary', 'INSERT_DATA', '2/1'""",
)
def _insert_data(spark, sf_dir):
    """Two triples, of which one is there: the summary counts attempts, the graph is a set."""
    s = _store(spark, sf_dir, ["n_name"])
    u = s.update('INSERT DATA { <urn:x:a> <urn:c:n_name> "new" . <urn:t:nation:3> <urn:c:n_name> "NATION_3" }')
    row = spark.createDataFrame([("summary", u["form"], f"{u['triples_inserted']}/{len(u['graphs_touched'])}")], "s string, p string, o string")
    return s.sparql(_ALL).unionByName(row)


@operator("upd02_delete_data", "SELECT 'urn:t:nation:' || n_nationkey AS s, 'urn:c:n_name' AS p, n_name AS o FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'summary', 'DELETE_DATA', '1'")
def _delete_data(spark, sf_dir):
    s = _store(spark, sf_dir, ["n_name"])
    u = s.update('DELETE DATA { <urn:t:nation:3> <urn:c:n_name> "NATION_3" . <urn:t:nation:3> <urn:c:n_name> "other" }')
    row = spark.createDataFrame([("summary", u["form"], str(u["triples_deleted"]))], "s string, p string, o string")
    return s.sparql(_ALL).unionByName(row)


@operator(
    "upd03_insert_where",
    """SELECT 'urn:t:customer:' || c_custkey AS s, 'urn:x:in' AS p, 'urn:t:region:' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _insert_where(spark, sf_dir):
    s = _store(spark, sf_dir, ["c_nationkey", "n_regionkey"])
    s.update(RDF_PREFIX + "INSERT { GRAPH g:new { ?c x:in ?r } } WHERE { ?c c:c_nationkey ?n . ?n c:n_regionkey ?r }")
    return s.sparql(RDF_PREFIX + "SELECT ?s ?p ?o { GRAPH g:new { ?s ?p ?o } }")


@operator("upd04_delete_where", "SELECT 'urn:t:customer:' || c_custkey AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _delete_where(spark, sf_dir):
    s = _store(spark, sf_dir, ["c_mktsegment"])
    s.update('DELETE WHERE { ?s <urn:c:c_mktsegment> "BUILDING" }')
    return s.sparql("SELECT ?s ?o { ?s <urn:c:c_mktsegment> ?o }")


@operator("upd06_with_graph", "SELECT 'urn:g:' || n_regionkey AS g, CASE WHEN n_regionkey = 1 THEN 'urn:x:was' ELSE 'urn:c:n_name' END AS p, count(*) AS n FROM nation WHERE n_regionkey < 2 GROUP BY 1, 2")
def _with_graph(spark, sf_dir):
    s = _regions(spark, sf_dir)
    s.update(RDF_PREFIX + "WITH g:1 DELETE { ?x c:n_name ?m } INSERT { ?x x:was ?m } WHERE { ?x c:n_name ?m }")
    return s.sparql("SELECT ?g ?p (COUNT(*) AS ?n) { GRAPH ?g { ?x ?p ?m } } GROUP BY ?g ?p", {"n": "long"})


@operator(
    "upd07_clear_drop_create",
    told_sql(
        ("clear one", "(SELECT count(*) FROM nation WHERE n_regionkey = 0)"), ("drop one", "(SELECT count(*) FROM nation WHERE n_regionkey = 1)"), ("gone", "'None'"), ("create", "'True'"),
        ("silent", 0), ("not silent", "'GraphError'"), ("clear all", "2 * (SELECT count(*) FROM nation)"), ("left", 0), ("form", "'MIXED'"), ("empty", "'EMPTY'"),
    ),
)
def _clear_drop_create(spark, sf_dir):
    s = _regions(spark, sf_dir)
    u = lambda t: s.update(RDF_PREFIX + t)
    rows = [("clear one", u("CLEAR GRAPH g:0")["triples_deleted"]), ("drop one", u("DROP GRAPH g:1")["triples_deleted"]), ("gone", s.graph_id("urn:g:1"))]
    u("CREATE GRAPH g:made")
    rows += [("create", s.graph_id("urn:g:made") is not None), ("silent", u("DROP SILENT GRAPH g:none")["triples_deleted"])]
    try:
        u("DROP GRAPH g:none")
    except ValueError as e:
        rows.append(("not silent", type(e).__name__))
    rows += [("clear all", u("CLEAR ALL")["triples_deleted"]), ("left", s.stats()["quads"]), ("form", u("CLEAR DEFAULT ; CREATE SILENT GRAPH g:made")["form"]), ("empty", u("")["form"])]
    return told(spark, rows)


@operator(
    "upd08_add_move_copy",
    """SELECT 'urn:g:0' AS g, count(*) AS n FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'urn:g:sum', count(*) FROM nation WHERE n_regionkey < 2
    UNION ALL SELECT 'urn:g:moved', count(*) FROM nation WHERE n_regionkey = 1""",
)
def _add_move_copy(spark, sf_dir):
    s = _regions(spark, sf_dir)
    s.update(RDF_PREFIX + "ADD g:0 TO g:sum ; ADD g:1 TO g:sum ; MOVE g:1 TO g:moved ; COPY g:sum TO g:0 ; COPY g:moved TO g:away ; DROP GRAPH g:away ; "
             "DELETE { GRAPH g:0 { ?x c:n_name ?m } } WHERE { GRAPH g:moved { ?x c:n_name ?m } }")
    return s.sparql("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?x ?p ?m } } GROUP BY ?g", {"n": "long"})


@operator("obs01_stats", told_sql(("queries", 2), ("updates", 1), ("graphs", 1), ("quads", "(SELECT count(*) FROM region) + 1"), ("filter_clauses_dropped", 0), ("plan_cache", 1), ("version", "'True'")))
def _stats(spark, sf_dir):
    s = _store(spark, sf_dir, ["r_name"])
    s.sparql(_ALL)
    s.sparql(_ALL)
    s.update("INSERT DATA { <urn:x:a> <urn:x:b> 1 }")
    t = s.stats()
    return told(spark, [(k, t[k]) for k in ("queries", "updates", "graphs", "quads", "filter_clauses_dropped", "plan_cache")] + [("version", s.build_id().startswith(s.version() + "+"))])


# reasoning


def _reasoned(spark, sf_dir, columns, turtle, profile="owl-rl") -> GraphStore:
    s = _store(spark, sf_dir, columns)
    s.parse_turtle(TURTLE + turtle)
    s.materialize(0, profile)
    return s


@operator(
    "inf02_hierarchies",
    """SELECT 'urn:x:' || x AS x, 'urn:x:' || y AS y FROM (VALUES ('a','b'),('a','c'),('a','d'),('b','c'),('b','d'),('c','d'),('p','q'),('p','r'),('q','r')) t(x, y)""",
)
def _hierarchies(spark, sf_dir):
    s = _reasoned(spark, sf_dir, ["r_name"], "x:a rdfs:subClassOf x:b . x:b rdfs:subClassOf x:c . x:c rdfs:subClassOf x:d . x:p rdfs:subPropertyOf x:q . x:q rdfs:subPropertyOf x:r .", "rdfs")
    return s.sparql(RDF_PREFIX + "SELECT ?x ?y { { ?x rdfs:subClassOf ?y } UNION { ?x rdfs:subPropertyOf ?y } }")


@operator(
    "inf07_statistics",
    told_sql(
        ("base_triples", "(SELECT count(*) FROM supplier) + 2"), ("inferred_triples_written", "(SELECT count(*) FROM supplier) + (SELECT count(DISTINCT s_nationkey) FROM supplier)"),
        ("previous_inferred_dropped", 0), ("axiomatic", 0), ("again", "(SELECT count(*) FROM supplier) + (SELECT count(DISTINCT s_nationkey) FROM supplier)"), ("within owl-rl", "'True'"), ("base kept", "'True'"),
    ),
)
def _inference_stats(spark, sf_dir):
    """Only what follows from the data is written: no axioms of RDF itself; rdfs is part of owl-rl."""
    s = _store(spark, sf_dir, ["s_nationkey"])
    s.parse_turtle(TURTLE + "c:s_nationkey rdfs:domain x:Vendor ; rdfs:range x:Place .")
    base = s.partitioned_digest(0)
    r = s.materialize(0, "rdfs")
    rows = [(k, r[k]) for k in ("base_triples", "inferred_triples_written", "previous_inferred_dropped")]
    rows.append(("axiomatic", s.sparql(RDF_PREFIX + f"SELECT * {{ ?x a <{T.RDFS}Resource> }}").count()))
    small = stage(s.quads.where("inferred").select("s", "p", "o"), "rdfs")
    r = s.materialize(0, "owl-rl")
    rows.append(("again", r["previous_inferred_dropped"]))
    rows.append(("within owl-rl", small.join(s.quads, ["s", "p", "o"], "left_anti").isEmpty()))
    rows.append(("base kept", s.partitioned_digest(0) == base))
    return told(spark, rows)


@operator("inf08_inverse_symmetric", "SELECT 'urn:t:nation:' || s_nationkey AS a, 'urn:t:supplier:' || s_suppkey AS b FROM supplier UNION ALL SELECT 'urn:t:region:' || n_regionkey, 'urn:t:nation:' || n_nationkey FROM nation")
def _inverse(spark, sf_dir):
    s = _reasoned(spark, sf_dir, ["s_nationkey", "n_regionkey"], "x:homeOf owl:inverseOf c:s_nationkey . c:n_regionkey a owl:SymmetricProperty .")
    return s.sparql(RDF_PREFIX + 'SELECT ?a ?b { { ?a x:homeOf ?b } UNION { ?a c:n_regionkey ?b FILTER(STRSTARTS(STR(?a), "urn:t:region")) } }')


@operator(
    "inf08_functional_same",
    """SELECT 'urn:t:supplier:' || a.s_suppkey AS a, 'urn:t:supplier:' || b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey
    AND a.s_suppkey <> b.s_suppkey WHERE a.s_nationkey < 3""",
)
def _functional(spark, sf_dir):
    """Suppliers of one of the first three nations are the same, as their nation can have one only."""
    s = _store(spark, sf_dir, ["s_nationkey"])
    s.update(RDF_PREFIX + "INSERT { ?n x:only ?s } WHERE { ?s c:s_nationkey ?n FILTER(?n IN (<urn:t:nation:0>, <urn:t:nation:1>, <urn:t:nation:2>)) }")
    s.parse_turtle(TURTLE + "x:only a owl:FunctionalProperty .")
    s.materialize(0, "owl-rl")
    return s.sparql(RDF_PREFIX + "SELECT ?a ?b { ?a owl:sameAs ?b }")


@operator("inf08_inverse_functional_same", "SELECT 'urn:y:' || a.n_nationkey AS a, 'urn:c:n_name' AS p, a.n_name AS o FROM nation a")
def _inverse_functional(spark, sf_dir):
    """Another node with a nation's name is that nation, and has all that it has."""
    s = _store(spark, sf_dir, ["n_name"])
    s.update(RDF_PREFIX + 'INSERT { ?y x:code ?m . ?x x:code ?m } WHERE { ?x c:n_name ?m BIND(IRI(REPLACE(STR(?x), "urn:t:nation", "urn:y")) AS ?y) }')
    s.parse_turtle(TURTLE + "x:code a owl:InverseFunctionalProperty .")
    s.materialize(0, "owl-rl")
    return s.sparql(RDF_PREFIX + 'SELECT ?a ?p ?o { ?a ?p ?o FILTER(STRSTARTS(STR(?a), "urn:y:") && ?p = c:n_name) }')


@operator("inf08_chain", "SELECT 'urn:t:supplier:' || s_suppkey AS a, 'urn:t:region:' || n_regionkey AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _chain(spark, sf_dir):
    s = _reasoned(spark, sf_dir, ["s_nationkey", "n_regionkey"], "x:inRegion owl:propertyChainAxiom ( c:s_nationkey c:n_regionkey ) .")
    return s.sparql(RDF_PREFIX + "SELECT ?a ?b { ?a x:inRegion ?b }")


@operator(
    "inf08_restrictions",
    """SELECT 'urn:x:Asian' AS t, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'urn:x:HasPlace', count(*) FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'urn:x:Either', count(*) FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 'urn:x:Both', count(*) FROM nation WHERE n_regionkey = 2
    UNION ALL SELECT 'urn:x:Region', 1""",
)
def _restrictions(spark, sf_dir):
    s = _reasoned(
        spark, sf_dir, ["n_regionkey", "n_name"],
        """x:Asian owl:onProperty c:n_regionkey ; owl:hasValue <urn:t:region:2> . x:HasPlace owl:onProperty c:n_regionkey ; owl:someValuesFrom x:Place . <urn:t:region:1> a x:Place .
        x:Either owl:unionOf ( x:Asian x:HasPlace ) . x:Both owl:intersectionOf ( x:Asian x:Named ) . x:Named owl:onProperty c:n_name ; owl:someValuesFrom owl:Thing .
        x:Asian rdfs:subClassOf [ owl:onProperty c:n_regionkey ; owl:allValuesFrom x:Region ] .""",
    )
    return s.sparql(RDF_PREFIX + "SELECT ?t (COUNT(DISTINCT ?x) AS ?n) { ?x a ?t FILTER(?t IN (x:Asian, x:HasPlace, x:Either, x:Both, x:Region)) } GROUP BY ?t", {"n": "long"})


# validation

_SHAPES = """
x:S a sh:NodeShape ; sh:targetSubjectsOf c:c_name ; sh:property x:pBal, x:pName, x:pSeg, x:pNation, x:pKind, x:pValue, x:pQual, x:pEq, x:pDis ; sh:not x:Rich ; sh:or ( x:Rich x:Poor ) ; sh:and ( x:Named x:Rich ) ;
  sh:closed true ; sh:ignoredProperties ( c:c_nationkey c:c_mktsegment ) .
x:pBal sh:path c:c_acctbal ; sh:datatype xsd:decimal ; sh:maxExclusive 9000 ; sh:minExclusive -900 .
x:pName sh:path c:c_name ; sh:pattern "[0-4]$" ; sh:minLength 19 ; sh:maxLength 18 ; sh:nodeKind sh:IRI .
x:pSeg sh:path c:c_mktsegment ; sh:in ( "BUILDING" "MACHINERY" ) .
x:pNation sh:path c:c_nationkey ; sh:class x:Nation .
x:pKind sh:path c:c_nationkey ; sh:nodeKind sh:IRI .
x:pValue sh:path c:c_nationkey ; sh:hasValue <urn:t:nation:3> .
x:pQual sh:path c:c_nationkey ; sh:qualifiedValueShape [ sh:class x:Nation ] ; sh:qualifiedMinCount 1 .
x:pEq sh:path c:c_name ; sh:equals c:c_mktsegment .
x:pDis sh:path c:c_name ; sh:disjoint c:c_name .
x:Rich sh:property [ sh:path c:c_acctbal ; sh:minInclusive 8000 ] .
x:Poor sh:property [ sh:path c:c_acctbal ; sh:maxInclusive 0 ] .
x:Named sh:property [ sh:path c:c_name ; sh:minCount 1 ] .
"""
_CASES = (
    ("Datatype", "true"), ("MaxExclusive", "c_acctbal >= 9000"), ("MinExclusive", "c_acctbal <= -900"), ("Pattern", "NOT regexp_matches(c_name, '[0-4]$')"), ("MinLength", "length(c_name) < 19"),
    ("MaxLength", "length(c_name) > 18"), ("NodeKind", "true"), ("In", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"), ("Class", "c_nationkey >= 10"), ("HasValue", "c_nationkey <> 3"),
    ("QualifiedMinCount", "c_nationkey >= 10"), ("Disjoint", "true"), ("Not", "c_acctbal >= 8000"), ("Or", "c_acctbal > 0 AND c_acctbal < 8000"), ("And", "c_acctbal < 8000"),
    ("Closed", "c_custkey % 7 = 0"),
)


@operator(
    "sh08_components",
    " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS component, count(*) AS n FROM customer WHERE {w}) WHERE n > 0" for k, w in _CASES)
    + " UNION ALL SELECT 'Equals', 2 * count(*) FROM customer",
)
def _components(spark, sf_dir):
    s = _store(spark, sf_dir, ["c_name", "c_acctbal", "c_mktsegment", "c_nationkey"])
    types = "".join(f"<urn:t:nation:{i}> a x:Nation .\n" for i in range(5)) + "".join(f"<urn:t:nation:{i}> a x:Small .\n" for i in range(5, 10)) + "x:Small rdfs:subClassOf x:Nation ."
    s.parse_turtle(TURTLE + types)
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 7 = 0")
    s.put_quads(with_ids(keys.select(F.lit(T.IRI).alias("s__k"), F.concat(F.lit("urn:t:customer:"), F.col("c_custkey")).alias("s__x"), F.lit("urn:x:odd").alias("p__x"), F.lit(T.IRI).alias("o__k"),
                                     F.lit("urn:x:yes").alias("o__x"), F.lit("").alias("o__d"), F.lit("").alias("o__l"), F.lit(0).cast("long").alias("g"))), 0)
    s.parse_turtle(TURTLE + _SHAPES.replace("sh:closed true", "sh:closed true ; sh:property [ sh:path c:c_name ] , [ sh:path c:c_acctbal ]"), 9)
    report = s.validate(0, 9, collect=False)["report"]
    component = F.regexp_extract("sourceConstraintComponent", r"#(.*)ConstraintComponent", 1)
    return report.groupBy(component.alias("component")).agg(F.count(F.lit(1)).alias("n"))


@operator(
    "sh06_targets_and_severities",
    """SELECT 'urn:x:C' AS shape, 'Warning' AS severity, count(*) AS n FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 'urn:x:N', 'Violation', 1
    UNION ALL SELECT 'urn:x:O', 'Info', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'urn:x:Q', 'Violation', count(*) FROM nation WHERE n_regionkey = 1""",
)
def _targets(spark, sf_dir):
    """Targets by class (through an inferred type), node and object, a SELECT constraint; a deactivated shape says nothing."""
    s = _store(spark, sf_dir, ["n_name", "n_regionkey"])
    s.parse_turtle(TURTLE + "".join(f"<urn:t:nation:{i}> x:small true .\n" for i in range(4)) + "x:small rdfs:domain x:Small .")
    s.materialize(0, "rdfs")
    s.parse_turtle(
        TURTLE + """x:C a sh:NodeShape ; sh:targetClass x:Small ; sh:severity sh:Warning ; sh:nodeKind sh:Literal . x:N a sh:NodeShape ; sh:targetNode <urn:t:nation:7> ; sh:nodeKind sh:Literal .
        x:O a sh:NodeShape ; sh:targetObjectsOf c:n_regionkey ; sh:severity sh:Info ; sh:nodeKind sh:Literal .
        x:Q a sh:NodeShape ; sh:targetSubjectsOf c:n_name ; sh:sparql [ sh:select "SELECT $this WHERE { $this <urn:c:n_regionkey> <urn:t:region:1> }" ] .
        x:Off a sh:NodeShape ; sh:deactivated true ; sh:targetSubjectsOf c:n_name ; sh:nodeKind sh:Literal .""", 9,
    )
    report = s.validate(0, 9, "full", collect=False)["report"]
    return report.groupBy(F.col("sourceShape").alias("shape"), F.col("resultSeverity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@operator("sh02_envelope", told_sql(("conforms", "'False'"), ("results", "(SELECT count(*) FROM region)"), ("warned", 1), ("unevaluated", "'ValidationError'"), ("in band", "'True'"), ("core only", "'True'"), ("mode", "'full'")))
def _envelope(spark, sf_dir):
    s = _store(spark, sf_dir, ["r_name"])
    shape = 'x:S a sh:NodeShape ; sh:targetSubjectsOf c:r_name ; sh:sparql [ sh:select "SELECT $this WHERE { $this <urn:c:r_name> ?n }" ] .'
    s.parse_turtle(TURTLE + shape, 9)
    s.parse_turtle(TURTLE + shape.replace("sh:sparql", "sh:unknownThing 3 ; sh:sparql"), 8)
    s.copy_graph(9, 0)
    r = s.validate(0, 0, "full", collect=True)
    rows = [("conforms", r["conforms"]), ("results", len(r["results"])), ("warned", len(r["warnings"]))]
    try:
        s.validate(0, 8, "full")
    except ValueError as e:
        rows.append(("unevaluated", type(e).__name__))
    rows += [("in band", "unknownThing" in s.validate(0, 8, "full", strict=False)["error"]), ("core only", s.validate(0, 9, "core")["conforms"]), ("mode", r["mode"])]
    return told(spark, rows)
