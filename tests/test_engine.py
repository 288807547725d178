import pytest

from loomgraph import terms as T
from loomgraph.engine import GraphError, GraphStore, Locked
from loomgraph.operators.paths import PathTruncated
from loomgraph.plans.algebra import SparqlError

PRE = "PREFIX : <http://x/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> "
TTL = "@prefix : <http://x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\n"


def store(spark, ttl, **settings):
    s = GraphStore(spark, **settings)
    s.parse_turtle(TTL + ttl)
    return s


def rows(df):
    return sorted(tuple(r) for r in df.collect())


BOATS = """
:k1 :label "Heron" ; :draft 3 ; :tows :k2 . :k2 :label "Ibis"@da ; :draft 7 ; :tows :k3 . :k3 :label "Jay" ; :draft 11 ; :berth "pier 4" .
:k4 :draft "shallow" ; :label "Kite" . :k5 :draft 8.25 . :k6 :draft 19 .
"""


@pytest.fixture(scope="module")
def boats(spark):
    return store(spark, BOATS)


def test_bgp_filter_optional_minus_union(boats):
    q = lambda t: boats.sparql(PRE + t)
    assert rows(q("SELECT ?n { ?x :tows ?y . ?y :label ?n }")) == [("Ibis",), ("Jay",)]
    assert q("SELECT * { ?x :draft ?a FILTER(?a > 4) }").count() == 4
    assert q("SELECT * { ?x :draft ?a FILTER(?a >= 7 && ?a <= 11) }").count() == 3
    got = {tuple(r) for r in q("SELECT ?n ?m { ?x :label ?n OPTIONAL { ?x :berth ?m } }").collect()}
    assert got == {("Heron", None), ("Ibis", None), ("Jay", "pier 4"), ("Kite", None)}
    assert q("SELECT ?x { ?x :label ?n MINUS { ?x :berth ?m } }").count() == 3
    assert q("SELECT ?x { ?x :label ?n MINUS { ?q :berth ?m } }").count() == 4
    assert q("SELECT ?x { { ?x :berth ?m } UNION { ?x :label ?n } }").count() == 5
    assert rows(q('SELECT ?x { ?x :label ?n FILTER(LANG(?n) = "da") }')) == [("http://x/k2",)]
    assert rows(q("SELECT ?x { ?x :label ?n FILTER NOT EXISTS { ?x :draft ?a FILTER(?a < 10) } }")) == [("http://x/k3",), ("http://x/k4",)]
    assert rows(q("SELECT ?x { ?x :label ?n FILTER EXISTS { ?x :berth ?m } }")) == [("http://x/k3",)]
    assert rows(q('SELECT ?x { VALUES (?x ?n) { (:k1 UNDEF) (:k2 "Heron") } ?x :label ?n }')) == [("http://x/k1",)]
    assert rows(q("SELECT ?n { ?x :draft ?a OPTIONAL { ?x :berth ?m } OPTIONAL { ?x :label ?n } FILTER(BOUND(?m)) }")) == [("Jay",)]


def test_unbound_join(boats):
    got = rows(boats.sparql(PRE + "SELECT ?x ?m ?k { { ?x :label ?n OPTIONAL { ?x :berth ?m } } { ?k :berth ?m } }"))
    assert len(got) == 4


SIDES = ":a :p 1 ; :q 1 . :b :p 2 . :c :q 3 . :d :r 1 . :e :r 2 . :f :s 1 ; :t 9 . :g :s 2 ."


def test_nullable_joins(spark):
    """OPTIONAL, MINUS and EXISTS over variables that either side may leave unbound, against the definition."""
    s = store(spark, SIDES)
    left = "{ ?x :p ?v } UNION { ?x :q ?w }"
    right = "{ ?y :s ?v } UNION { ?y :r ?w } UNION { ?y :t ?u }"
    solve = lambda t: [{k: v for k, v in r.asDict().items() if v is not None} for r in s.sparql(PRE + t).collect()]
    bag = lambda xs: sorted(tuple(sorted(x.items())) for x in xs)
    ls, rs = solve(f"SELECT ?x ?v ?w {{ {left} }}"), solve(f"SELECT ?y ?v ?w ?u {{ {right} }}")
    fits = lambda a, b: all(a[k] == b[k] for k in a.keys() & b.keys())
    want = [a | b for a in ls for b in rs if fits(a, b)] + [a for a in ls if not any(fits(a, b) for b in rs)]
    assert bag(solve(f"SELECT * {{ {{ {left} }} OPTIONAL {{ {right} }} }}")) == bag(want)
    want = [a for a in ls if not any(fits(a, b) and a.keys() & b.keys() for b in rs)]
    assert bag(solve(f"SELECT * {{ {{ {left} }} MINUS {{ {right} }} }}")) == bag(want) and len(want) < len(ls)
    few = "{ ?y :s ?v } UNION { ?y :r ?v . ?y :s ?w }"
    fs = solve(f"SELECT ?y ?v ?w {{ {few} }}")
    for word, keep in (("EXISTS", True), ("NOT EXISTS", False)):
        want = [a for a in ls if any(fits(a, b) for b in fs) == keep]
        assert bag(solve(f"SELECT * {{ {{ {left} }} FILTER {word} {{ {few} }} }}")) == bag(want)


def test_chained_optional_hashes(spark):
    s = store(spark, SIDES)
    text = PRE + "SELECT * { ?x :p ?o OPTIONAL { ?x :q ?v } OPTIONAL { ?x :t ?w . ?x :s ?v } }"
    s.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "NestedLoop" not in s.explain(text) and "Cartesian" not in s.explain(text)
    finally:
        s.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expressions(boats):
    q = lambda e: boats.sparql(PRE + f"SELECT ({e} AS ?r) {{ ?x :berth ?m . ?x :draft ?a . ?x :label ?n }}").collect()[0][0]
    cases = {
        "?a + 1": "12", "?a / 2": "5.5", "?a / 0": None, "-?a": "-11", "ROUND(-2.5)": "-2", "ABS(-3)": "3", "CEIL(2.1)": "3", "FLOOR(-2.1)": "-3",
        "STRLEN(?n)": "3", "UCASE(?n)": "JAY", 'CONCAT(?n, "-", ?m)': "Jay-pier 4", 'CONTAINS(?n, "a")': "true", 'STRSTARTS(?n, "x")': "false",
        'IF(?a > 10, "deep", "shoal")': "deep", "IF(?n > 1, 1, 2)": None, "COALESCE(?zz, 3)": "3", "DATATYPE(?a)": T.INTEGER, 'SUBSTR("abcde", 2, 3)': "bcd",
        'STRBEFORE("abc", "b")': "a", 'STRAFTER("abc", "b")': "c", 'REPLACE("abc", "b", "x")': "axc", 'REGEX(?n, "^j", "i")': "true", "isNumeric(?a)": "true",
        "?a IN (10, 11)": "true", "?a NOT IN (10, 11)": "false", '"1"^^xsd:integer = "01"^^xsd:integer': "false", "?a + 1 = 12": "true", "sameTerm(?a, 11)": "true",
        'YEAR("2020-03-04T05:06:07Z"^^xsd:dateTime)': "2020", 'ENCODE_FOR_URI("a b")': "a%20b", "xsd:integer(\"7\")": "7", "1.0 + 2": "3",
        # exact integers and decimals
        "9007199254740993 + 0": "9007199254740993", "9007199254740993 > 9007199254740992": "true", "9007199254740992 >= 9007199254740993": "false",
        "0.1 + 0.2": "0.3", "0.1 + 0.2 = 0.3": "true", "1.1 * 1.1": "1.21", "9007199254740993 - 1 = 9007199254740992": "true", "ABS(-9007199254740993)": "9007199254740993",
        "1e0 + 1": "2", "2 < 1e1": "true", "xsd:integer(9007199254740993)": "9007199254740993",
        # fields of a date as written
        'HOURS("2020-01-02T10:00:00+05:00"^^xsd:dateTime)': "10", 'DAY("2020-01-02T23:30:00-05:00"^^xsd:dateTime)': "2", 'SECONDS("2020-01-02T23:30:07.25Z"^^xsd:dateTime)': "7.25",
        'MONTH("2020-11-02"^^xsd:date)': "11", 'MINUTES("nonsense"^^xsd:dateTime)': None,
    }
    for e, want in cases.items():
        assert q(e) == want, e


def test_exact_aggregates(spark):
    s = store(spark, ":a :n 9007199254740993, 9007199254740992 . :b :n 0.1, 0.2 . :c :n 1, 2.5e0 .")
    got = rows(s.sparql(PRE + "SELECT ?x (SUM(?n) AS ?s) (MAX(?n) AS ?m) (AVG(?n) AS ?a) { ?x :n ?n } GROUP BY ?x"))
    assert got == [
        ("http://x/a", "18014398509481985", "9007199254740993", "9007199254740992.5"), ("http://x/b", "0.3", "0.2", "0.15"), ("http://x/c", "3.5", "2.5e0", "1.75"),
    ]
    assert [r[0] for r in s.sparql(PRE + "SELECT ?n { :a :n ?n FILTER(?n > 9007199254740992) }").collect()] == ["9007199254740993"]
    assert [r[0] for r in s.sparql(PRE + "SELECT ?n { :a :n ?n } ORDER BY DESC(?n)").collect()] == ["9007199254740993", "9007199254740992"]
    assert s.sparql(PRE + "SELECT (APPROX_COUNT_DISTINCT(?n) AS ?k) { ?x :n ?n }").collect()[0][0] == "6"


def test_registered_function(boats):
    from pyspark.sql import functions as F

    boats.register_function("http://x/turned", lambda x: F.reverse(x))
    assert rows(boats.sparql(PRE + "SELECT (:turned(?n) AS ?r) { ?x :berth ?m ; :label ?n }")) == [("yaJ",)]
    with pytest.raises(SparqlError):
        boats.sparql(PRE + "SELECT (:unknown(?n) AS ?r) { ?x :label ?n }")


def test_aggregates(boats):
    q = lambda t: rows(boats.sparql(PRE + t))
    assert q("SELECT (COUNT(*) AS ?n) (SUM(?a) AS ?s) (MIN(?a) AS ?l) (MAX(?a) AS ?h) { ?x :draft ?a }") == [("6", "48.25", "3", "19")]
    assert q("SELECT (AVG(?a) AS ?m) { ?x :draft ?a FILTER(isNumeric(?a)) }") == [("9.65",)]
    assert q("SELECT (COUNT(?m) AS ?n) { ?x :draft ?a OPTIONAL { ?x :berth ?m } }") == [("1",)]
    assert q("SELECT ?p (COUNT(DISTINCT ?s) AS ?n) { ?s ?p ?o } GROUP BY ?p HAVING (COUNT(*) > 2)") == [("http://x/draft", "6"), ("http://x/label", "4")]
    assert q("SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p HAVING (?n < 2)") == [("http://x/berth", "1")]
    assert q('SELECT (GROUP_CONCAT(?n; SEPARATOR=",") AS ?l) { ?x :label ?n }') == [("Heron,Ibis,Jay,Kite",)]
    assert q("SELECT (COUNT(*) AS ?n) { ?x :nothing ?y }") == [("0",)]


def test_order_limit_distinct(boats):
    q = lambda t: [r[0] for r in boats.sparql(PRE + t).collect()]
    assert q("SELECT ?a { ?x :draft ?a } ORDER BY ?a") == ["3", "7", "8.25", "11", "19", "shallow"]
    assert q("SELECT ?a { ?x :draft ?a } ORDER BY DESC(?a) LIMIT 2 OFFSET 1") == ["19", "11"]
    assert q("SELECT ?n { ?x :label ?n . ?x :draft ?a } ORDER BY DESC(?a)")[0] == "Kite"
    assert len(q("SELECT DISTINCT ?p { ?s ?p ?o }")) == 4
    with pytest.raises(SparqlError):
        q("SELECT DISTINCT ?n { ?x :label ?n ; :draft ?a } ORDER BY ?a")


def test_case_of_variables(boats):
    assert rows(boats.sparql(PRE + "SELECT ?n ?N { ?x :berth ?n ; :label ?N }")) == [("pier 4", "Jay")]


def test_forms(boats):
    assert boats.sparql(PRE + "ASK { :k1 :tows :k2 }").collect()[0][0] == "true"
    assert boats.sparql(PRE + "ASK { :k2 :tows :k1 }").collect()[0][0] == "false"
    got = boats.construct(PRE + "CONSTRUCT { ?x :line _:f . _:f :of ?y } WHERE { ?x :tows ?y }")
    assert got.count() == 4
    assert len({r.object["value"] for r in got.where("predicate.value = 'http://x/line'").collect()}) == 2
    assert boats.construct(PRE + "CONSTRUCT WHERE { ?x :berth ?m }").count() == 1
    with pytest.raises(SparqlError):
        boats.construct(PRE + "CONSTRUCT { ?x :y ?zz } WHERE { ?x :berth ?m }")
    with pytest.raises(SparqlError):
        boats.sparql("SELECT ?x { ?x ?p }")
    assert boats.sparql_parse(PRE + "SELECT ?x { ?x :p/:q ?y }")["form"] == "SELECT"


def test_datasets(spark):
    s = GraphStore(spark)
    s.update(PRE + "INSERT DATA { GRAPH :g1 { :a :p 1 } GRAPH :g2 { :a :p 1 . :b :p 2 } GRAPH :g3 { :c :p 3 } }")
    q = lambda clauses, body: [r[0][-1] for r in s.sparql(PRE + f"SELECT ?r {clauses} {{ {body} }}").collect()]
    assert sorted(q("FROM :g1 FROM :g2", "?r :p ?o")) == ["a", "b"]
    assert q("FROM :g1 FROM NAMED :g2", "GRAPH ?r { :a :p ?o }") == ["2"]
    assert q("FROM :g1", "GRAPH ?r { ?s :p ?o }") == []
    assert q("FROM NAMED :g2", "?r :p ?o") == []
    assert q("FROM NAMED :g2", "GRAPH :g1 { ?r :p ?o }") == []
    assert sorted(q("FROM NAMED :g2 FROM NAMED :g3", "GRAPH ?g { ?r :p ?o FILTER(?o > 1) }")) == ["b", "c"]
    assert q("FROM NAMED :g2", "GRAPH :g2 { ?r :p 2 }") == ["b"]
    assert q("FROM :none", "?r :p ?o") == []


def test_describe(spark):
    s = store(spark, ":r :p [ :q [ :v \"leaf\" ] ] . :z :p :r .")
    assert s.describe("DESCRIBE <http://x/r>").count() == 3


def chain(spark, **settings):
    return store(spark, " ".join(f":c{i} :sub :c{i + 1} ." for i in range(1, 11)), **settings)


def test_paths(spark):
    s = chain(spark)
    n = lambda p: s.sparql(PRE + f"SELECT * {{ {p} }}").count()
    assert n("?x :sub+ :c11") == 10
    assert n("?x :sub* :c11") == 11
    assert rows(s.sparql(PRE + "SELECT ?o { :c1 :sub? ?o }")) == [("http://x/c1",), ("http://x/c2",)]
    assert n(":c1 :sub/:sub ?x") == 1
    assert n("?x ^:sub :c1") == 1
    assert n("?x !(:other) ?y") == 10
    assert n("?x (:sub|^:sub) ?y") == 20
    assert n("?x :sub+ ?y") == 55
    assert n(":nowhere :sub* ?y") == 1
    assert n("?x (:sub/:sub)+ :c11") == 5


def test_path_limit(spark):
    s = chain(spark, max_depth=3, on_truncation="count")
    assert rows(s.sparql(PRE + "SELECT ?o { :c1 :sub+ ?o }")) == [("http://x/c2",), ("http://x/c3",), ("http://x/c4",)]
    assert s.stats()["path_depth_truncations"] == 1
    s.paths.configure(3, "error")
    with pytest.raises(PathTruncated):
        s.sparql(PRE + "SELECT ?o { :c1 :sub+ ?o }")


def test_distributed_closure(spark, monkeypatch):
    from loomgraph.operators import closure

    monkeypatch.setattr(closure, "DRIVER_EDGES", 0)
    s = store(spark, ":a :p :b . :b :p :c . :c :p :a . :c :p :d .")
    assert s.sparql(PRE + "SELECT * { ?x :p+ ?y }").count() == 12
    assert s.sparql(PRE + "SELECT * { :a :p+ ?y }").count() == 4
    assert s.sparql(PRE + "SELECT * { ?y :p+ :d }").count() == 3


def test_graphs_and_updates(spark):
    s = GraphStore(spark)
    u = s.update(PRE + 'INSERT DATA { :a :p 1 . GRAPH :g1 { :a :p 1 . :b :p 2 } GRAPH :g2 { :b :q "x" } }')
    assert (u["triples_inserted"], u["form"]) == (4, "INSERT_DATA")
    assert s.sparql(PRE + "SELECT * { ?s :p ?o }").count() == 3
    assert rows(s.sparql(PRE + "SELECT ?g ?s { GRAPH ?g { ?s :p ?o } }")) == [("http://x/g1", "http://x/a"), ("http://x/g1", "http://x/b")]
    assert rows(s.sparql(PRE + "SELECT ?g { GRAPH ?g { ?s :p 2 } GRAPH ?g { ?t :p 1 } }")) == [("http://x/g1",)]
    assert s.sparql(PRE + "SELECT * { GRAPH :none { ?s ?p ?o } }").count() == 0
    assert rows(s.sparql(PRE + "SELECT ?s { GRAPH :g1 { ?s :p ?o } MINUS { GRAPH ?g { ?s :q ?z } } }")) == [("http://x/a",)]
    u = s.update(PRE + "WITH :g1 DELETE { ?s :p ?o } INSERT { ?s :r ?o } WHERE { ?s :p ?o }")
    assert (u["triples_inserted"], u["triples_deleted"]) == (2, 2)
    assert s.update(PRE + "DELETE DATA { :zz :p 9 }")["triples_deleted"] == 0
    assert s.update(PRE + "DELETE WHERE { GRAPH :g1 { ?s :r 1 } }")["triples_deleted"] == 1
    assert s.copy_graph("http://x/g1", "http://x/g3") == 1
    with pytest.raises(GraphError):
        s.drop_graph(0)
    s.lock_graph("http://x/g3", "audit")
    with pytest.raises(Locked):
        s.update(PRE + "INSERT DATA { GRAPH :g3 { :x :y :z } }")
    s.unlock_graph("http://x/g3")
    assert s.drop_graph("http://x/g3") == 1
    assert s.update(PRE + "MOVE :g2 TO :g5 ; CLEAR ALL")["form"] == "MIXED"
    assert s.stats()["quads"] == 0


def test_carve(spark):
    s = chain(spark)
    got = s.carve_graph(0, "http://x/ball", seeds=["http://x/c5"], max_hops=2)
    assert got == {"quads": 4, "boundary": 2}
    assert s.carve_graph(0, 9, predicate="http://x/none")["quads"] == 0
    assert s.graph_iri(9) is None


def inferred(s, graph=0):
    got = s.quads.where("inferred").where(f"g = {graph}").select("s__x", "p__x", "o__x").collect()
    return {tuple(x.removeprefix("http://x/").removeprefix(T.RDFS).removeprefix(T.OWL).replace(T.TYPE, "a") for x in t) for t in got}


def test_rdfs(spark):
    s = store(spark, """:Sloop rdfs:subClassOf :Boat . :Boat rdfs:subClassOf :Vessel . :moors rdfs:subPropertyOf :touches ; rdfs:range :Quay .
      :teal a :Sloop ; :moors :east . :touches rdfs:domain :Floating . :Floating rdfs:subClassOf :Thing . :wet rdfs:range :Water . :teal :wet "no" .""")
    r = s.materialize(0, "rdfs")
    assert inferred(s) == {
        ("Sloop", "subClassOf", "Vessel"), ("teal", "a", "Boat"), ("teal", "a", "Vessel"), ("teal", "touches", "east"), ("east", "a", "Quay"),
        ("teal", "a", "Floating"), ("teal", "a", "Thing"),
    }
    assert r["inferred_triples_written"] == 7 and s.materialize(0, "rdfs")["previous_inferred_dropped"] == 7
    small = inferred(s)
    s.materialize(0, "owl-rl")
    assert small <= inferred(s)
    with pytest.raises(GraphError):
        s.materialize(0, "none")


def test_rdfs_over_schema_predicates(spark):
    """A sub-property of rdf:type or rdfs:subClassOf makes axioms, so one pass is not enough."""
    s = store(spark, """:kind rdfs:subPropertyOf <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> . :under rdfs:subPropertyOf rdfs:subClassOf .
      :x :kind :A . :A :under :B . :B :under :C . :loop1 rdfs:subClassOf :loop2 . :loop2 rdfs:subClassOf :loop1 .""")
    s.materialize(0, "rdfs")
    got = inferred(s)
    assert {("x", "a", "A"), ("x", "a", "B"), ("x", "a", "C"), ("A", "subClassOf", "C")} <= got
    assert rows(s.sparql(PRE + "SELECT ?y { :loop1 rdfs:subClassOf+ ?y }")) == [("http://x/loop1",), ("http://x/loop2",)]


def test_closure_of_graphs_not_materialised(spark):
    s = store(spark, ":a rdfs:subClassOf :b . :b rdfs:subClassOf :c .")
    s.parse_turtle(TTL + ":x rdfs:subClassOf :y . :y rdfs:subClassOf :z .", 1)
    s.materialize(0, "rdfs")
    n = lambda p: s.sparql(PRE + f"SELECT * {{ {p} }}").count()
    assert n("?p rdfs:subClassOf+ ?q") == 6
    assert n("GRAPH ?g { ?p rdfs:subClassOf+ ?q }") == 3
    s.materialize(1, "rdfs")
    assert n("GRAPH ?g { ?p rdfs:subClassOf+ ?q }") == 3
    s.update(PRE + "INSERT DATA { GRAPH <urn:graph:1> { :z rdfs:subClassOf :last } }")
    assert n("GRAPH ?g { ?p rdfs:subClassOf+ ?q }") == 6


def test_owl(spark):
    s = store(spark, """:owns owl:inverseOf :ownedBy . :near a owl:SymmetricProperty . :in a owl:TransitiveProperty . :id a owl:InverseFunctionalProperty .
      :o :owns :s . :p :near :q . :a :in :b . :b :in :c . :c :in :d . :u :id "1" . :v :id "1" . :u :likes :w .
      :gp owl:propertyChainAxiom ( :par :par ) . :k :par :l . :l :par :m .
      :Chair owl:equivalentClass [ owl:intersectionOf ( :Person [ owl:onProperty :headOf ; owl:someValuesFrom :Dept ] ) ] .
      :z a :Person ; :headOf :dd . :dd a :Dept .
      :port a owl:FunctionalProperty . :ship :port :cork, :cobh . :cork :pop 5 . :ship :port "x" .
      :Even owl:equivalentClass :Paired . :e2 a :Paired . :far owl:equivalentProperty :distant . :e2 :far :e3 .
      :Red a owl:Restriction ; owl:onProperty :colour ; owl:hasValue "red" . :t1 a :Red . :t2 :colour "red" .
      :Zoo a owl:Restriction ; owl:onProperty :keeps ; owl:allValuesFrom :Animal . :z1 a :Zoo ; :keeps :lynx .
      :Pet owl:unionOf ( :Cat :Dog ) . :tom a :Cat .""")
    s.materialize(0, "owl-rl")
    ask = lambda t: s.sparql(PRE + f"PREFIX owl: <{T.OWL}> ASK {{ {t} }}").collect()[0][0]
    for t in (
        ":s :ownedBy :o", ":q :near :p", ":a :in :d", ":v :likes :w", ":k :gp :m", ":z a :Chair", ":u owl:sameAs :v", ":v owl:sameAs :u", ":cork owl:sameAs :cobh",
        ":cobh :pop 5", ":e2 a :Even", ":e2 :distant :e3", ':t1 :colour "red"', ":t2 a :Red", ":lynx a :Animal", ":tom a :Pet", ":Paired rdfs:subClassOf :Even",
    ):
        assert ask(t) == "true", t
    for t in (":p :ownedBy ?x", ":u owl:sameAs :u", ":w owl:sameAs ?x", ":ship :near ?x", ':x owl:sameAs "x"'):
        assert ask(t) == "false", t
    assert not s.quads.groupBy("s", "p", "o").count().where("count > 1").count()


def test_same_as_of_properties_and_classes(spark, monkeypatch):
    from loomgraph.operators import closure, inference

    text = ":p1 owl:sameAs :p2 . :a :p1 :b . :b owl:sameAs :c . :c owl:sameAs :d . :p2 rdfs:domain :Q . :A owl:sameAs :B . :i a :A ."
    found = []
    for edges, few in ((5000, 10_000), (0, 0)):
        monkeypatch.setattr(closure, "DRIVER_EDGES", edges)
        monkeypatch.setattr(inference, "FEW_ROWS", few)
        s = store(spark, text)
        s.materialize(0, "owl-rl")
        found.append(inferred(s))
    assert found[0] == found[1]
    assert {("a", "p2", "d"), ("a", "p1", "c"), ("a", "a", "Q"), ("d", "sameAs", "b"), ("i", "a", "B"), ("p2", "sameAs", "p1")} <= found[0]


def test_groups_of_equal_nodes(spark, monkeypatch):
    """Pairs are not stored; blocks, asserted pairs, updates and copies give what stored quads would."""
    from loomgraph.sources import segments

    names = [f"n{i}" for i in range(40)]
    text = " ".join(f":{names[0]} owl:sameAs :{x} ." for x in names[1:]) + " :x owl:sameAs :y . :y owl:sameAs :x . :n3 :p :y . :y owl:sameAs :y ."
    want = {(a, "sameAs", b) for a in names for b in names if a != b and a != "n0"} | {(a, "p", b) for a in names for b in "xy"} - {("n3", "p", "y")}
    monkeypatch.setattr(segments, "BLOCK", 7)
    monkeypatch.setattr(segments, "PAIRS", 100)
    monkeypatch.setattr(segments, "FEW_TOLD", 0)
    s = store(spark, text)
    told = s.materialize(0, "owl-rl")
    assert inferred(s) == want and told["inferred_triples_written"] == len(want) == s.quads.where("inferred").count()
    groups = [x for x in s.store.segments if x.groups]
    files = spark.read.parquet(f"{s.store.root}/seg={groups[0].name}/members")
    assert files.count() == len(names) + 2 < groups[0].rows == 40 * 39 - 39
    assert not s.quads.groupBy("s", "p", "o").count().where("count > 1").count()
    assert s.materialize(0, "owl-rl")["previous_inferred_dropped"] == len(want) and inferred(s) == want
    assert s.copy_graph(0, "http://x/copy") == s.count_quads(0)
    s.update(PRE + f"PREFIX owl: <{T.OWL}> DELETE DATA {{ :n5 owl:sameAs :n6 }}")
    assert inferred(s) == want - {("n5", "sameAs", "n6")} and not any(x.groups for x in s.store.segments)


def test_digest_and_integrity(spark):
    a = store(spark, ":s :p [ :q 1 ], [ :q 2 ] . :t :p \"x\\ny\" .")
    b = store(spark, ":t :p \"x\\ny\" . :s :p [ :q 2 ], [ :q 1 ] .")
    assert a.graph_digest() == b.graph_digest()
    assert a.graph_digest() != store(spark, ":s :p [ :q 1 ], [ :q 3 ] .").graph_digest()
    ring = store(spark, "_:a :p _:b . _:b :p _:c . _:c :p _:a .").graph_digest()
    assert ring == store(spark, "_:z :p _:x . _:y :p _:z . _:x :p _:y .").graph_digest()
    assert a.graph_integrity()["clean"]


SHAPES = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:S a sh:NodeShape ; sh:targetClass :P ; sh:property [ sh:path :name ; sh:minCount 1 ; sh:datatype xsd:string ; sh:minLength 2 ] ,
  [ sh:path :age ; sh:maxCount 1 ; sh:minInclusive 0 ] ; sh:property [ sh:path [ sh:inversePath :knows ] ; sh:class :P ] ;
  sh:or ( [ sh:property [ sh:path :age ; sh:minCount 1 ] ] [ sh:property [ sh:path :born ; sh:minCount 1 ] ] ) ;
  sh:sparql [ sh:message "self" ; sh:select "SELECT $this WHERE { $this <http://x/knows> $this }" ] ."""


def test_shacl(spark):
    s = GraphStore(spark)
    s.parse_turtle(TTL + ':a a :P ; :name "Ann" ; :age 3 ; :knows :a . :b a :P ; :name "B" , 5 ; :age -1, 4 . :c a :P ; :name "Cid" . :x :knows :c .', 1)
    s.parse_turtle(TTL + SHAPES, 2)
    r = s.validate(1, 2, "full")
    got = sorted((x["focusNode"][-1], x["sourceConstraintComponent"].removeprefix(T.SH).removesuffix("ConstraintComponent")) for x in r["results"])
    assert got == [("a", "SPARQL"), ("b", "Datatype"), ("b", "MaxCount"), ("b", "MinInclusive"), ("b", "MinLength"), ("b", "MinLength"), ("c", "Class"), ("c", "Or")]
    assert not r["conforms"]
    assert s.validate(1, 2, "full", collect=False)["report"].count() == r["n_results"] == len(r["results"])
    with pytest.raises(ValueError):
        s.validate(1, 1)


def test_io(spark, tmp_path):
    nt = tmp_path / "x.nt"
    nt.write_text('<http://x/a> <http://x/p> "q\\"\\u00e9\\n" .\n# note\n\n_:b1 <http://x/p> <http://x/c> .\n<http://x/a> <http://x/p> "v"@fr-CA .\nbroken\n<http://x/a> <http://x/n> "0030"^^<http://www.w3.org/2001/XMLSchema#integer> .\n')
    s = GraphStore(spark)
    assert s.load(str(nt), 4) == 4
    assert {r[0] for r in s.quads.select("o__x").collect()} == {'q"é\n', "http://x/c", "v", "0030"}
    assert {r[0] for r in s.quads.select("o__l").collect()} == {"", "fr-ca"}
    ttl = tmp_path / "y.ttl"
    ttl.write_text(TTL + ":a :p ( 1 2.5 1e3 true ) ; a :T . :b :p '''long \"text\"''' .")
    assert s.load(str(ttl), 5) == 11
    assert s.parse_nquads('<http://x/a> <http://x/p> "1" <http://x/g> .\n<http://x/a> <http://x/p> "1" .\n')["quads"] == 2
    assert s.parse_trig(TTL + ":g { :a :p 2 } :a :p 3 .")["quads"] == 2
    with pytest.raises(GraphError):
        s.parse_trig(TTL + ":new { :a :p 2 }", strict=True)
    with pytest.raises(ValueError):
        s.parse_turtle("<a> <b> .")
    s.save(str(tmp_path / "store"))
    again = GraphStore.open(spark, str(tmp_path / "store"))
    assert again.stats()["quads"] == s.stats()["quads"]
    assert again.graph_digest(5) == s.graph_digest(5)
    s.write_ntriples(str(tmp_path / "out"), 4)
    t = GraphStore(spark)
    assert t.load(str(tmp_path / "out"), 1, "ntriples") == 4
    assert s.put_construct_rows([{"subject": {"type": "bnode", "value": "b"}, "predicate": {"type": "iri", "value": "http://x/p"}, "object": {"type": "literal", "value": "1"}}], 6) == 1
    with pytest.raises(GraphError):
        s.put_construct_row({"subject": {"type": "literal", "value": "b"}, "predicate": {"type": "iri", "value": "http://x/p"}, "object": {"type": "literal", "value": "1"}})


def test_hard_lines(spark, tmp_path):
    """Long literals, all escapes, raw control characters, and lines that are broken."""
    long = "x y\\n" * 200_000 + "z"
    given = [
        f'<http://x/a> <http://x/p> "{long}" .', '<http://x/b> <http://x/p> "\\U0001F389 \\u00E9 \\\\U00004141 \\t\\b\\f\\r\\\'\\"" .', '<http://x/c> <http://x/p> "\\uD83C\\uDF89" .',
        '<http://x/d> <http://x/p> "raw \x01 \t \x7f" .', '_:a.b <http://x/p\\u00e9> _:c <http://x/g> . # note', '<http://x/e><http://x/p>"v"@fr-CA.', '<http://x/f> <http://x/p> ""^^<http://x/d> .',
    ]
    broken = ['<http://x/a> <http://x/p> "\\uD83C" .', '<http://x/a> <http://x/p> "\\q" .', '<http://x/a> <http://x/p> "a" . x', '! <http://x/a> <http://x/b> <http://x/c> .', '"a" <http://x/p> "b" .', "<http://x/a b> <http://x/p> <http://x/c> .", "word"]
    path = tmp_path / "hard.nq"
    path.write_text("\n".join(given + broken + ["# comment", "", "   "]) + "\n")
    s = GraphStore(spark)
    assert s.load(str(path)) == len(given)
    got = {r["s__x"]: (r["o__x"], r["o__d"], r["o__l"]) for r in s.quads.collect()}
    x = "http://x/"
    assert got[x + "a"][0] == "x y\n" * 200_000 + "z"
    assert got[x + "b"][0] == "\U0001F389 \u00e9 \\U00004141 \t\b\f\r\'\"" and got[x + "c"][0] == "\U0001F389" and got[x + "d"][0] == "raw \x01 \t \x7f"
    assert got[x + "e"] == ("v", T.LANG_STRING, "fr-ca") and got[x + "f"] == ("", x + "d", "")
    assert [r[0] for r in s.quads.where("s__k = 2").select("p__x").collect()] == [x + "p\u00e9"]
    with pytest.raises(ValueError):
        GraphStore(spark).load(str(path), lenient=False)
    import hashlib

    assert s.graphs.where("graph_id = 0").first()["source_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    out = str(tmp_path / "again")
    s.write_ntriples(out)
    t = GraphStore(spark)
    t.load(out, 0, "ntriples")
    plain = lambda g: {(r.s__x, r.p__x, r.o__x, r.o__d, r.o__l) for r in g.quads.where("g = 0 AND s__k = 1").collect()}
    assert plain(t) == plain(s) and len(t.graphs.where("graph_id = 0").first()["source_sha256"]) == 64
    u = GraphStore(spark)
    assert u.load_turtle_verbose(str(tmp_path / "none.ttl"), 1)["triples"] == 0 if (tmp_path / "none.ttl").write_text("") else True


def test_segments(spark, tmp_path):
    """Inserts append, deletes rewrite only what they touch, versions are committed once, old files go."""
    from loomgraph.sources.segments import FAN, LostRace

    s = GraphStore(spark, str(tmp_path / "store"))
    s.update(PRE + "INSERT DATA { :a :p 1 . GRAPH :g1 { :b :p 2 . :c :p 3 } }")
    first = s.store.segments
    s.update(PRE + "INSERT DATA { :a :p 1 , 2 . }")
    assert set(first) <= set(s.store.segments) and [x.rows for x in s.store.segments if x not in first] == [1]
    near = s._near(s.quads.where("o__x = '2' AND g = 0"), 1)
    plan = near._sc._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    pushed = plan.split("PushedFilters")[1].split("\n")[0]
    assert "EqualTo(p," in pushed and "EqualTo(s," in pushed  # both ids reach the reader, and only files of the graph are read
    assert near.inputFiles() and all("/g=0/" in x for x in near.inputFiles())
    s.update(PRE + "DELETE DATA { GRAPH :g1 { :b :p 2 } }")
    default = [x for x in first if x.g == 0]
    assert set(default) <= set(s.store.segments) and s.count_quads(s.graph_id("http://x/g1")) == 1
    reader = GraphStore.open(spark, str(tmp_path / "store"))
    assert reader.stats()["quads"] == s.stats()["quads"] == 3
    for i in range(FAN):
        s.update(PRE + f"INSERT DATA {{ :m{i} :q {i} }}")
    assert len(s.store.segments) < FAN and s.stats()["quads"] == 3 + FAN
    with pytest.raises(LostRace):
        reader.update(PRE + "INSERT DATA { :late :p 1 }")
    assert s.vacuum(age_seconds=-1) > 0
    assert s.quads.count() == 3 + FAN and GraphStore.open(spark, str(tmp_path / "store")).quads.count() == 3 + FAN
    assert GraphStore.build_id().startswith(GraphStore.version())
    assert s.partitioned_digest() == s.partitioned_digest() != s.partitioned_digest(1)


def test_few_quads_are_written_by_one_task_but_made_by_many(spark):
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    from loomgraph.sources.quads import with_ids

    task = F.udf(lambda _: str(TaskContext.get().partitionId()))
    none, iri = F.lit(""), F.lit(T.IRI)
    rows = spark.range(0, 100, 1, 4).select(iri.alias("s__k"), F.concat(F.lit("urn:s:"), "id").alias("s__x"), F.lit("urn:p").alias("p__x"), iri.alias("o__k"), task("id").alias("o__x"), none.alias("o__d"), none.alias("o__l"), F.lit(0).cast("long").alias("g"))
    s = GraphStore(spark)
    found = s.store.frame(s.store.write(with_ids(rows), 100))
    assert found.count() == 100 and found.select("o__x").distinct().count() == 4
    assert found.select(F.input_file_name()).distinct().count() == 1


def test_negated_paths_read_what_their_ends_name(spark):
    """Over tables: a bound end reaches the reader, types are edges too, and edges of one pair stand as often as there are.  Stored quads alike."""
    from loomgraph.engine import Queries
    from loomgraph.sources.relational import RelationalGraph

    q = Queries(RelationalGraph(spark, "/root/testdata/sf0.001"))
    ask = lambda t: q.sparql(f"PREFIX c: <urn:c:> {t}")
    forward = ask("SELECT ?y { <urn:t:nation:3> !(c:n_regionkey|c:within) ?y }")
    assert rows(forward) == [("3",), ("NATION_3",), ("urn:t:nation",)]
    backward = ask("SELECT ?x { <urn:t:region:3> !(^c:none) ?x }")
    assert len(rows(backward)) == 10 and len(set(rows(backward))) == 5
    for df in (forward, backward):
        assert df.inputFiles() and all("nation.parquet" in x for x in df.inputFiles())
    assert rows(ask("SELECT ?y { <urn:t:nation:3> (!(c:n_name|c:n_nationkey))+ ?y }")) == [("3",), ("EUROPE",), ("urn:t:nation",), ("urn:t:region",), ("urn:t:region:3",)]
    s = store(spark, ":a :p :b ; :q :b , 1 ; :r :a . :b :p :c .")
    n = lambda p: rows(s.sparql(PRE + f"SELECT * {{ {p} }}"))
    x = "http://x/"
    assert n(":a !(:r) ?y") == [("1",), (x + "b",), (x + "b",)] and n("?x !(:q|:p) ?x") == [(x + "a",)] and n(":b !(:q|^:q) ?y") == [(x + "a",), (x + "c",)]
    assert n(":a (!(:q))+ ?y") == [(x + "a",), (x + "b",), (x + "c",)]
