"""What a query or update consists of, as a dict, without running it."""

from __future__ import annotations

from ..terms import Term
from . import algebra as A
from .parser import parse_query, parse_update


def _text(x) -> str:
    if isinstance(x, A.Var):
        return f"?{x.name}"
    if isinstance(x, Term):
        return x.nt()
    if isinstance(x, A.Link):
        return f"<{x.iri}>"
    if isinstance(x, A.Inverse):
        return f"^{_text(x.path)}"
    if isinstance(x, (A.Sequence, A.Alternative)):
        return "(" + ("/" if isinstance(x, A.Sequence) else "|").join(map(_text, x.parts)) + ")"
    if isinstance(x, A.Repeat):
        return _text(x.path) + ("?" if not x.many else "+" if x.least else "*")
    if isinstance(x, A.NotIn):
        return "!(" + "|".join([f"<{i}>" for i in x.forward] + [f"^<{i}>" for i in x.backward]) + ")"
    return repr(x)


def _triple(t: A.Triple) -> dict:
    return {"subject": _text(t.s), "predicate": _text(t.p), "object": _text(t.o)}


def _walk(p, out: dict):
    out["operators"].append(type(p).__name__)
    if isinstance(p, A.Bgp):
        out["bgp_patterns"] += [_triple(t) for t in p.triples]
    for name in ("left", "right", "pattern"):
        if hasattr(p, name):
            _walk(getattr(p, name), out)


def describe_algebra(text: str) -> dict:
    try:
        q = parse_query(text)
    except A.SparqlError as first:
        try:
            ops = parse_update(text)
        except A.SparqlError:
            raise first from None
        return {
            "form": "UPDATE",
            "operations": [
                {"kind": o.kind, "target": o.target, "source": o.source, "with": o.with_graph, "silent": o.silent,
                 "insert": [_triple(t) for t, _ in o.insert], "delete": [_triple(t) for t, _ in o.delete]}
                for o in ops
            ],
        }
    out = {"form": q.form, "variables": [v for v, _ in q.select.items], "bgp_patterns": [], "operators": [], "unsupported_algebra": []}
    _walk(q.select.pattern, out)
    if q.form == "CONSTRUCT":
        out |= {"template": [_triple(t) for t in q.template], "shorthand": q.shorthand}
    if q.form == "DESCRIBE":
        out["resources"] = [r if isinstance(r, str) else _text(r) for r in q.resources]
    s = q.select
    return out | {"distinct": s.distinct, "limit": s.limit, "offset": s.offset, "grouped": s.group is not None, "ordered": bool(s.order)}
