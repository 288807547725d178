"""SPARQL algebra as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..terms import Term


class SparqlError(ValueError):
    pass


class Unsupported(SparqlError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


Node = Var | Term


# paths


@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """path* (least 0, many), path+ (least 1, many), path? (least 0, not many)."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class NotIn:
    forward: tuple
    backward: tuple


@dataclass(frozen=True)
class Triple:
    s: Node
    p: object  # Var, Term or a path
    o: Node


# expressions


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    pattern: object
    positive: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None
    distinct: bool = False
    separator: str = " "


# patterns


@dataclass(frozen=True)
class Bgp:
    triples: tuple


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    condition: object | None = None


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    pattern: object
    condition: object


@dataclass(frozen=True)
class Extend:
    pattern: object
    var: str
    value: object


@dataclass(frozen=True)
class Values:
    names: tuple
    rows: tuple


@dataclass(frozen=True)
class Graph:
    name: Node
    pattern: object


@dataclass(frozen=True)
class Select:
    """items: (variable, expression or None); empty with ``star``."""

    pattern: object
    items: tuple
    star: bool = False
    distinct: bool = False
    group: tuple | None = None
    having: tuple = ()
    order: tuple = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Query:
    form: str
    select: Select | None = None
    template: tuple = ()
    resources: tuple = ()
    shorthand: bool = False
    dataset: tuple = ()
    named: tuple = ()


@dataclass(frozen=True)
class UpdateOp:
    kind: str
    delete: tuple = ()
    insert: tuple = ()
    pattern: object | None = None
    with_graph: str | None = None
    source: str | None = None
    target: str | None = None
    silent: bool = False
    using: tuple = field(default=())
