"""Nested JSON records as related flat tables, by shared inlining.

First Spark counts which field holds what under which field, over all records, into the graph of fields. It tells the
recursive field (one that occurs under itself), the fields that hold the root of such a tree, those that wrap it, and the
fields of a node. By that shape the records are split into elements (an element is an object, or an item of a repeated field), each
with the path of its parent. Spark counts the edges between element types into the schema graph. That
graph decides the tables: an element type that is repeated, shared by several parents or recursive gets
a table of its own, whose rows hold the path of the parent as a foreign key; a type that occurs once under
one parent is inlined, its scalar fields becoming columns of the parent's table.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"
ELEMENTS = "type string, path string, parent_type string, parent_path string, repeated boolean, value string, fields map<string,string>"


#: A field counts for the shape of the records if it is held in at least this share of those that can be read; most keys of maps, which name single objects, stay below it.
USUAL = 0.001
#: Characters of paths after which the elements read so far are handed over.
FLUSH = 4_000_000


@dataclass(frozen=True)
class Shape:
    """What is known of the records when they are split; ``shape_of`` finds it in the graph of fields.

    roots: names of fields that hold the tree of a record; wrappers: fields that a record may lie under;
    node: the element type of roots and children; children: the field that repeats it; leaves: fields that
    hold lists of terms; term: the field of a term stored as an object; known: fields by which an object is
    told from a map of objects; sign: pattern of what separates terms in one string.
    """

    roots: tuple[str, ...]
    wrappers: tuple[str, ...]
    children: str
    known: frozenset[str]
    node: str = "node"
    leaves: tuple[str, ...] = ("keywords",)
    term: str = "term"
    sign: str = r"[,;|\n]"


_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")


def parse(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it is none."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> object:
    """Like json.loads, with a stack of its own instead of the interpreter's."""
    top: list = []
    open_: list[tuple[object, str | None]] = [(top, None)]  # containers not yet closed, with the key that waits for its value
    at, want = 0, "value"

    def put(value: object) -> None:
        holder, key = open_[-1]
        holder.append(value) if isinstance(holder, list) else holder.__setitem__(key, value)

    while True:
        at = _BLANK.match(text, at).end()
        char = text[at : at + 1]
        if want == "next" and len(open_) == 1:
            if char:
                raise ValueError("text after the value")
            return top[0]
        if want in ("next", "first") and char and char == ("]" if isinstance(open_[-1][0], list) else "}"):
            done = open_.pop()[0]
            put(done)
            at, want = at + 1, "next"
        elif want == "next":
            if char != ",":
                raise ValueError("no comma")
            at, want = at + 1, "value" if isinstance(open_[-1][0], list) else "key"
        elif want == "key" or want == "first" and isinstance(open_[-1][0], dict):
            if char != '"':
                raise ValueError("no key")
            key, at = scanstring(text, at + 1)
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            open_[-1] = (open_[-1][0], key)
            at, want = at + 1, "value"
        elif char in ("[", "{") and char:
            open_.append(([] if char == "[" else {}, None))
            at, want = at + 1, "first"
        else:
            if char == '"':
                value, at = scanstring(text, at + 1)
            else:
                found = _PLAIN.match(text, at)
                if not found:
                    raise ValueError("no value")
                value, at = json.loads(found[0]), found.end()
            put(value)
            want = "next"


def _items(value: list) -> Iterator[object]:
    """The items of a list, those of lists within it in their place."""
    open_ = [iter(value)]
    while open_:
        for item in open_[-1]:
            if isinstance(item, list):
                open_.append(iter(item))
                break
            yield item
        else:
            open_.pop()


def _text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _terms(value: object, shape: Shape) -> Iterator[str]:
    """The terms that are not blank, trimmed, whatever holds them."""
    if isinstance(value, str):
        yield from (t.strip() for t in re.split(shape.sign, value) if t.strip())
    elif isinstance(value, dict) and shape.term not in value:
        yield from (k.strip() for k in value if k.strip())
    else:
        for item in _items(value if isinstance(value, list) else [value]):
            item = item.get(shape.term) if isinstance(item, dict) else item
            for x in _items(item) if isinstance(item, list) else (item,):
                if x is not None and not isinstance(x, (bool, dict)) and _text(x).strip():
                    yield _text(x).strip()


def _children(value: object, shape: Shape) -> list[dict]:
    """The actual nodes under a field: of an array, of a map of nodes, or a single node."""
    if isinstance(value, dict):
        single = bool(shape.known & value.keys()) or not all(v is None or isinstance(v, dict) for v in value.values())
        value = [value] if single else list(value.values())
    return [x for x in _items(value) if isinstance(x, dict) and x] if isinstance(value, list) else []


def _unwrap(value: object, shape: Shape) -> object:
    """The object that holds the tree, out of strings of JSON, lists and wrappers."""
    while True:
        if isinstance(value, str):
            value = parse(value.lstrip(BOM))
        elif isinstance(value, list):
            value = next((x for x in value if x is not None), None)
        elif isinstance(value, dict) and not any(value.get(r) for r in shape.roots) and (inner := next((value[w] for w in shape.wrappers if value.get(w)), None)):
            value = inner
        else:
            return value


def _root(raw: str | None, shape: Shape) -> dict | None:
    """The root node of a record; None where it can't be read or holds no tree."""
    try:
        index = _unwrap(raw or "", shape)
        if isinstance(index, dict):
            for name in shape.roots:
                tree = index.get(name)
                if nodes := _children([_unwrap(tree, shape) if isinstance(tree, str) else tree], shape):
                    return nodes[0]
    except ValueError:
        pass
    return None


def _fields(raw: str | None) -> set[tuple[str, str, str]]:
    """What the fields of one record hold: (name of the field around, '' for the record itself; name; 'object' or 'plain').

    A record within a string or a list counts as the record itself. Nothing for what can't be read.
    """
    try:
        value = parse((raw or "").lstrip(BOM))
        while isinstance(value, (str, list)):
            value = parse(value.lstrip(BOM)) if isinstance(value, str) else next((x for x in value if x is not None), None)
    except ValueError:
        return set()
    found: set[tuple[str, str, str]] = set()
    stack = [("", value)] if isinstance(value, dict) else []
    while stack:
        name, value = stack.pop()
        for inner, x in value.items():
            objects = [o for o in (_items(x) if isinstance(x, list) else (x,)) if isinstance(o, dict) and o]
            if isinstance(x, str) and x.lstrip()[:1] == "{":  # a tree stored as a string of its own
                try:
                    objects = [o for o in [parse(x)] if isinstance(o, dict) and o]
                except ValueError:
                    pass
            found.add((name, inner, "object" if objects else "plain"))
            stack += [(inner, o) for o in objects]
    return found


def field_graph(records: DataFrame, raw: str) -> DataFrame:
    """(holder, field, kind, records): in how many records a field of a holder holds objects or something plain.

    holder and field are null for the number of records that can be read. Each task counts its own before the shuffle.
    """
    schema = pa.schema([("holder", pa.string()), ("field", pa.string()), ("kind", pa.string()), ("records", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple] = Counter()
            for text in batch.column(0).to_pylist():
                if fields := _fields(text):
                    seen.update([*fields, (None, None, None)])
            if seen:
                rows = [(*k, n) for k, n in seen.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    counts = records.select(F.col(raw).alias("raw")).mapInArrow(count, "holder string, field string, kind string, records long")
    return counts.groupBy("holder", "field", "kind").agg(F.sum("records").alias("records"))


def shape_of(graph: DataFrame, **more: object) -> Shape | None:
    """The shape of the records by their graph of fields; None if none holds a tree.

    Only fields that are usual come to the driver: at most 1 / USUAL times the fields of a record. The children are the field that occurs most
    often under itself; roots are the other fields that hold the fields of such a node, wrappers those that hold a root. What is held
    somewhere below a child, such as the keys of a map of nodes, is neither.
    """
    total = graph.filter("field is null").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    rows = graph.filter((F.col("field").isNotNull()) & (F.col("records") >= USUAL * total)).collect()
    plain, objects = defaultdict(set), defaultdict(set)
    for r in rows:
        (objects if r.kind == "object" else plain)[r.holder].add(r.field)
    loops = [(r.records, r.field) for r in rows if r.kind == "object" and r.holder == r.field]
    if not loops:
        # no node has grandchildren: children are what most looks like its holder
        loops = [(len(plain[r.field] & plain[r.holder]), r.field) for r in rows if r.kind == "object" and r.holder and len(plain[r.field] & plain[r.holder]) >= 2]
    if not loops:
        return None
    children = max(loops)[1]
    own = plain[children] | {children}
    below, todo = {children}, [children]
    while todo:
        todo += (new := objects[todo.pop()] - below)
        below |= new
    held = {f for fs in objects.values() for f in fs} - below
    roots = tuple(sorted((f for f in held if children in objects[f] and len(plain[f] & own) * 2 >= len(own & (plain[f] | own))), key=lambda f: (-sum(r.records for r in rows if r.field == f and r.kind == "object"), f)))
    wrappers = tuple(sorted(f for f in held - set(roots) if objects[f] & set(roots)))
    known = own.union(*(plain[f] for f in roots))
    return Shape(roots, wrappers, children, frozenset(known), **more)


def _walk(raw: str | None, shape: Shape) -> Iterator[tuple]:
    """The elements of one record, each with its place and its scalar fields."""
    root = _root(raw, shape)
    stack: list[tuple] = [(shape.node, "0", "document", "", False, root)] if root else []
    while stack:
        kind, path, parent_kind, parent, repeated, value = stack.pop()
        if isinstance(value, list):
            stack += [(kind, f"{path}[{i}]", parent_kind, parent, repeated, x) for i, x in enumerate(value)]
            continue
        if not isinstance(value, dict):
            yield kind, path, parent_kind, parent, repeated, _text(value), None
            continue
        scalars = []
        for name, inner in value.items():
            if kind == shape.node and name == shape.children:
                stack += [(kind, f"{path}/{i}", kind, path, True, x) for i, x in enumerate(_children(inner, shape))]
            elif kind == shape.node and name in shape.leaves:
                stack += [(name, f"{path}/k{i}", kind, path, True, x) for i, x in enumerate(_terms(inner, shape))]
            elif isinstance(inner, dict):
                stack.append((name, f"{path}.{name}", kind, path, False, inner))
            elif isinstance(inner, list):
                stack += [(name, f"{path}.{name}[{i}]", kind, path, True, x) for i, x in enumerate(inner)]
            else:
                scalars.append((name, None if inner is None else _text(inner)))
        yield kind, path, parent_kind, parent, repeated, None, scalars


def elements(records: DataFrame, key: str, raw: str, shape: Shape) -> DataFrame:
    """One row per element of each record's tree: ``key`` and the columns of ELEMENTS.

    Records that are null, empty, not readable or without tree give no rows. An object without any field is
    no node. A record is read by one task, records never meet, so one large source is split like any other.
    Rows with a null key are left out; other columns are ignored.
    """
    names = ["key", *[c.split()[0] for c in ELEMENTS.split(", ")]]
    schema = pa.schema([("key", pa.int64()), *[(n, pa.bool_() if n == "repeated" else pa.map_(pa.string(), pa.string()) if n == "fields" else pa.string()) for n in names[1:]]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in _walk(text, shape):
                    rows.append((k, *x))
                    size += len(x[1]) + 64
                    if size > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    chosen = records.dropna(subset=[key]).select(F.col(key).cast("long").alias("key"), F.col(raw).alias("raw"))
    return chosen.mapInArrow(read, f"key long, {ELEMENTS}").withColumnRenamed("key", key)


def schema_graph(found: DataFrame) -> DataFrame:
    """Edges between element types: parent_type, type, occurrences, repeated, and the scalar fields of the type."""
    names = F.array_distinct(F.flatten(F.collect_set(F.map_keys("fields"))))
    edges = found.groupBy("parent_type", "type").agg(F.count("*").alias("occurrences"), F.max("repeated").alias("repeated"), F.array_sort(names).alias("field_names"))
    return edges


def own_tables(edges: list[tuple[str, str, bool]]) -> dict[str, str]:
    """Of each element type, the type whose table holds it: itself or the ancestor that it is inlined into.

    Edges are (parent, type, repeated). A type has its own table if it is repeated, shared or recursive, or
    if its parent is no element.
    """
    parents, own = defaultdict(set), set()
    for parent, kind, repeated in edges:
        parents[kind].add(parent)
        own |= {kind} if repeated else set()

    def ancestors(kind: str) -> set[str]:
        seen: set[str] = set()
        todo = list(parents[kind])
        while todo:
            if (p := todo.pop()) not in seen:
                seen.add(p)
                todo += parents.get(p, ())
        return seen

    own |= {k for k, ps in list(parents.items()) if len(ps) > 1 or not ps & parents.keys() or k in ancestors(k)}
    home: dict[str, str] = {}
    for kind in list(parents):
        at = kind
        while at not in own:
            at = next(iter(parents[at]))
        home[kind] = at
    return home


def flat_tables(found: DataFrame, key: str, columns: int = 200) -> dict[str, DataFrame]:
    """The related tables of the elements, by element type.

    Each has ``key``, ``path`` (its key within the record), ``parent_type`` and ``parent_path`` (the foreign
    key), ``value`` (of an item that is no object) and a column per scalar field, named by its place where it was
    inlined; beyond ``columns`` fields the rest stays in the map ``fields``. Only the schema graph, whose size
    is that of the schema and not of the data, comes to the driver.
    """
    graph = schema_graph(found).collect()
    home = own_tables([(r.parent_type, r.type, r.repeated) for r in graph])
    names: dict[str, set[str]] = defaultdict(set)
    for r in graph:
        names[r.type] |= set(r.field_names or ())
    tables = {}
    for kind in sorted(set(home.values())):
        rows = found.filter(F.col("type") == kind).select(key, "path", "parent_type", "parent_path", "value", "fields")
        fields = {n: n for n in names[kind]}
        inlined = sorted(k for k, h in home.items() if h == kind and k != kind)
        if inlined:
            # path of the row that an inlined object belongs to: what stands before its own field names
            part = found.filter(F.col("type").isin(inlined)).select(key, F.substring_index("path", ".", 1).alias("path"), F.expr("substring(path, length(substring_index(path, '.', 1)) + 2)").alias("place"), "fields")
            part = part.select(key, "path", F.transform_keys("fields", lambda k, _: F.concat_ws(".", F.col("place"), k)).alias("more"))
            part = part.groupBy(key, "path").agg(F.flatten(F.collect_list(F.map_entries("more"))).alias("more"))
            rows = rows.join(part, [key, "path"], "left").withColumn("fields", F.coalesce(F.map_concat("fields", F.map_from_entries("more")), "fields")).drop("more")
            fields |= {f"{k}.{n}": None for k in inlined for n in names[k]}
        chosen = sorted(n for n, at in fields.items() if at)[:columns]
        chosen = [n for n in chosen if n not in (key, "path", "parent_type", "parent_path", "value", "fields")]
        tables[kind] = rows.select(key, "path", "parent_type", "parent_path", "value", *[F.col("fields")[n].alias(n) for n in chosen], F.map_filter("fields", lambda k, _: ~k.isin(chosen) if chosen else F.lit(True)).alias("fields"))
    return tables
