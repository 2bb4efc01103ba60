"""Deeply nested JSON records to flat node tables with interval labels.

Every value of a record (object, array or scalar) becomes a node that a depth-first walk numbers: ``pre`` when it is
entered, ``post`` when it is left, so a node lies inside another exactly if pre > and post <. Tables of nodes of one
type are linked by that containment, whatever lay between them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_FENCE = re.compile(r"\s*```[A-Za-z0-9_+-]*[ \t]*\r?\n?(.*?)\s*```\s*", re.S)
_BLANKS, _FLAT = re.compile(r"[ \t\n\r]*"), re.compile(r'[^\s\[\]{}",:]+')


def parse_json(text: str):
    """``json.loads`` for values of any depth; ValueError for what is no JSON. Deep values are read without recursion."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    at, root, stack = 0, [], []  # stack: (container, key); the root is a list of one
    inside, key, wants = root, None, "value"

    def blanks(i: int) -> int:
        return _BLANKS.match(text, i).end()

    def put(value) -> None:
        if isinstance(inside, list):
            inside.append(value)
        else:
            inside[key] = value

    at = blanks(at)
    while True:
        c = text[at : at + 1]
        if wants == "value" or wants == "first" and c != "]":
            if c in ("{", "["):
                new = {} if c == "{" else []
                put(new)
                stack.append((inside, key))
                inside, at, wants = new, blanks(at + 1), "key or end" if c == "{" else "first"
                continue
            if c == '"':
                value, at = json.decoder.scanstring(text, at + 1, True)
            else:
                word = _FLAT.match(text, at)
                if not word:
                    raise ValueError(f"no value at {at}")
                value, at = json.loads(word[0]), word.end()
            put(value)
        elif wants == "key" or wants == "key or end" and c != "}":
            if c != '"':
                raise ValueError(f"no key at {at}")
            key, at = json.decoder.scanstring(text, at + 1, True)
            at = blanks(at)
            if text[at : at + 1] != ":":
                raise ValueError(f"no colon at {at}")
            at, wants = blanks(at + 1), "value"
            continue
        else:  # the container ends here
            if c != ("}" if isinstance(inside, dict) else "]"):
                raise ValueError(f"no end at {at}")
            (inside, key), at = stack.pop(), at + 1
        at = blanks(at)
        if inside is root:
            if at < len(text):
                raise ValueError(f"extra text at {at}")
            return root[0]
        if text[at : at + 1] == ",":
            at, wants = blanks(at + 1), "key" if isinstance(inside, dict) else "value"
        else:
            wants = "end"


def whole_value(text: str | None):
    """The JSON value a text holds, or None: a byte order mark and a code fence around it are taken off, and a text
    that is itself a JSON string of JSON is decoded again, however often. A text that holds no whole value gives None."""
    while isinstance(text, str):
        text = text.strip("﻿ \t\r\n")
        fenced = _FENCE.fullmatch(text)
        try:
            text = parse_json(fenced[1].strip("﻿ \t\r\n") if fenced else text)
        except ValueError:
            return None
    return text


def plain_name(name: str) -> str:
    """A key without the marks that ways of writing names differ by: coreContributions, core_contributions, ..."""
    return re.sub(r"[\s_\-.]+", "", name).lower()


def _scalar(value) -> str | None:
    """A scalar as text: strings as they are, others as JSON."""
    if value is None:
        return None
    out = value if isinstance(value, str) else json.dumps(value)
    return out.encode("utf-8", "replace").decode()


def walk(value, key: str | None = None) -> Iterator[tuple]:
    """(pre, post, depth, up_pre, name, list_pos, kind, value) of every node below a JSON value, by iterative
    depth-first walk. An entry of an array has the array's name and its position. An object's or a scalar's list
    position is 0 where it stands alone under a name, so a lone value is a list of one. An object's value is the
    scalar it has directly under ``key``."""
    out: list[list] = []
    clock = 0
    stack: list[tuple] = [(value, 0, -1, None, 0, None)]
    while stack:
        item, depth, parent, name, pos, done = stack.pop()
        if done is not None:
            out[done][1] = clock
            clock += 1
            continue
        at = len(out)
        kind = "object" if isinstance(item, dict) else "array" if isinstance(item, list) else "null" if item is None else "scalar"
        pre = clock
        if kind == "object":
            fields = [(plain_name(k), v) for k, v in item.items()]
            own = next((v for k, v in fields if k == key and not isinstance(v, (dict, list))), None)
        else:
            own = item if kind == "scalar" else None
        out.append([pre, None, depth, parent, name, pos, kind, _scalar(own)])
        clock += 1
        stack.append((None, 0, 0, None, 0, at))
        if kind == "object":
            stack += [(v, depth + 1, pre, k, 0, None) for k, v in reversed(fields)]
        elif kind == "array":
            stack += [(v, depth + 1, pre, name, i, None) for i, v in reversed(list(enumerate(item)))]
    return map(tuple, out)


#: Columns of a node table, besides the record's id.
NODE = "row_no bigint, pre int, post int, depth int, up_pre int, name string, list_pos int, kind string, value string"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]


def node_table(df: DataFrame, id_col: str, json_col: str, names: list[str] | None = None, key: str | None = None) -> DataFrame:
    """(record_id, row_no, pre, post, depth, up_pre, name, list_pos, kind, value): the nodes of the JSON of every row.

    With ``names`` only nodes of those names (however written) are given; their labels are those of the whole walk.
    The root's name is null; an object's value is the scalar under ``key`` in it. ``row_no`` tells rows of one id
    apart. A null or damaged JSON gives no row; repeated rows give repeated rows; other columns are
    not read. No shuffle.
    """
    kind = dict(df.dtypes)[id_col]
    wanted = names and {plain_name(n) for n in names}
    key = key and plain_name(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_no = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 128):
                own, rows = [], []
                for k, text in enumerate(texts.slice(at, 128).to_pylist()):
                    value = whole_value(text)
                    if isinstance(value, (dict, list)):
                        new = [(row_no, *n) for n in walk(value, key) if not wanted or n[4] in wanted]
                        row_no += 1
                        rows += new
                        own += [at + k] * len(new)
                columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(_TYPES), _TYPES)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own, pa.int64())), *columns], names=["record_id", *[c.split()[0] for c in NODE.split(", ")]])

    return df.select(id_col, json_col).mapInArrow(run, f"record_id {kind}, {NODE}")


def objects_with_lists(df: DataFrame, json_col: str, name: str, key: str, lists: list[str]) -> DataFrame:
    """(<the other columns>, list_pos, value, <lists>): every object of that name in the JSON of every row, its scalar under
    ``key``, and the scalars in lists of those names of which it is the nearest object of its name around. Names are read
    however they are written. A null or damaged JSON gives no row. No shuffle."""
    kept = [c for c in df.columns if c != json_col]
    parent, own = plain_name(name), plain_name(key)
    wanted = {plain_name(x): k for k, x in enumerate(lists)}
    schema = StructType([df.schema[c] for c in kept] + StructType.fromDDL(", ".join(["list_pos int", "value string", *[f"`{x}` array<string>" for x in lists]])).fields)
    types = [pa.int32(), pa.string(), *[pa.list_(pa.string())] * len(lists)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(json_col).to_pylist()):
                value, around = whole_value(text), []
                for pre, post, _, _, label, pos, kind, scalar in walk(value, own) if isinstance(value, (dict, list)) else ():
                    while around and around[-1][0] < pre:
                        around.pop()
                    if label == parent and kind == "object":
                        rows.append((pos, scalar, *([] for _ in lists)))
                        at.append(k)
                        around.append((post, rows[-1]))
                    elif kind == "scalar" and around and (to := wanted.get(label)) is not None:
                        around[-1][1][2 + to].append(scalar)
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at, pa.int64())) for c in kept], *columns], names=[*kept, "list_pos", "value", *lists])

    return df.mapInArrow(run, schema)


def entries(nodes: DataFrame, name: str, under: Column | None = None) -> DataFrame:
    """The nodes that are entries of a list of that name: the items of an array, or what stands there alone.

    Null entries hold their place but give no row; an array inside the list is no entry."""
    found = nodes.filter((F.col("name") == plain_name(name)) & ~F.col("kind").isin("array", "null"))
    return found if under is None else found.filter(under)


def linked(nodes: DataFrame, is_parent: Column, is_child: Column, keys: list[str]) -> DataFrame:
    """The child nodes with the nearest parent node that contains them: its columns get the prefix ``parent_``.

    ``keys`` tell records apart (record_id and row_no at least). Parents may be nested in each other: entering one
    counts up and leaving it down, so a node's count tells the level of its nearest parent, which is the last one of
    that level to begin before it. Two windows over the labels of a record, one shuffle. Children outside every parent
    give no row.
    """
    cols = [c for c in nodes.columns if c not in keys]
    step = lambda at, no, by: F.struct(F.col(at).alias("at"), F.lit(no).alias("no"), F.lit(by).alias("by"))
    # a node that is both is a child before it is a parent
    steps = F.filter(F.array(F.when(is_child, step("pre", 0, 0)), F.when(is_parent, step("pre", 1, 1)), F.when(is_parent, step("post", 2, -1))), lambda x: x.isNotNull())
    walked = nodes.select(*keys, F.struct(*cols).alias("_n"), F.explode(steps).alias("_s"))
    level = F.sum("_s.by").over(Window.partitionBy(*keys).orderBy("_s.at", "_s.no").rowsBetween(Window.unboundedPreceding, 0))
    told = walked.withColumn("_l", level).filter("_s.no < 2 and _l > 0")
    before = Window.partitionBy(*keys, "_l").orderBy("_s.at", "_s.no").rowsBetween(Window.unboundedPreceding, -1)
    held = told.withColumn("_o", F.last(F.when(F.col("_s.no") == 1, F.col("_n")), ignorenulls=True).over(before))
    inside = (F.col("_s.no") == 0) & (F.col("_o.pre") < F.col("_n.pre")) & (F.col("_o.post") > F.col("_n.post"))
    return held.filter(inside).select(*keys, *[F.col(f"_n.{c}").alias(c) for c in cols], *[F.col(f"_o.{c}").alias(f"parent_{c}") for c in cols])
