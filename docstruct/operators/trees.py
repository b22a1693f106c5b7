"""JSON records as rows of nodes.

The nesting of a record is data, so no fixed plan can follow it: a generator over the parsed text walks it
with a worklist, of any depth, one record at a time; everything after that is rows and Column work. Where a
record is scored, its reference travels in the same row and both are walked together.

A repeated key keeps its last value. Records that are no valid JSON, or nested deeper than Python's reader
goes, give nothing.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.functions.text import EMPTY_TEXTS
from docstruct.labels import CONTAINMENT_THRESHOLD

# Keys that may hold one object or a list of them.
ONE_OR_MANY = ["contact_id", "contributor_id", "creator_id", "metadata_standard_id"]
# What identifies a list item, in order of preference.
ITEM_KEYS = ["title", "name", "identifier", "license_ref"]

ROWS_AT_ONCE = 50_000
ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def nodes(records: DataFrame, raw: str, keys: Sequence[str]) -> DataFrame:
    """One row per node of each record: keys, path, kind (object, list, leaf), size, names (of an
    object's members), value (of a leaf, as text). The root's path is empty."""
    columns = "path string, kind string, size int, names array<string>, value string, is_number boolean"
    rows = _generated(records.select(*keys, F.col(raw).alias("_raw")), keys, 1, columns, _nodes_of)
    return rows.withColumn("value", _text_of("value", "is_number")).drop("is_number")


def leaf_rows(records: DataFrame, raw: str, keys: Sequence[str]) -> DataFrame:
    """One row per leaf of each record: keys, path, value (as text). Containers give none."""
    rows = _generated(records.select(*keys, F.col(raw).alias("_raw")), keys, 1, "path string, value string, is_number boolean", _leaves_of)
    return rows.withColumn("value", _text_of("value", "is_number")).drop("is_number")


def key_counts(records: DataFrame, raw: str) -> DataFrame:
    """Rows (key, n) of the keys of all objects in the records, counted a batch of records at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for raw in batch.column(0).to_pylist():
                work = [parsed(raw)[1]]
                while work:
                    node = work.pop()
                    if isinstance(node, dict):
                        seen.update(node.keys())
                    if isinstance(node, (dict, list)):
                        work.extend(x for x in (node.values() if isinstance(node, dict) else node) if isinstance(x, (dict, list)))
            keys = pa.array([_scalar(k)[0] for k in seen], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(seen.values(), pa.int64())], ["key", "n"])

    return records.select(raw).mapInArrow(run, "key string, n bigint")


def paired_leaves(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The leaves of each record and of its reference side by side, from rows (keys, record text,
    reference text): path (on the reference's indices), mpath (null: the record has no such leaf),
    value, ref_value. The record must be an object; a reference that is no valid JSON has no leaves."""
    columns = "path string, mpath string, value string, is_number boolean, ref_value string, ref_is_number boolean"
    rows = _generated(both, keys, 2, columns, _pairs_of)
    return rows.withColumns({"value": _text_of("value", "is_number"), "ref_value": _text_of("ref_value", "ref_is_number")}).drop("is_number", "ref_is_number")


def _text_of(value: str, is_number: str) -> Column:
    """Numbers in the spelling that casts give; texts as they are."""
    return F.when(F.col(is_number), F.try_variant_get(F.try_parse_json(F.when(F.col(is_number), F.col(value))), "$", "string")).otherwise(F.col(value))


def _generated(rows: DataFrame, keys: Sequence[str], texts: int, columns: str, walk) -> DataFrame:
    """Rows (keys, *columns*) that *walk* yields for the last *texts* columns of each row."""
    names = list(keys)
    made, kinds = zip(*[(c.split()[0], ARROW[c.split()[1]]) for c in columns.split(", ")])
    schema = f"{rows.select(*names)._jdf.schema().toDDL()}, {columns}" if names else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(batch: pa.RecordBatch, of: list[int], found: list[tuple]) -> pa.RecordBatch:
            at = pa.array(of, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(n).take(at) for n in names] + [pa.array(c, k) for c, k in zip(zip(*found), kinds)], [*names, *made]
            )

        for batch in batches:
            of: list[int] = []
            found: list[tuple] = []
            raws = [batch.column(len(names) + i).to_pylist() for i in range(texts)]
            for row, given in enumerate(zip(*raws)):
                for line in walk(*given):
                    of.append(row)
                    found.append(line)
                if len(of) >= ROWS_AT_ONCE:
                    yield block(batch, of, found)
                    of, found = [], []
            if of:
                yield block(batch, of, found)

    return rows.mapInArrow(run, schema)


class Number(str):
    """A number as it is spelt in the text."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parsed(raw: str | None):
    """(valid, tree)."""
    try:
        return True, json.loads(raw or "", parse_int=Number, parse_float=Number, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False, None


def _scalar(node) -> tuple[str | None, bool]:
    if node is None:
        return None, False
    if isinstance(node, bool):
        return ("true" if node else "false"), False
    # A lone half of a surrogate pair has no UTF-8 form.
    return (node if node.isascii() else node.encode("utf-8", "replace").decode("utf-8")), isinstance(node, Number)


def _inside(path: str, node) -> Iterator[tuple[str, object]]:
    """Children with their paths. One object where a list is allowed counts as a list of one."""
    if isinstance(node, dict):
        for key, child in node.items():
            yield (f"{path}.{key}" if path else key), [child] if key in ONE_OR_MANY and isinstance(child, dict) else child
    else:
        for i, child in enumerate(node):
            yield f"{path}[{i}]", child


def _nodes_of(raw: str | None) -> Iterator[tuple]:
    valid, tree = parsed(raw)
    work = [("", tree)] if valid else []
    while work:
        path, node = work.pop()
        if isinstance(node, (dict, list)):
            is_object = isinstance(node, dict)
            yield path, "object" if is_object else "list", len(node), list(node) if is_object else None, None, False
            work.extend(_inside(path, node))
        else:
            yield path, "leaf", None, None, *_scalar(node)


def _leaf_values(tree) -> Iterator[tuple[str, object]]:
    work = [("", tree)]
    while work:
        path, node = work.pop()
        if isinstance(node, (dict, list)):
            work.extend(_inside(path, node))
        else:
            yield path, node


def _leaves_of(raw: str | None) -> Iterator[tuple]:
    valid, tree = parsed(raw)
    return ((path, *_scalar(node)) for path, node in (_leaf_values(tree) if valid else ()))


def _pairs_of(raw: str | None, ref_raw: str | None) -> Iterator[tuple]:
    valid, tree = parsed(raw)
    if not valid or not isinstance(tree, dict):
        return
    has_ref, ref = parsed(ref_raw)
    unmet = dict(_leaf_values(ref)) if has_ref and isinstance(ref, (dict, list)) else {}
    work = [("", "", tree, ref)]
    while work:
        path, mpath, node, twin = work.pop()
        if isinstance(node, dict):
            twins = twin if isinstance(twin, dict) else {}
            for key, child in node.items():
                other = twins.get(key)
                if key in ONE_OR_MANY:
                    child, other = ([x] if isinstance(x, dict) else x for x in (child, other))
                at = f"{path}.{key}" if path else key
                work.append((at, at if mpath == path else f"{mpath}.{key}" if mpath else key, child, other))
        elif isinstance(node, list):
            twins = twin if isinstance(twin, list) else []
            # One item on each side, or none on the other, leaves nothing to pair.
            alone = not twins or len(node) == len(twins) == 1
            places = range(len(node)) if alone else pair_lists([item_keys(x) for x in node], [item_keys(x) for x in twins])
            for i, (child, j) in enumerate(zip(node, places)):
                work.append((f"{path}[{j}]", f"{mpath}[{i}]", child, twins[j] if j < len(twins) else None))
        else:
            yield path, mpath, *_scalar(node), *_scalar(unmet.pop(path, None))
    for path, node in unmet.items():
        yield path, None, None, False, *_scalar(node)


# ---- list items --------------------------------------------------------------------------


def list_keys(records: DataFrame, raw: str, keys: Sequence[str], at: str) -> DataFrame:
    """Rows (keys, item, item_keys) for the items of the list at the dotted path *at* of each record."""
    walk = lambda text: enumerate(map(item_keys, _list_at(parsed(text)[1], at)))
    return _generated(records.select(*keys, raw), keys, 1, "item int, item_keys array<string>", walk)


def list_pairs(both: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows (keys, mapping): the reference index of every item of the record's list at *at*, from
    rows (keys, record text, reference text)."""
    def walk(text: str | None, ref_text: str | None) -> list[tuple]:
        mine, theirs = ([item_keys(x) for x in _list_at(parsed(t)[1], at)] for t in (text, ref_text))
        return [(pair_lists(mine, theirs),)] if mine else []

    return _generated(both, keys, 2, "mapping array<int>", walk)


def _list_at(node, at: str) -> list:
    for key in at.split("."):
        node = dict(_inside("", node)).get(key) if isinstance(node, dict) else None
    return node if isinstance(node, list) else []


def item_keys(item) -> list[str]:
    """The normalised values that identify a list item, best first, the host's title last."""
    host = item.get("host") if isinstance(item, dict) else None
    values = [item.get(k) for k in ITEM_KEYS] + [host.get("title") if isinstance(host, dict) else None] if isinstance(item, dict) else [item]
    out = []
    for value in values:
        text = json.dumps(value) if isinstance(value, (dict, list)) and value else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else ""
        text = " ".join(text.split()).lower()
        if text not in EMPTY_TEXTS:
            out.append(text)
    return out


def pair_lists(model: Sequence[Sequence[str]], ref: Sequence[Sequence[str]]) -> list[int]:
    """The reference index of every model item, from the items' keys.

    In turn: an equal key; a key whose words lie in a reference key (containment 0.75); the same
    position if free, else the first free slot, else a new index behind the reference's. Each
    reference item is taken once, in model order. Equal keys meet in a map; only what is left is
    compared by words, and only with keys that share one of its rarer words.
    """
    owner: dict[str, int] = {}
    for j, keys in enumerate(ref):
        for k in keys:
            owner.setdefault(k, j)
    out: list[int | None] = [None] * len(model)
    taken: set[int] = set()

    def claim(i: int, j: int | None) -> bool:
        if j is not None and j not in taken:
            out[i] = j
            taken.add(j)
        return out[i] is not None

    for i, keys in enumerate(model):
        any(claim(i, owner.get(k)) for k in keys)
    left = [i for i, keys in enumerate(model) if out[i] is None and keys]
    if left and len(taken) < len(ref):
        names = list(owner)
        words = [_words(k) for k in names]
        holders: dict[str, list[int]] = {}
        for at, some in enumerate(words):
            for w in some:
                holders.setdefault(w, []).append(at)

        def close(k: str) -> int | None:
            mine = _words(k)
            need = -(-len(mine) * int(CONTAINMENT_THRESHOLD * 100) // 100)
            rare = sorted(mine, key=lambda w: len(holders.get(w, ())))[: len(mine) - need + 1]
            near = {at for w in rare for at in holders.get(w, ()) if owner[names[at]] not in taken}
            return next((owner[names[at]] for at in sorted(near) if len(mine & words[at]) >= need), None)

        for i in left:
            any(claim(i, close(k)) for k in model[i])
    slot, behind = 0, len(ref)
    beyond = 0  # indices behind the reference's that are taken
    for i in range(len(model)):
        if out[i] is not None:
            continue
        while slot < len(ref) and slot in taken:
            slot += 1
        out[i] = i if i not in taken else slot if slot < len(ref) else behind + beyond
        taken.add(out[i])
        beyond += out[i] >= len(ref)
    return out


def _words(text: str) -> set[str]:
    return set(re.findall("[a-z0-9]+", text))
