"""Records rebuilt from nodes and bridge rows are the records."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import nested
from docloom.queries import problems

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


def rebuild(node, kinds, below):
    kind, content = kinds[node]
    if kind == "object":
        return {f: rebuild(c, kinds, below) for f, _, c in below.get(node, [])}
    if kind == "array":
        return [rebuild(c, kinds, below) for _, _, c in sorted(below.get(node, []), key=lambda x: x[1])]
    return nested.sound(content)


def tables(rows):
    kinds, below = {}, {}
    for kind, _, _, path, pos, parent, child, node_type, content in rows:
        if kind == "node":
            kinds[child] = (node_type, content)
        elif kind == "bridge":
            below.setdefault(parent, []).append((path, pos, child))
    return kinds, below


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_any_value(value):
    s = nested.Shredder([])
    root = s.identity(value)
    kinds, below = tables(s.rows)
    assert rebuild(root, kinds, below) == nested.sound(json.dumps(value))


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_the_deep_parser_reads_the_same(value):
    for text in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False)):
        assert nested.deep(text) == nested.sound(text)


@pytest.mark.parametrize("text", ["", "[", "[1", "[1,", "[1,]", "[1 2]", "{", '{"a"', '{"a":', '{"a":1', '{"a":1,', '{"a":1,}', "{1:2}", "[01]", "[1.]", "[.5]", "[NaN]", "[-Infinity]", "[tru]", '["\\x"]', '["a', "[1]]", "[1] x", "]", '["\t"]'])
def test_unsound_texts(text):
    for parse in (nested.sound, nested.deep):
        with pytest.raises(ValueError):
            parse(text)


@pytest.mark.parametrize("levels", [900, 5_000, 50_000])
def test_any_depth(levels):
    s = nested.Shredder([("jsonArray",)])
    for text in ('{"jsonArray":[' + "[" * levels + "]" * levels + ',"x"]}', '{"jsonArray":[' + '{"a":' * levels + "0" + "}" * levels + ',"x"]}'):
        s.rows = []
        s.record("t", "r", nested.sound(text))
        assert [r[4] for r in s.rows if r[0] == "occurrence"] == [0, 1]
    assert len(s.known) > 2 * levels - 5


def test_numbers_keep_their_value():
    one = {}
    for text in ("0.1", "0.1000000000000000055", "12345678901234567890.5", "1e400", "1", "1.0", "1e0", "10e-1", "-0", "0.0", "100", "1e2", "1" + "0" * 60, "1e60", "-2.50", "1e-400", "1E+2"):
        s = nested.Shredder([])
        one[text] = s.identity(nested.sound(text)), json.loads(s.rows[0][-1].join("[]"), parse_float=str, parse_int=str)[0]
    same = lambda *xs: len({one[x][0] for x in xs}) == 1
    assert same("1", "1.0", "1e0", "10e-1") and same("-0", "0.0") and same("100", "1e2", "1E+2") and same("1" + "0" * 60, "1e60")
    assert not same("0.1", "0.1000000000000000055") and not same("1e400", "1e-400")
    assert one["0.1000000000000000055"][1] == "0.1000000000000000055" and one["12345678901234567890.5"][1] == "12345678901234567890.5" and one["1e400"][1] == "1e400" and one["-2.50"][1] == "-2.5"
    assert nested.Shredder([]).identity("1") != one["1"][0]


def test_all_records(spark, data):
    df = problems.records(spark, data)
    flat = nested.Flat(df, problems.ARRAYS)
    kinds = {r.child: (r.node_type, r.content) for r in flat.nodes.collect()}
    below = {}
    for r in flat.bridge.collect():
        below.setdefault(r.parent, []).append((r.field, r.pos, r.child))
    want = {}
    for r in df.collect():
        try:
            want[r.table_name, r.row_id] = nested.as_container(nested.sound(r.payload or ""))
        except ValueError:
            pass
    got = {(r.table_name, r.row_id): rebuild(r.child, kinds, below) for r in flat.roots.collect()}
    assert got == want and len(kinds) < sum(map(len, below.values())) + len(want)


def test_occurrences_come_from_nodes_stored_once(spark, data):
    df = problems.records(spark, data)
    flat = nested.Flat(df.repartition(4).unionAll(df.repartition(3)), problems.ARRAYS)
    got = [tuple(r) for r in flat.occurrences.collect()]
    stored = [r.child for r in flat.rows.where("kind = 'node'").collect()]
    assert len(stored) == len(set(stored)) and {r[-1] for r in got} <= set(stored)
    below = {(r.parent, r.pos): r.child for r in flat.bridge.where("field = ''").collect()}
    want = sorted((r.table_name, r.row_id, r.array_path, pos, child) for r in flat.places.collect() for (parent, pos), child in below.items() if parent == r.child and child != nested.NULL)
    assert sorted(got) == want and len(set(got)) * 2 == len(got)
    assert "Join" in problems.p3_found(spark, data)._jdf.queryExecution().optimizedPlan().toString()
