"""JSON-LD of any depth and shape, and the names that SQL can call."""

import json
import random

import pytest

from eventloom.functions import html as H
from eventloom.functions import jsonld as D
from eventloom.functions.sql import register


def recursive(value):
    """The order as it is defined: a graph, the object, its members with the graph again."""
    if isinstance(value, list):
        return [x for v in value for x in recursive(v)]
    if not isinstance(value, dict):
        return []
    graph = recursive(value["@graph"]) if "@graph" in value else []
    return graph + [value] + [x for v in value.values() for x in recursive(v)]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 5 else 4)
    if kind < 4:
        return rng.choice([1, -2.5, 1e30, "a", "é\\\"\n", True, False, None, "Event", ""])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["@graph", "@type", "a", "b"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_walk_is_the_recursive_order():
    rng = random.Random(1)
    for _ in range(3_000):
        v = value(rng)
        if isinstance(v, (dict, list)):
            assert list(D.walk(v)) == recursive(v)
            once, seen = list(D.walk(v, again=False)), []
            for x in recursive(v):
                if not any(x is y for y in seen):
                    seen.append(x)
            assert [id(x) for x in once] == [id(x) for x in seen]


def test_reading_without_recursion():
    rng = random.Random(2)
    for _ in range(2_000):
        v = value(rng)
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert json.dumps(D._deep(text)) == json.dumps(json.loads(text))
        cut = list(text)
        for _ in range(rng.randint(1, 3)):
            cut[rng.randrange(len(cut))] = rng.choice(['"', "{", "}", "[", "]", ",", ":", "1", " ", "x"])
        bad = "".join(cut)
        try:
            want = json.loads(bad)
        except ValueError:
            with pytest.raises(ValueError):
                D._deep(bad)
        else:
            assert json.dumps(D._deep(bad)) == json.dumps(want)


@pytest.mark.parametrize("depth", [900, 5_000, 50_000])
def test_a_deep_script_gives_a_row(spark, depth):
    deep = '{"a":[' * depth + '{"@type":"Event","n":"in"}' + "]}" * depth
    around = '{"@type":"Event","n":"out","deep":' + '{"a":' * depth + "1" + "}" * depth + "}"
    graphs = '{"@graph":[' * 60 + '{"@type":"Thing"}' + "]}" * 60
    page = lambda j: f'<script type="application/ld+json">{j}</script>'
    rows = [(0, page(deep)), (1, page(around)), (2, page("[" * depth)), (3, page(graphs) + page(around)), (4, page("{bad") + page('{"@type":["x",["music EVENT"]]}'))]
    got = {r.id: r.objects for r in spark.createDataFrame(rows, "id int, html string").select("id", H.parse_html("html").alias("p")).select("id", "p.objects").collect()}
    assert [json.loads(x)["n"] for i in (0, 1, 3) for x in got[i]] == ["in", "out", "out"] and got[2] == [] and len(got[4]) == 1
    assert len(got[1][0]) < 2_000  # what lies too deep for any reader is not handed on


def test_typed_members():
    assert D.typed_members(None) is None and D.typed_members("[1") is None and D.typed_members("3") == []
    assert D.typed_members('{"@graph":[{"@type":"A","x":1}],"@type":"B","y":[1],"z":null}') == [{"@type": "A", "x": "1"}, {"@type": "B", "z": "null"}]
    assert [D.is_event(x) for x in ("Event", "MusicEvent", "Eventful", ["x", ["event"]], [], None, 3, {"a": "event"}, " social  event ")] == [True, True, False, True, False, False, False, False, True]


def test_names_for_sql(spark):
    register(spark)
    html = '<div>around <a href="/x">one <b>two</b></a></div><a href="http://[">bad</a>'
    spark.createDataFrame([("https://e.org/a", html), ("https://e.org/b", None)], "url string, html string").createOrReplaceTempView("t_pages")
    rows = spark.sql("select l.* from t_pages p, lateral extract_links(p.html, p.url) l order by pos").collect()
    assert [tuple(r)[:4] for r in rows] == [(0, "/x", "https://e.org/x", "one two"), (1, "http://[", None, "bad")] and rows[0].context.startswith("around")
    one = spark.sql("select absolute_url('https://e.org/a/b', '../c') as u, plain_text('<i>R&amp;D</i>  x') as t, jsonld_objects('{\"@type\":\"E\"}')[0]['@type'] as k").first()
    assert tuple(one) == ("https://e.org/c", "R&D x", "E")
