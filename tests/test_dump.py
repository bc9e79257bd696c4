"""A graph as pages of text: order, nesting, orphans, bounded pages."""

import random

import pytest

from graphloom.graph import PropertyGraph
from graphloom.operators import dump

NODES = [
    ("c2", "Character", "Bob", None, None, {"job": "cook", "__id": "x", "name": "Bob"}), ("c1", "Character", "Ann", None, None, {}),
    ("s1", "CharacterState", "sad", None, None, None), ("s2", "CharacterState", "glad", None, None, None), ("s3", "CharacterState", "lost", None, None, None),
    ("e1", "Event", "fair", 2, 1, {"description": "long"}), ("e2", "Event", "rain", 1, None, None), ("e3", "Event", None, None, None, None),
    ("l1", "Location", "Town", None, None, {"size": "big", "none": ""}), ("l2", "Location", "Land", None, None, None), ("i1", "Item", "Cup", None, None, None),
    ("k1", "Chunk", "text", 7, None, None), ("x1", "Ghost", "g", None, None, None),
]
EDGES = [
    ("c1", "HAS_STATE", "s1", {}), ("c1", "HAS_STATE", "s2", {}), ("s1", "ESTABLISHED_IN", "e1", {}), ("s2", "ESTABLISHED_IN", "e2", {}), ("s2", "EVIDENCED_BY", "k1", {}), ("s3", "EVIDENCED_BY", "k1", {}),
    ("s1", "ABOUT", "i1", {}), ("s1", "ABOUT", "c2", {}), ("s3", "ABOUT", "l1", {}), ("c1", "RELATED_TO", "c2", {"type": "friend", "e": ""}), ("c2", "OWNS", "i1", {"since": "1"}),
    ("l1", "HOSTS", "e1", {}), ("c2", "APPEARS_IN", "e1", {}), ("c1", "APPEARS_IN", "e1", {}), ("l1", "LOCATED_IN", "l2", {}), ("i1", "MADE_IN", "l1", None), ("e2", "BEFORE", "e1", None), ("c1", "HAS_STATE", "gone", {}), ("c1", "IN", "k1", {}),
]
TEXT = """## Characters
- (Character) Ann
  · state: glad (since 1)
  · state: sad (since 2)
    · about: Bob
    · about: Cup
  · related: Bob — type=friend
- (Character) Bob — job=cook
  · OWNS → Item:Cup (since=1)
- (CharacterState, of nobody) lost (since 7)
    · about: Town
## Events
- (Event) ?
- (Event) rain (1)
  · BEFORE → Event:fair
- (Event) fair (2 #1)
  · at: Town
  · with: Ann
  · with: Bob
## Items, locations, organisations
- (Item) Cup
  · MADE_IN → Location:Town
- (Location) Land
- (Location) Town — size=big
  · in: Land
"""


@pytest.fixture
def graph(spark):
    props = "props map<string,string>"
    return PropertyGraph(spark.createDataFrame(NODES, f"id string, label string, name string, chapter int, story_order int, {props}"), spark.createDataFrame(EDGES, f"src string, type string, dst string, {props}"))


def joined(frame):
    return "".join(r["body"] for r in frame.orderBy("page", "section").collect())


def test_text(spark, graph):
    found = dump.lines(graph)
    assert joined(dump.pages(found)) == TEXT
    for size in (2, 7, 40, 100):
        got = dump.pages(found, size)
        assert joined(got) == TEXT and max(len(r["body"]) for r in got.collect()) <= size
    with pytest.raises(ValueError):
        dump.pages(found, 1)


def test_plain_columns_and_empty_graphs(spark, graph):
    bare = PropertyGraph(graph.nodes.select("id", "label", "name"), graph.edges.select("src", "type", "dst"))
    text = joined(dump.pages(dump.lines(bare)))
    assert "- (Event) fair\n" in text and "job" not in text
    none = PropertyGraph(graph.nodes.limit(0), graph.edges.limit(0))
    assert dump.pages(dump.lines(none)).count() == 0


def test_hot_event_long_and_repeated_lines(spark):
    random.seed(1)
    people = [(f"c{i}", "Character", f"N{random.randrange(50)}" * (200 if i == 7 else 1)) for i in range(400)]
    nodes = spark.createDataFrame([*people, ("e", "Event", "all")], "id string, label string, name string")
    edges = spark.createDataFrame([(f"c{i}", "APPEARS_IN", "e") for i in range(400)] + [("c1", "APPEARS_IN", "e")] * 5, "src string, type string, dst string")
    got = dump.pages(dump.lines(PropertyGraph(nodes, edges)), 64)
    text = joined(got)
    assert max(len(r["body"]) for r in got.collect()) <= 64
    names = sorted((n, i) for i, _, n in people + [people[1]] * 5)
    assert text.split("- (Event) all\n")[1] == "".join(f"  · with: {n}\n" for n, _ in names)
