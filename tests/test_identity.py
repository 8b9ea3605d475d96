"""Entities of a credit and the remapping of ids, on rows with results found by hand."""

import uuid

from lodestream.functions import text as t
from lodestream.operators import identity


def made(name: str) -> str:
    return str(uuid.uuid5(uuid.UUID(t.NAMESPACE), name.lower()))


def test_entities(spark):
    rows = [(1, "A feat. B", ["x"]), (2, "A", ["x", "y", "x", " "]), (3, "A & Known", None), (4, None, ["z"]), (5, "", []), (6, "A & B", ["p", "q", "r"]), (7, "A & a", [])]
    df = spark.createDataFrame(rows, "k int, name string, ids array<string>")
    alias = spark.createDataFrame([("known", "kid")], "token string, entity_id string")
    got = {}
    for r in identity.entities(df, "k", "name", "ids", alias).orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.entity_id, r.entity_name, r.derived))
    assert got == {
        1: [("x", "A", False), (made("b"), "B", True)],
        2: [("x", "A", False), ("y", "A", False)],
        3: [(made("a"), "A", True), ("kid", "Known", False)],
        4: [("z", None, False)],
        6: [("p", "A", False), ("q", "B", False), ("r", None, False)],
        7: [(made("a"), "A", True)],
    }


def test_remap(spark):
    rows = [(1, "a", "X & Y"), (2, "b", "Y"), (3, "c", "Z & Y"), (4, "d", "Z & W"), (5, "e", "Q & W"), (6, "f", None)]
    got = identity.remap(spark.createDataFrame(rows, "seq int, entity_id string, name string"))
    w = made("w")
    assert sorted(map(tuple, got.collect())) == sorted(
        [("a", "a", "X", False), ("a", "b", "Y", False), ("b", "b", "Y", False), ("c", "c", "Z", False), ("c", "b", "Y", False), ("d", "c", "Z", False), ("d", w, "W", True), ("e", "e", "Q", False), ("e", w, "W", False), ("f", "f", None, False)]
    )
