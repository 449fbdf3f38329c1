"""One broken category at a time."""

from chromaspan.operators import isolation

STAGES = {"a": "array<bigint>", "b": "array<struct<x: string>>"}


def test_broken_stages_leave_the_rest(spark):
    docs = ['{"a": [1, 2], "b": [{"x": "p"}]}', '{"a": "boom", "b": [{"x": "p"}]}', '{"a": [1], "b": {"x": 1}}', '{"a": [1, "z"], "b": null}', "{", None, "{}", '{"a": [], "b": [], "c": 1}', '{"a": [null, 3]}', "[]"]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, json string")
    out = isolation.isolated(rows, STAGES)
    got = {r["k"]: (r["a"], [x["x"] for x in r["b"]], [e["stage"] for e in r["errors"]]) for r in out.collect()}
    assert got == {0: ([1, 2], ["p"], []), 1: ([], ["p"], ["a"]), 2: ([1], [], ["b"]), 3: ([], [], ["a"]), 4: ([], [], ["document"]), 5: ([], [], []), 6: ([], [], []), 7: ([], [], []), 8: ([None, 3], [], []), 9: ([], [], [])}
    assert {(r["k"], r["stage"]) for r in isolation.errors(out, "k").collect()} == {(1, "a"), (2, "b"), (3, "a"), (4, "document")}
