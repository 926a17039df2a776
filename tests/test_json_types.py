"""Built-in JSON reading: only texts that fit together again, and one merged type."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rowlantern import operators as op
from rowlantern.functions import json_split
from rowlantern.functions.json_builtin import parts_of

#: Texts the built-ins must vouch for, and texts they must leave to the reader.
SURE = ['{}', '[]', '{"a":1,"b":[1,{"c":null}],"é":"中文"}', '["x","y z",true,false,null,-1.5,[],{}]', '5', '"plain"', 'null',
        '{"a":"line\\nbreak","q":"say \\"hi\\""}', '{"k":{"z":1,"a":2,"z":3}}', '{"a":1,"a":2}', '["12 monkeys","-","t"]']
DOUBTFUL = ['{"a": 1}', ' {}', '{"a":1.50}', '[2e5]', '{"a":"\\/"}', '{"a":"\\u0041"}', "{'a':1}", '{"a":NaN}', '{"a":1} x',
            '{"a":', '', 'x', '[1,]', '["007",007]', '["123"]', '{"a":"[b]"}', '[12345678901234567890123.4500]', '"a\\nb"']


def test_what_the_built_ins_vouch_for(spark):
    df = spark.createDataFrame([(t,) for t in SURE + DOUBTFUL], "t string")
    for r in df.select("t", parts_of(F.col("t")).alias("p")).collect():
        assert (r.p is not None) == (r.t in SURE), r.t
        if r.p is not None:
            assert [(x.seg, x.text) for x in r.p] == [(s, r.t[a:b]) for s, a, b in json_split.children(r.t)
                                                      if r.t[0] in "{["]


def tree(rng, depth):
    pick = rng.randrange(9 if depth else 6)
    if pick < 6:
        return [None, True, rng.randrange(-99, 99), rng.random(), rng.choice(["", "a b", "1", "[x]", "é\n", '"']), "t"][pick]
    if pick == 6:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcdé.") * rng.randrange(1, 3): tree(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_nodes_equal_the_walk(spark):
    """Built-in levels and the walk in Python give the same rows, whichever reads a record."""
    rng = random.Random(8)
    texts = [json.dumps(tree(rng, 5), ensure_ascii=rng.random() < 0.3, separators=rng.choice([(",", ":"), (", ", ": ")]))
             for _ in range(300)] + SURE + DOUBTFUL + ["[" * 12 + "]" * 12, None]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, raw string")
    for bound in (None, 0, 2):
        got = [tuple(r) for r in op.nodes(df, max_depth=bound).collect()]
        # A space behind a text leaves it to the walk.
        spaced = df.withColumn("raw", F.concat("raw", F.lit(" ")))
        want = [tuple(r) for r in op.nodes(spaced, max_depth=bound).collect()]
        def shown(rows):
            # The place of an error may lie behind the space.
            return sorted(repr((*r[:-1], r[-1] and r[-1][:9])) for r in rows)

        assert shown(got) == shown(want)


def test_clean_records_need_no_python_rows(spark):
    df = spark.createDataFrame([(0, '{"a":[1,2]}')], "record_id long, raw string")
    plan = op.children(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "CASE WHEN NOT _sure" in plan


def test_merged_schema(spark):
    texts = ['{"a":1,"b":{"c":"x"}}', '{"a":2.5,"b":{"d":[1]},"VOID":null}', '{"a":3,"o d":true,"e":1}', '{"e":"mixed"}',
             "not JSON", None]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, raw string").repartition(3)
    ddl = op.merged_schema(df)
    rows = {r.record_id: r.value for r in op.read_typed(df, ddl).collect()}
    assert float(rows[0].a) == 1 and rows[0].b.c == "x" and rows[1].b.d == [1] and rows[2]["o d"] is True
    assert rows[1]["VOID"] is None and "VARIANT" in ddl and rows[5] is None
    kinds = {f.name: f.dataType.simpleString() for f in op.read_typed(df, ddl).schema["value"].dataType.fields}
    assert kinds["VOID"] == "string" and kinds["e"] == "variant"
    for none in (["1", "2"], ["x"], []):
        with pytest.raises(ValueError):
            op.merged_schema(spark.createDataFrame([(t,) for t in none], "raw string"))
