from pyspark.sql import functions as F

from quern.functions.encoders import bridge_terms, encode
from quern.operators import preprocess as P


def test_mappings(spark):
    squad = spark.createDataFrame([("c", "q", (["a ", "b"],)), ("d", None, (["x"],))], "context string, question string, answers struct<text:array<string>>")
    assert [tuple(r) for r in P.preprocess(squad, "squad").collect()] == [("c", ["q"], ["a"])]
    levels = spark.createDataFrame([("c", ["p"], ["q", "r"], ["a", "b"], None), ("d", [], [], [], [])], "context string, prompts_level1 array<string>, prompts_level2 array<string>, responses_level1 array<string>, responses_level2 array<string>")
    assert [tuple(r) for r in P.preprocess(levels, "fw_qa_v2").collect()] == [("c", ["p", "q"], ["a", "b"])]
    flat = spark.createDataFrame([("c", "p", "r")], "context string, prompt string, response string")
    assert P.flipped(P.preprocess(flat, "other")).first()["context"] == "p"
    assert P.expand_aliases(["a", "f"], {"f": ["x", "y"]}) == ["a", "x", "y"]


def test_encoders(spark):
    df = spark.createDataFrame([("the quick brown fox",), (None,)], "t string")
    rows = df.select(encode(F.col("t"), prefix="query: ").alias("v"), bridge_terms(F.split("t", " "), ["the"], 2).alias("b")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-5 and rows[0]["b"] == ["brown", "quick"]
