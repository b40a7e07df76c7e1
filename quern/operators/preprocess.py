"""Schema mapping per data set to context, prompts and responses: a registry of DataFrame -> DataFrame for df.transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import hash_unit

Mapping = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Mapping] = {}
#: Columns that go on to training.
KEEP = ("context", "prompts", "responses")


def mapping(*names: str):
    def register(f: Mapping) -> Mapping:
        REGISTRY.update(dict.fromkeys(names, f))
        return f

    return register


def preprocess(df: DataFrame, name: str) -> DataFrame:
    """The data set's mapping, singular columns as lists, responses without outer blanks, no rows with a null."""
    df = plural(REGISTRY.get(name, lambda x: x)(df).na.drop("any"))
    return df.select(*(c for c in KEEP if c in df.columns)).withColumn("responses", F.transform("responses", lambda r: F.trim(r)))


def plural(df: DataFrame) -> DataFrame:
    """prompt and response become one-element prompts and responses."""
    for one, many in (("prompt", "prompts"), ("response", "responses")):
        if one in df.columns and many not in df.columns:
            df = df.withColumn(many, F.array(one)).drop(one)
    return df


def _named(context: str, prompt: str, response: Column | str) -> Mapping:
    return lambda df: df.select(F.col(context).alias("context"), F.col(prompt).alias("prompt"), (F.col(response) if isinstance(response, str) else response).alias("response"))


mapping("pwc")(_named("input", "prompt", "answer"))
mapping("squad", "squad_negative", "squad_assistant_ctx")(lambda df: _named("context", "question", F.try_element_at("answers.text", F.lit(1)))(df))
mapping("drop")(lambda df: _named("passage", "question", F.try_element_at("answers_spans.spans", F.lit(1)))(df))
mapping("ropes")(lambda df: df.select(F.concat_ws("\n\n", "background", "situation").alias("context"), F.col("question").alias("prompt"), F.try_element_at("answers.text", F.lit(1)).alias("response")))
mapping("longbench")(lambda df: _named("context", "input", F.try_element_at("answers", F.lit(1)))(df))


@mapping("fw_qa_v2")
def levels(df: DataFrame) -> DataFrame:
    """All prompts_level* and responses_level* in a row, cut to the shorter; null if that is empty."""
    lists = lambda stem: F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<string>")) for c in sorted(df.columns) if c.startswith(stem))))
    both = df.select("context", lists("prompts_level").alias("p"), lists("responses_level").alias("r"))
    n = F.least(F.size("p"), F.size("r"))
    cut = lambda c: F.when(n > 0, F.slice(c, F.lit(1), n))
    return both.select("context", cut("p").alias("prompts"), cut("r").alias("responses"))


def answers_of(df: DataFrame, family: str) -> DataFrame:
    """All reference answers of an evaluation row, as `answers`."""
    column = {"squad": "answers.text", "ropes": "answers.text", "drop": "answers_spans.spans", "longbench": "answers"}[family]
    return df.withColumn("answers", F.col(column))


def flipped(df: DataFrame) -> DataFrame:
    """context and the only prompt change places."""
    return df.select(F.element_at("prompts", 1).alias("context"), F.array("context").alias("prompts"), *(c for c in df.columns if c not in ("context", "prompts")))


def with_closed_template(prompt: Column, key: Column, template: str, probability: float) -> Column:
    """The template with a given probability, by hash."""
    return F.when(hash_unit(key, "closed") < probability, F.replace(F.lit(template), F.lit("{input}"), prompt)).otherwise(prompt)


def expand_aliases(names: list[str], families: dict[str, list[str]]) -> list[str]:
    """Family names become their member tasks."""
    return [m for n in names for m in families.get(n, [n])]
