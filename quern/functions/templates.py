"""Prompt templates and the names of the data sets that they are for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import hash_int, hash_unit

#: Templates for training on short answers.
CLOSED_QA = (
    "Answer the question based on the given passages. Only give me the answer and do not output any other words.\n\nQuestion: {input}",
    "Answer without any explanation.\n\nQuestion: {input}",
    "Based on the provided text, what is the answer to the following question? Provide only the answer.\n\nQuestion: {input}",
    "Extract the answer to the question from the text. Be concise. Do not explain.\n\nQuestion: {input}",
    "What is the answer to this question, based on the context? Respond with the answer only.\n\nQuestion: {input}",
    "Provide a direct answer to the question using the given passages. Do not give any explanation.\n\nQuestion: {input}",
    "Answer the question using only information from the provided text. No extra words.\n\nQuestion: {input}",
    "From the passages, answer the question. Just the answer, please.\n\nQuestion: {input}",
    "Give the answer to the question. Do not include any other text.\n\nQuestion: {input}",
    "The answer to the question is in the text. Find it and state it clearly. No need for explanation.\n\nQuestion: {input}",
    "Concisely answer the question based on the text provided. Don't include any other words. Just the answer.\n\nQuestion: {input}",
    "Read the passages and answer the question with the minimal necessary words.\n\nQuestion: {input}",
    "What is the direct response to the question, according to the text? Avoid explanation.\n\nQuestion: {input}",
    "Please provide only the answer to the question, derived from the text.\n\nQuestion: {input}",
    "Using the provided context, answer the question. Output the answer and nothing else.\n\nQuestion: {input}",
    "Identify the answer in the text and present it without elaboration.\n\nQuestion: {input}",
    "Answer the following question based on the text. Your answer should be brief and to the point. No explanation.\n\nQuestion: {input}",
    "Based on the information given, what is the answer to the question? Only state the answer.\n\nQuestion: {input}",
    "Find the answer to the question in the provided passages and write it down. No explanations.\n\nQuestion: {input}",
    "The question is: {input}. Provide the answer based on the text, and nothing more.",
    "Question: {input}\nAnswer directly based on the text provided. No extra words.",
    "Question: {input}\nPlease provide the answer based on the text. No explanation is needed.",
)
#: Templates for evaluation, by data set.
_PLAIN = "Answer the following question. Output only the answer and do not output any other words.\n\nQuestion: {input}"
EVALUATION = {
    "ropes": _PLAIN,
    "drop": _PLAIN,
    "squad": _PLAIN,
    "squad_negative": _PLAIN,
    "squad_assistant_ctx": _PLAIN,
    "squad_negative_no_passage": _PLAIN,
    "squad_assistant_ctx_no_passage": _PLAIN,
    "longbench/qasper": 'Answer the question as concisely as you can, using a single phrase or sentence if possible.\nIf the question cannot be answered based on the information in the article, write "unanswerable".\nIf the question is a yes/no question, answer "yes", "no", or "unanswerable". Do not provide any explanation.\n\nQuestion: {input}',
    "longbench/multifieldqa_en": "Answer the following question. Only output the answer and do not output any other words.\n\nQuestion: {input}",
    "longbench/2wikimqa": "Answer the following question. Only output the answer and do not output any other words.\n\nQuestion: {input}",
}
#: Retrieval prompts, for full and for short answers.
RAG_FULL = "Answer the question fully and completely based on the given passages. Your answer should cover all relevant aspects and may be multiple sentences, but keep it concise. If the passages do not contain enough information to answer, reply with exactly: answer not in context.\n\nPassages:\n{context}\n\nQuestion: {input}"
RAG_SHORT = "Answer the question using only the given passages. If the passages do not contain the answer, reply with exactly: answer not in context. Otherwise give only the answer and do not output any other words.\n\nPassages:\n{context}\n\nQuestion: {input}"
#: Data sets whose answers are short, and those that have several.
CLOSED_QA_SETS = (
    "longbench/qasper",
    "longbench/multifieldqa_en",
    "longbench/2wikimqa",
    "squad",
    "squad_negative",
    "squad_assistant_ctx",
    "squad_negative_no_passage",
    "squad_assistant_ctx_no_passage",
    "ropes",
    "drop",
)
MULTI_ANSWER_SETS = (
    "longbench/qasper",
    "longbench/multifieldqa_en",
    "longbench/hotpotqa",
    "longbench/2wikimqa",
    "squad",
    "squad_negative",
    "squad_assistant_ctx",
    "squad_negative_no_passage",
    "squad_assistant_ctx_no_passage",
    "drop",
)


def member_of(name: Column, sets: tuple[str, ...]) -> Column:
    """Whether a data set's name, or the name its `_e` variant is made from, is in `sets`."""
    even = F.startswith(name, F.lit("longbench/")) & F.endswith(name, F.lit("_e"))
    return F.when(even, F.regexp_replace(name, "_e$", "")).otherwise(name).isin(*sets)


def filled(template: Column | str, prompt: Column, context: Column | None = None) -> Column:
    made = F.lit(template) if isinstance(template, str) else template
    if context is not None:
        made = F.replace(made, F.lit("{context}"), context)
    return F.replace(made, F.lit("{input}"), prompt)


def closed_qa(prompt: Column, key: Column, probability: float) -> Column:
    """One of the templates, picked by hash, with a given probability; else the prompt alone."""
    pick = F.element_at(F.array(*map(F.lit, CLOSED_QA)), (hash_int(key, "template", F.lit(len(CLOSED_QA))) + 1).cast("int"))
    return F.when(hash_unit(key, "closed") < probability, filled(pick, prompt)).otherwise(prompt)


def evaluation(name: Column, prompt: Column) -> Column:
    """The template of a data set, or of the one its `_e` variant is made from; without one the prompt alone."""
    base = F.when(F.startswith(name, F.lit("longbench/")), F.regexp_replace(name, "_e$", "")).otherwise(name)
    known = F.create_map(*(F.lit(x) for pair in EVALUATION.items() for x in pair))
    return F.coalesce(filled(F.try_element_at(known, base), prompt), prompt)
