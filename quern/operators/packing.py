"""Greedy packing in order under two capacities, per batch; the state is small, so a batch is one streamed group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packs(lengths: list[int], ctx_lengths: list[int], most: int, most_ctx: int, most_items: int = -1) -> list[int]:
    """Pack number of each item from 0; -1 for an item that fits no pack, which also closes the open one."""
    out, pack, used, used_ctx, n = [], -1, 0, 0, 0
    is_open = False
    for a, c in zip(lengths, ctx_lengths, strict=True):
        if a > most or c > most_ctx:
            out.append(-1)
            is_open = False
            continue
        if not is_open or used + a > most or used_ctx + c > most_ctx or (most_items > 0 and n >= most_items):
            pack, used, used_ctx, n, is_open = pack + 1, 0, 0, 0, True
        used, used_ctx, n = used + a, used_ctx + c, n + 1
        out.append(pack)
    return out


def pack_greedy(items: DataFrame, most: int, most_ctx: int, most_items: int = -1) -> DataFrame:
    """batch_id, pos, pack from (batch_id, pos, len, ctx_len). Batches are bounded by the caller, as in the training loader."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pdf["pack"] = packs(pdf["len"].tolist(), pdf["ctx_len"].tolist(), most, most_ctx, most_items)
        return pdf[["batch_id", "pos", "len", "ctx_len", "pack"]]

    return items.groupBy("batch_id").applyInPandas(run, "batch_id long, pos long, len long, ctx_len long, pack long")


def qa_batches(lengths: list[int], most: int, most_items: int) -> list[int]:
    """Batch number of each question within one context; -1 for one that is too long by itself. A context within both limits stays one batch."""
    if (most < 0 or sum(lengths) <= most) and (most_items < 0 or len(lengths) <= most_items):
        return [0] * len(lengths)
    out, batch, used, n = [], 0, 0, 0
    for a in lengths:
        if 0 < most < a:
            out.append(-1)
            continue
        if not ((most < 0 or used + a <= most) and (most_items < 0 or n < most_items)):
            batch, used, n = batch + (n > 0), 0, 0
        used, n = used + a, n + 1
        out.append(batch)
    return out


def batch_questions(items: DataFrame, by: list[str], most: int, most_items: int) -> DataFrame:
    """Adds `batch` to (by..., pos, len): questions of one context in order."""
    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pdf["batch"] = qa_batches(pdf["len"].tolist(), most, most_items)
        return pdf[[*by, "pos", "len", "batch"]]

    return items.select(*by, F.col("pos").cast("long"), F.col("len").cast("long")).groupBy(*by).applyInPandas(run, f"{kinds}, pos long, len long, batch long")
