"""Operator 3: training masks of conversations, aligned by offsets.

A conversation is rendered whole by a template, encoded once, and every token takes the span of characters it stands
for. Turn spans and token spans are both sorted, so the tokens of each turn are found by two binary searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import portions

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@dataclass(frozen=True)
class Template:
    """header and footer surround each turn's text; {role} in the header is the turn's role."""

    header: str = "<|{role}|>\n"
    footer: str = "<|end|>\n"
    #: Roles whose text, with its footer, is trained on.
    trained: tuple[str, ...] = ("assistant",)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
        """The whole text, and the (start, end) of each trained turn's text and footer; sorted and disjoint."""
        parts, at, spans = [], 0, []
        for role, text in turns:
            head = self.header.replace("{role}", role)
            body = text + self.footer
            parts += [head, body]
            if role in self.trained:
                spans.append((at + len(head), at + len(head) + len(body)))
            at += len(head) + len(body)
        got = np.array(spans, np.int64).reshape(-1, 2)
        return "".join(parts), got[:, 0], got[:, 1]


def token_mask(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 for the tokens that share a character with one of the spans. All four arrays ascend."""
    first = np.searchsorted(token_end, start, "right")
    last = np.searchsorted(token_start, end, "left")
    step = np.zeros(len(token_start) + 1, np.int64)
    some = last > first
    np.add.at(step, first[some], 1)
    np.add.at(step, last[some], -1)
    return (np.cumsum(step[:-1]) > 0).astype(np.int8)


_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].encode_special_tokens = True
    return _loaded[path]


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_trained, input_ids, loss_mask): one row a conversation.

    Turns are ordered by ``turn`` (null last), ties by role and text. A turn whose role is null has the role "unknown",
    one whose text is null an empty text; a turn without a conv_id is a conversation of its own, whose conv_id is null.
    Equal rows are separate turns. A token that covers the edge of a trained turn is trained. Other columns are not
    read. Only the conversations' own rows are shuffled, once; whole conversations are encoded, however long: a
    conversation, being one row of the result, must fit in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _tokenizer(tokenizer)
        for batch in portions(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rendered = [template.render([(t["role"], t["text"]) for t in turns]) for turns in part.column("turns").to_pylist()]
                ids, masks, n, trained = [], [], [], []
                for (_, start, end), e in zip(rendered, enc.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
                    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                    mask = token_mask(offsets[:, 0], offsets[:, 1], start, end)
                    ids.append(np.array(e.ids, np.int32))
                    masks.append(mask)
                    n.append(len(mask))
                    trained.append(int(mask.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("n_turns"), pa.array(n, pa.int32()), pa.array(trained, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))],
                    ["conv_id", "n_turns", "n_tokens", "n_trained", "input_ids", "loss_mask"],
                )

    turn = F.struct(
        F.col("turn").isNull().alias("none"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = (
        turns.filter("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .unionByName(turns.filter("conv_id is null").select("conv_id", F.array("t").alias("turns")))
        .select("conv_id", F.size("turns").alias("n_turns"), F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    )
    return whole.mapInArrow(run, "conv_id long, n_turns int, n_tokens int, n_trained int, input_ids array<int>, loss_mask array<tinyint>")


def op3_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and loss masks of every conversation of the table."""
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
