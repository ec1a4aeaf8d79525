"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole, turn after turn, and encoded once with offsets. The spans of the turns
and of the tokens are both sorted, so binary search finds the tokens that touch a turn and cuts them to
it. Control strings inside texts are broken up by an escape, which reading back undoes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates. None may appear inside a text.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_STARTS = re.compile("(?=" + "|".join(re.escape(c) for c in CONTROL) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\([\\.n])", re.S)
LEARNED = "assistant"


def escape(text: str) -> str:
    r"""Backslashes are doubled, and ``\.`` follows the first character of every control string."""
    return _STARTS.sub(r"\1\\.", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and where each text lies in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE + "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render() was given."""
    out = []
    for piece in formatted.split(OPEN)[1:]:
        role, _, rest = piece.partition("\n")
        out.append((unescape(role), unescape(rest[: rest.rindex(CLOSE)])))
    return out


def covered(tokens: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch a span, and the characters of the spans that tokens cover, merged.

    tokens: starts and ends, sorted. White space that an encoder leaves between tokens belongs to the
    token after it; tokens of one character's bytes share its offsets.
    """
    mask = np.zeros(len(tokens), bool)
    pieces: list[tuple[int, int]] = []
    if not len(tokens):
        return mask, pieces
    ends = np.maximum.accumulate(tokens[:, 1])
    starts = np.minimum(tokens[:, 0], np.concatenate([[0], ends[:-1]]))
    for lo, hi in spans:
        if lo == hi:
            continue
        a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(starts, hi, side="left")
        mask[a:b] = True
        if a < b:
            pieces.append((max(lo, int(starts[a])), min(hi, int(ends[b - 1]))))
    return mask, pieces


ROWS_SQL = """conv_id long, n_turns long, formatted string, token_ids array<int>, loss_mask array<boolean>,
 loss_spans array<struct<lo:long,hi:long>>"""


def format_chats(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, token_ids, loss_mask, loss_spans``.

    Turns are ordered by turn, role, text, nulls first; a null role or text counts as empty; repeated
    rows are turns of their own. Rows with a null conv_id form one conversation. Only texts of role
    "assistant" are under the mask. ``loss_spans`` are the masked code points of ``formatted``. An
    empty table gives an empty result; other columns are ignored. A conversation is one output string
    and therefore one group.
    """
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
        ))).alias("turns")
    )
    fields = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
        ("loss_spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        for batch in batches:
            rows = []
            for conv, turns_ in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                pairs = [(t["role"], t["text"]) for t in turns_]
                formatted, spans = render(pairs)
                enc = tok.encode(formatted, add_special_tokens=False)
                offsets = np.array(enc.offsets, dtype=np.int64).reshape(-1, 2)
                mask, pieces = covered(offsets, [s for s, p in zip(spans, pairs, strict=True) if p[0] == LEARNED])
                rows.append({"conv_id": conv, "n_turns": len(pairs), "formatted": formatted, "token_ids": enc.ids, "loss_mask": mask.tolist(), "loss_spans": [{"lo": a, "hi": b} for a, b in pieces]})
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return grouped.mapInArrow(run, ROWS_SQL)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations hold, from their output alone."""
    sql = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["lo"] : s["hi"]]) for s in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            yield pa.RecordBatch.from_arrays([batch["conv_id"], *map(pa.array, out.values())], ["conv_id", *out])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, sql)


def chat_table(turns: DataFrame) -> DataFrame:
    """The rows that the chat query returns: all conversations and one, -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return read_back(format_chats(rows))
