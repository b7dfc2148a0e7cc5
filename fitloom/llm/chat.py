r"""Token-level chat formatting.

The template of a turn is  `### <role>: <text></turn>\n`.  Its strings `### `, `: ` after the role and
`</turn>\n` are reserved ids behind the vocabulary, never the encoding of text. Roles and texts are
escaped and encoded on their own, one segment each, and the reserved ids are spliced between them, so
no merge reaches across a boundary. In a text a backslash goes before every backslash, `### ` and
`</turn>`; the rendered string can therefore be parsed back, and unescaping drops that backslash.
The loss mask is the prefix sum of +1 behind an assistant's role and -1 before its turn's end.

Turns are encoded row by row and laid out by prefix sums over (conv_id, turn), so a conversation of any
length is a run of rows, never one value; reading back streams through sorted turns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, read, stage

VOCABULARY = "byte_bpe_50k.json"
#: The vocabulary's ids end at 50256; the template's strings come after.
RESERVED = {50257: "### ", 50258: ": ", 50259: "</turn>\n"}
OPEN, SAYS, CLOSE = RESERVED
LEARN = "assistant"
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(\\|### |</turn>)")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|: ")
_ROLE_ESCAPED = re.compile(r"\\(\\|### |</turn>|: )")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m.group(), text)


def unescape(text: str, role: bool = False) -> str:
    return (_ROLE_ESCAPED if role else _ESCAPED).sub(lambda m: m.group(1), text)


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def assemble(roles: list, texts: list, t) -> list:
    """(ids, mask) of each turn."""
    parts = t.encode_batch([escape(r, True) for r in roles] + [escape(x) for x in texts], add_special_tokens=False)
    out, n = [], len(roles)
    for i, role in enumerate(roles):
        r, x = parts[i].ids, parts[n + i].ids
        ids = np.array([OPEN, *r, SAYS, *x, CLOSE], np.int32)
        edge = np.zeros(len(ids), np.int8)
        if role == LEARN:
            edge[len(r) + 2] += 1
            edge[len(ids) - 1] -= 1
        out.append((ids, np.cumsum(edge, dtype=np.int8).astype(bool)))
    return out


def formatted(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, ids array<int>, mask array<boolean>: one row for every row of turns.

    A null role or text is empty; a null conv_id is a conversation of its own, a null turn comes first.
    Rows of one turn number are ordered by their ids; repeated rows are turns of their own.
    An empty table gives no rows. Extra columns are ignored.
    """

    def run(batches):
        t = None
        for batch in batches:
            t = t or tokenizer(path)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                done = assemble(part.column("role").fill_null("").to_pylist(), part.column("text").fill_null("").to_pylist(), t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), pa.array([i for i, _ in done], pa.list_(pa.int32())), pa.array([m for _, m in done], pa.list_(pa.bool_()))],
                    ["conv_id", "turn", "ids", "mask"],
                )

    kinds = dict(turns.dtypes)
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, mask array<boolean>")


def read_back(rows: DataFrame, path: str) -> DataFrame:
    """Per conversation: n_turns, digests of its turns and of the text under the loss mask, lengths. From ids and masks alone."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        t, at, state = None, None, None

        def done():
            n, turns, loss, chars, loss_chars = state
            return at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        rows = []
        for batch in batches:
            t = t or tokenizer(path)
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask")):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                if state is None or conv != at:
                    own[:] = [batch.column("conv_id").type]
                    if state is not None:
                        rows.append(done())
                    at, state = conv, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                says = int(np.flatnonzero(ids == SAYS)[0])
                assert ids[0] == OPEN and ids[-1] == CLOSE
                role, text = (t.decode(x.tolist(), skip_special_tokens=False) for x in (ids[1:says], ids[says + 1 : -1]))
                state[3] += sum(map(len, RESERVED.values())) + len(role) + len(text)
                state[0] += 1
                state[1].update(f"{unescape(role, True)}\n{unescape(text)}\n".encode())
                if mask.any():
                    learnt = unescape(t.decode(ids[mask].tolist(), skip_special_tokens=False))
                    state[2].update(learnt.encode())
                    state[4] += len(learnt)
            if len(rows) > 4096:
                yield batch_of(rows)
                rows = []
        if state is not None:
            rows.append(done())
        if rows:
            yield batch_of(rows)

    own: list = []  # the Arrow type of conv_id, whichever it is

    def batch_of(rows):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [own[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "ids", "mask").mapInArrow(run, schema)


def offsets(rows: DataFrame) -> DataFrame:
    """Where each turn of formatted() starts in its conversation's ids, by prefix sums."""
    from pyspark.sql import Window as W

    before = W.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))


def op7_chat(spark, sf_dir) -> DataFrame:
    from .packing import tokenizer_path

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    path = tokenizer_path(VOCABULARY)
    return read_back(stage(formatted(turns.unionByName(extra), path), "chat-ids"), path)
