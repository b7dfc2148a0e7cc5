"""Bulk-synchronous best-fit packing of token sequences.

1. Pieces are range-sorted by falling length, equal lengths by a number of their own, and each task numbers its
   rows of a length. A row per task and length gives every piece its rank among those of its length.
2. Pieces of one length are a run, and so are sequences with the same room: best fit treats them alike. Supersteps
   go down the lengths. Each sweeps the runs of gaps for successors, the smallest room that holds a piece, settles
   by rank which pieces take which sequences, shrinks the gaps and repeats with the next length, until every piece
   has a place. That is best fit decreasing, with nothing left out: no bands, no limit of rounds. There are at most as
   many lengths as the capacity, so the runs, whatever the number of pieces, are a small table (supersteps).
3. Tasks look up the place of each piece by its length and rank.

Nulls: a null text is empty and still has the end token. Pieces are told apart by a number of their own, so
repeated rows, ids and lengths (ties) are each placed once. A very long text is encoded whole, then cut. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, numbered, read, stage

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
_CACHE_WORDS = 800_000
_CACHE_BYTES = 64 << 20  # of the words, their ids take about as much


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of whole texts as little-endian uint32 bytes.

    The vocabulary drops white space, lower-cases, and never joins across white space or between letters
    and punctuation. So a text's ids are those of its chunks in a row, and each chunk is encoded once per
    worker (bounded cache). Texts that may hold a special token's string are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.size = Tokenizer.from_file(path), {}, 0
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _whole(self, texts: list) -> list:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set) -> None:
        """Encode chunks: single words of letters many at a time, others with their closing marks split off."""
        known, plain, other, split, chunks = self.known, {}, [], [], list(words)
        for chunk, w in zip(chunks, b"\n".join(chunks).decode().split("\n")):  # no chunk holds white space
            if w.isalpha():
                plain[w] = chunk
                continue
            core = w.rstrip(".,!?;:")
            if core != w and core.isalpha() and core.lower().isalpha():  # a mark that joins the next ones keeps the chunk whole
                marks = len(w) - len(core)
                c = chunk[:-marks]
                if c not in known:
                    plain[core] = c
                split.append((chunk, c, chunk[-marks:]))
            else:
                other.append(chunk)
        other += {m for _, _, m in split if m not in known}
        odd = [w for w, c in plain.items() if len(w) < len(c) and not w.lower().isalpha()]  # as long as its bytes: all ASCII
        other += [plain.pop(w) for w in odd]
        texts, keys = list(plain), list(plain.values())
        for i in range(0, len(texts), 512):
            part, own = texts[i : i + 512], keys[i : i + 512]
            data = self._whole([" ".join(part)])[0]
            ends = ((np.flatnonzero(self.last[np.frombuffer(data, "<u4")]) + 1) * 4).tolist()
            if len(ends) != len(part):
                other += own
                continue
            known.update(zip(own, [data[a:b] for a, b in zip([0, *ends], ends)]))
        for i in range(0, len(other), 512):
            part = other[i : i + 512]
            known.update(zip(part, self._whole([w.decode() for w in part])))
        for chunk, core, marks in split:
            known[chunk] = known[core] + known[marks]

    def encode(self, texts: list) -> list:
        texts = [t or "" for t in texts]
        odd = [i for i, t in enumerate(texts) if "<|" in t]
        split = [() if "<|" in t else t.encode().lower().split() for t in texts]
        if len(self.known) > _CACHE_WORDS or self.size > _CACHE_BYTES:
            self.known.clear()
            self.size = 0
        known = self.known
        new = set(filterfalse(known.__contains__, chain.from_iterable(split)))
        if new:
            self._learn(new)
            self.size += sum(map(len, new))
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for i, data in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = data
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32; only documents over the capacity are cut."""
    stop = np.asarray([end], "<u4").tobytes()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows, out = [], [[], [], [], []]
            for lo in range(0, len(texts), 256):
                for i, data in enumerate(encoder(path).encode(texts.slice(lo, 256).to_pylist()), lo):
                    data += stop
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append(i)
                        for c, v in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part))):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def supersteps(lengths: dict, capacity: int) -> list:
    """Best fit over runs. lengths: length -> number of pieces. Rows (length, rank, each, seq, offset): the pieces of a
    length from that rank on go to sequences from seq on, `each` of them laid end to end from offset in every one.

    A superstep per length, falling. Gaps are runs of sequences that have the same room, sorted by it; the sweep takes
    the successor, the smallest room that holds a piece, and stays with a sequence while it does. Pieces that want
    the same gap take their turn by rank. Then gaps have shrunk, and pieces without one have opened sequences.
    A run's room at least halves whenever it is met, and a superstep cuts at most two runs: the number of rows is at
    most about 4 log2(capacity) for each length that occurs, whatever the number of pieces.
    """
    from bisect import bisect_left, insort

    rooms: list = []  # rising
    runs: dict = {}  # room -> [(first sequence, number)]
    out, opened = [], 0

    def keep(room: int, seq: int, n: int) -> None:
        if room and n:
            if room not in runs:
                insort(rooms, room)
                runs[room] = []
            runs[room].append((seq, n))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0

        def take(room: int, seq: int, n: int) -> int:
            """How many of the run's sequences are met, filled with pieces from `rank` on."""
            nonlocal left, rank
            each = room // length  # noqa: B023
            full = min(n, left // each)
            for per, at, number in ((each, seq, full), (left - full * each, seq + full, 1 if full < n else 0)):
                if number and 0 < per * number <= left:
                    out.append((length, rank, per, at, capacity - room))  # noqa: B023
                    rank, left = rank + per * number, left - per * number
                    keep(room - per * length, at, number)  # noqa: B023
                    full = at + number - seq
            return full

        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                n = -(-left // (capacity // length))
                opened += take(capacity, opened, n)
                continue
            room = rooms[i]
            seq, n = runs[room].pop()
            met = take(room, seq, n)
            keep(room, seq + met, n - met)
            if not runs.get(room):
                runs.pop(room, None)
                rooms.remove(room)
    return out


def ranked(items: DataFrame, order: list) -> DataFrame:
    """items, range-sorted and written once, with the task (part) and the number within it of a row's length (rank)."""

    def number(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            length = batch.column("length").to_numpy()
            starts = np.flatnonzero(np.diff(length, prepend=-1)) if len(length) else np.zeros(0, int)
            rank = np.arange(len(length))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(length)]):  # rows are sorted by length
                own = int(length[at])
                rank[at:end] += seen.get(own, 0) - at
                seen[own] = seen.get(own, 0) + end - at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], [*batch.schema.names, "part", "rank"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    dealt = items.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(number, f"{kinds}, part int, rank long"), "pack-ranked")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table with the columns ROW and length (1 to capacity)."""
    sorted_ = ranked(items, [F.desc("length"), F.asc(ROW)])
    base, lengths = {}, {}
    for r in sorted_.groupBy("part", "length").agg(F.count("*").alias("n")).orderBy("part", "length").collect():  # tasks + lengths rows: ranges overlap at their ends
        base[r.part, r.length] = lengths.get(r.length, 0)
        lengths[r.length] = lengths.get(r.length, 0) + r.n
    plan = np.array(sorted(supersteps(lengths, capacity)), np.int64).reshape(-1, 5)
    first = {int(n): i for i, n in reversed(list(enumerate(plan[:, 0])))}
    last = {int(n): i + 1 for i, n in enumerate(plan[:, 0])}

    def place(batches):
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy() for c in ("length", "part", "rank"))
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            cuts = np.flatnonzero((np.diff(length, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
            for at, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rank)]):
                n = int(length[at])
                rows = plan[first[n] : last[n]]
                own = rank[at:end] + base[int(part[at]), n]
                _, begin, each, to, start = rows[np.searchsorted(rows[:, 1], own, side="right") - 1].T
                seq[at:end] = to + (own - begin) // each
                offset[at:end] = start + (own - begin) % each * n
            names = [c for c in batch.schema.names if c not in ("part", "rank", ROW)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in items.dtypes if c != ROW)
    return sorted_.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    items = numbered(pieces(docs, path or tokenizer_path(), capacity), "pack-pieces")
    return pack(items, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
