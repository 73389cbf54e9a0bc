"""Packing token sequences by the sum-of-squares rule.

Texts are tokenized where they lie; from then on only narrow rows (document,
piece, length, CRC) move. Pieces are dealt by hash into groups of about
``GROUP_ROWS`` rows, and each group is packed on its own: for every gap g the
number N(g) of open sequences with g free tokens is kept, and a piece goes
where the sum of N(g)^2 becomes smallest - into the fullest such sequence on a
tie - or opens a new sequence if that is smallest. Sequences left with more
than ``SLACK`` of their room free are taken apart, and their pieces are dealt
anew into fewer groups, until a single group is left or a round no longer
shrinks them. So no task ever holds more than one group.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.bpe import _PLAIN, CACHE_CHUNKS, WordBPE, default_path, plain_words
from fraudlake.llm.common import written

ROOM, END_ID = 2048, 0
GROUP_ROWS = 8_000
SLACK = 0.02
MAX_ROUNDS = 8


class ChunkIds(WordBPE):
    """Ids of texts by the tokenizers library, chunk by chunk with a memory.

    New chunks of plain characters are cut into words, and the words not met
    before are encoded together, joined by spaces: each word ends with the one
    token that carries the end-of-word mark, so the ids fall apart again. Other
    chunks go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.spelled: dict[str, bytes] = {}
        self.spelled_before: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> None:
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(words):
            raise ValueError("a word must end with exactly one end-of-word token")
        raw, at = ids.tobytes(), 0
        for w, stop in zip(words, stops):
            self.spelled[w] = raw[at:stop]
            at = stop

    def learn(self, fresh: set[str]) -> None:
        if len(self.known) + len(fresh) > CACHE_CHUNKS:
            self.elder, self.known = self.known, {}
        known, elder, spelled, cut, odd = self.known, self.elder, self.generation(), {}, []
        plain = _PLAIN.fullmatch
        for c in fresh:
            if c in elder:
                known[c] = elder[c]
            elif plain(c) and "<|" not in c:
                cut[c] = plain_words(c)
            else:
                odd.append(c)
        new = self.new_words(cut.values())
        if new:
            self._encode_words(new)
        for c, ws in cut.items():
            known[c] = spelled[ws[0]] if len(ws) == 1 else b"".join([spelled[w] for w in ws])
        for c, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False)):
            known[c] = np.array(e.ids, dtype="<u4").tobytes()

    def ids_bytes(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """All ids of every text as little-endian unsigned 32-bit integers."""
        for parts in self.encode_texts(texts):
            yield b"".join([b"".join(found) for found in parts])


def tokenizer(path: str | None) -> ChunkIds:
    state = sys.modules.setdefault("_fraudlake_worker", types.ModuleType("_fraudlake_worker"))
    kept = state.__dict__.setdefault("chunk_ids", {})
    if path not in kept:
        kept[path] = ChunkIds(path or default_path())
    return kept[path]


def pieces(docs: DataFrame, path: str | None = None, room: int = ROOM, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """id, piece, start, length, crc: the ids of a text and an end id, cut into
    pieces of ``room`` ids only where there are more. Null text counts as empty."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = tokenizer(path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(t.ids_bytes(batch.column(1).to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * room)):
                    part = raw[at:at + 4 * room]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "crc"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {id_type}, piece int, start bigint, length bigint, crc bigint")


def pack_lengths(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length, longest first, by the
    sum-of-squares rule."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    count = np.zeros(room + 1, dtype=np.int64)              # N(g), g = 1 .. room - 1
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    made = 0
    never = np.iinfo(np.int64).max
    for i in order.tolist():
        s = int(lengths[i])
        # change of sum N(g)^2: -2 N(g) + 1 for the gap that goes, +2 N(g-s) + 1 for the one that comes
        change = 2 * (count[:room + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]                       # filled to the brim: no gap comes
        change[count[s:] == 0] = never
        fresh = 2 * count[room - s] + 1 if s < room else 0
        gap = int(np.argmin(change)) + s                   # the smallest gap on a tie
        if s < room and change[gap - s] <= fresh:
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, gap, made = made, room, made + 1
        bins[i], offsets[i] = b, room - gap
        left = gap - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets


def packed(docs: DataFrame, path: str | None = None, room: int = ROOM, id_col: str = "doc_id",
           text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: id, piece, start, length, crc, sequence_id, offset.

    Every document has at least one piece (its end id). Repeated ids are separate
    documents. An empty table gives no rows; a null id is packed like any other.
    """
    return pack(pieces(docs, path, room, id_col, text_col), room, group_rows)


def group_packer(room: int, level: int):
    """Packs one group of pieces; sequence ids are unique over rounds and groups."""
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values([c for c in ("length", "id", "piece") if c in df.columns], ignore_index=True)
        bins, offsets = pack_lengths(df["length"].to_numpy(np.int64), room)
        used = np.bincount(bins, weights=df["length"]).astype(np.int64)
        out = df.drop(columns="grp")
        out["sequence_id"] = (level << 58) | (int(key[0]) << 28) | bins
        out["offset"] = offsets
        out["used"] = used[bins]
        return out

    return run


def pack(rows: DataFrame, room: int = ROOM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Packs pieces (any columns with a ``length`` of at most ``room``)."""
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    todo = written(rows, "pieces")
    n = todo.count()
    done: DataFrame | None = None
    for level in range(MAX_ROUNDS):
        groups = max(1, -(-n // group_rows))

        deal = F.pmod(F.xxhash64(F.lit(level), *[F.col(c) for c in rows.columns]), F.lit(groups))
        placed = written(todo.withColumn("grp", deal).groupBy("grp").applyInPandas(
            group_packer(room, level), schema + ", sequence_id bigint, offset bigint, used bigint"), "packed")
        loose = F.col("used") < int((1 - SLACK) * room)
        left = placed.where(loose).count() if groups > 1 and level < MAX_ROUNDS - 1 else 0
        last = left == 0 or 2 * left > n
        final = (placed if last else placed.where(~loose)).drop("used")
        done = final if done is None else done.unionByName(final)
        if last:
            break
        todo, n = placed.where(loose).select(*rows.columns), left
    return done
