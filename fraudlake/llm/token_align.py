"""Alignment of two tokenizers' tokens: a byte-level BPE (A) over space+text and a
SentencePiece model (B) over the text, to which it adds that space itself.

Cuts come from the tokenizers: A's character offsets and the byte spans of B's proto.
They are coarse where several tokens share a character or a byte-fallback token has an
empty span; there the decoded bytes of the tokens place the cut.

Neither tokenizer's tokens reach over a space between two other characters (A splits
there, no piece of B has a space behind another character), so a text is aligned chunk
by chunk and a worker remembers the chunks it has met. Token pairs are counted per
document and per block of documents; only the blocks' distinct pairs are shuffled to
be counted, and each block gets back the counts of its own pairs.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.bpe import byte_alphabet
from fraudlake.llm.common import written

CACHE_CHUNKS = 300_000      # chunks per generation (two are kept) and worker process
CACHE_CHARS = 64            # longer chunks are aligned anew each time
PART_CHARS = 1_000_000      # a longer text is cut into chunks part by part
GROUP_CHARS = 200_000       # texts whose new chunks are learnt together
BLOCK_CHARS = 8_000_000     # text of one block of documents

# a space that is no cut: beside white space, or at an end of the text
_AWKWARD = re.compile(r"\A |\s | \s| \Z")
_CUT = re.compile(r"(?<=\S) (?=\S)")

# numbers of A and B tokens, groups and links (int32), groups spelled out, pairs (int64)
Chunk = tuple[bytes, bytes, bytes]


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def refined(ends: np.ndarray, exact: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``ends`` where they are exact; elsewhere the last exact one before and the bytes since."""
    total, row = np.cumsum(length), np.arange(len(ends))
    before = np.maximum.accumulate(np.where(exact, row, -1))
    base = np.where(before >= 0, ends[before] - total[before], 0)
    return np.where(exact, ends, base + total)


class Aligner:
    """Both tokenizers, the bytes of their entries and the chunks met so far."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: b for b, c in byte_alphabet().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if all(c in back for c in t):
                self.a_bytes[i] = bytes(map(back.__getitem__, t))
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b_size))]
        self.a_length, self.b_length = (np.array([len(x) for x in t], dtype=np.int64)
                                        for t in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), self.b_size)
        self.within, self.last_a, self.last_b = (      # an id and what stands behind it
            np.array([f"{i}{mark}".encode() for i in range(most)], dtype=object) for mark in (",", "|", ";"))
        self.known: dict[str, Chunk | None] = {}
        self.elder: dict[str, Chunk | None] = {}

    def a_ends(self, text: str, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offset at which every A token ends in ``text``, from character offsets: exact
        where the next token begins with another character, else by decoded bytes."""
        ends = offsets[:, 1]
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            ends = np.concatenate([[0], np.cumsum(width)])[ends]
        exact = np.ones(len(ids), dtype=bool)
        exact[:-1] = offsets[1:, 0] >= offsets[:-1, 1]
        return refined(ends, exact, self.a_length[ids])

    def b_ends(self, ids: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """The same for B from the byte spans of its text, in which the space added in front
        and the bytes of a character but for its last have none."""
        return refined(spans[:, 1] + 1, spans[:, 1] > spans[:, 0], self.b_length[ids])

    def align(self, text: str, sizes: list[int]) -> list[Chunk | None]:
        """Chunks of ``sizes`` bytes (their space included) of space+text; a single None if
        either side's bytes are not those of space+text."""
        whole = " " + text
        raw, enc = whole.encode(), self.a.encode(whole, add_special_tokens=False)
        got = self.b.encode(text, return_type="offset_mapping", return_bytes=True)
        if b"".join([self.a_bytes[i] for i in enc.ids]) != raw or \
                b"".join([self.b_bytes[i] for i in got["ids"]]) != raw:
            return [None]
        a_ids, b_ids = np.array(enc.ids, dtype=np.int64), np.array(got["ids"], dtype=np.int64)
        a_end = self.a_ends(whole, a_ids, np.array(enc.offsets, dtype=np.int64))
        b_end = self.b_ends(b_ids, np.array(got["offsets"], dtype=np.int64))
        # between neighbouring ends of either side lies exactly one link
        links, shared = np.union1d(a_end, b_end), np.intersect1d(a_end, b_end, assume_unique=True)
        pairs = a_ids[np.searchsorted(a_end, links)] * self.b_size + b_ids[np.searchsorted(b_end, links)]
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        spelled = np.concatenate([np.where(shared[a_group] == a_end, self.last_a[a_ids], self.within[a_ids]),
                                  np.where(shared[b_group] == b_end, self.last_b[b_ids], self.within[b_ids])])
        tokens = spelled[np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")].tolist()
        upto = np.cumsum(sizes)
        stops = np.stack([np.searchsorted(x, upto, side="right") for x in (a_end, b_end, shared, links)], axis=1)
        numbers = np.diff(stops, axis=0, prepend=0).astype(np.int32).tobytes()
        pairs, out, at, link = pairs.tobytes(), [], 0, 0
        for k, (a, b, _, n) in enumerate(stops.tolist()):
            out.append((numbers[16 * k:16 * k + 16], b"".join(tokens[at:a + b]), pairs[8 * link:8 * n]))
            at, link = a + b, n
        return out

    def learn(self, fresh: set[str]) -> None:
        if len(self.known) + len(fresh) > CACHE_CHUNKS:
            self.elder, self.known = self.known, {}
        together, alone = [], []
        for c in fresh:
            if c in self.elder:
                self.known[c] = self.elder[c]
            elif c and not c[0].isspace() and not c[-1].isspace():
                together.append(c)
            else:
                alone.append(c)
        if together:
            found = self.align(" ".join(together), [len(c.encode()) + 1 for c in together])
            if found != [None]:
                self.known.update(zip(together, found))
            elif len(together) == 1:
                self.known[together[0]] = None
            else:                               # find the chunks that do not come back
                half = len(together) // 2
                self.learn(set(together[:half]))
                self.learn(set(together[half:]))
        for c in alone:
            self.known.update(zip([c], self.align(c, [len(c.encode()) + 1])))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, cut at single spaces between other characters, part by part."""
        at = 0
        while at <= len(text):
            m = _CUT.search(text, at + PART_CHARS)
            part = text[at:m.start()] if m else text[at:]
            yield _CUT.split(part) if _AWKWARD.search(part) else part.split(" ")
            if not m:
                return
            at = m.end()

    def look_up(self, parts: list[list[str]]) -> list[list[Chunk | None]]:
        """What is known of every chunk of some parts; unknown chunks are learnt together."""
        distinct = set().union(*parts)
        fresh = distinct.difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > CACHE_CHUNKS:
                fresh = distinct
            self.learn(fresh)
        known = self.known
        found = [list(map(known.__getitem__, part)) for part in parts]
        for c in fresh:
            if len(c) > CACHE_CHARS:
                del known[c]
        return found

    def aligned(self, texts: Iterable[str | None]) -> Iterator[list[list[Chunk]] | None]:
        """For every text its aligned chunks, part by part; None for one without tokens.
        Short texts are looked up in groups."""
        held: list[list[str] | None] = []
        size = 0

        def close() -> Iterator[list[list[Chunk]] | None]:
            found = iter(self.look_up([h for h in held if h is not None]))
            for h in held:
                part = None if h is None else next(found)
                yield None if part is None or None in part else [part]

        for text in texts:
            text = text or ""
            if held and size + len(text) > GROUP_CHARS:
                yield from close()
                held, size = [], 0
            if len(text) > GROUP_CHARS:
                out = [self.look_up([part])[0] for part in self.parts(text)]
                yield None if any(None in part for part in out) else out
            else:
                held.append(next(self.parts(text)) if text else None)
                size += len(text)
        yield from close()


def aligner(paths: tuple[str, str] | None) -> Aligner:
    """The aligner of this worker process; the default files are looked up there."""
    state = sys.modules.setdefault("_fraudlake_worker", types.ModuleType("_fraudlake_worker"))
    kept = state.__dict__.setdefault("aligners", {})
    if paths not in kept:
        kept[paths] = Aligner(*(paths or default_paths()))
    return kept[paths]


def spelled_out(text: str, paths: tuple[str, str] | None = None) -> list[tuple[int, int, list[int], list[int]]]:
    """The groups of one text: (start, end, A ids, B ids), byte offsets in space+text."""
    t, out, at = aligner(paths), [], 0
    for part in next(t.aligned([text])) or []:
        for chunk in part:
            for group in chunk[1][:-1].decode().split(";"):
                a, b = ([int(i) for i in ids.split(",")] for ids in group.split("|"))
                end = at + sum(len(t.a_bytes[i]) for i in a)
                out.append((at, end, a, b))
                at = end
    return out


def groups(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """id, groups: array<struct<start, end, a, b>> of every text (byte offsets in space+text,
    ids of both tokenizers); empty for a text without tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                   ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for k in range(0, len(batch), 64):
                some = batch.slice(k, 64)
                got = [[dict(zip(("start", "end", "a", "b"), g)) for g in spelled_out(t or "", paths)]
                       for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(got, kind)], names=["id", "groups"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"id {dict(docs.dtypes)[id_col]}, groups array<struct<start: bigint, end: bigint, a: array<int>, b: array<int>>>")


NUMBERS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def linked(docs: DataFrame, paths: tuple[str, str] | None, id_col: str, text_col: str,
           block_chars: int) -> DataFrame:
    """A row per document (``whole`` false: its numbers, distinct pairs and how often each
    is linked) and one per block of documents (``whole`` true: the pairs of all of them)."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = aligner(paths)
        none = np.zeros(0, dtype=np.int64)
        block, chars, held = TaskContext.get().partitionId() << 32, 0, []
        id_kind = pa.int64()

        def rows(ids: pa.Array, blocks: list, numbers: list, pairs: list, whole: bool) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in pairs])])
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(
                np.concatenate([none, *[p[k] for p in pairs]]))) for k in (0, 1)]
            columns = list(zip(*numbers)) if numbers else [[]] * 5
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([whole] * len(ids), pa.bool_()), pa.array(blocks, pa.int64()),
                 *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), *lists],
                names=["id", "whole", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        def summed(pairs: list) -> tuple[np.ndarray, np.ndarray]:
            every, where = np.unique(np.concatenate([none, *[p for p, _ in pairs]]), return_inverse=True)
            times = np.bincount(where, np.concatenate([none, *[n for _, n in pairs]]), len(every))
            return every, times.astype(np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, chars, held
            if any(len(p) for p, _ in held):
                yield rows(pa.nulls(1, id_kind), [block], [(0, 0, 0, 0, "")], [summed(held)], True)
            block, chars, held = block + 1, 0, []

        for batch in batches:
            id_kind = batch.column(0).type
            done, blocks, numbers, pairs = 0, [], [], []
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            for n, found in enumerate(t.aligned(batch.column(1).to_pylist())):
                blocks.append(block)
                if found is None:
                    numbers.append((0, 0, 0, 0, ""))
                    pairs.append((none, none))
                else:
                    digest, sums, parts = hashlib.sha256(), 0, []
                    for k, part in enumerate(found):
                        counted, spelled, ids = zip(*part)
                        sums = sums + np.frombuffer(b"".join(counted), dtype=np.int32).reshape(-1, 4).sum(
                            axis=0, dtype=np.int64)
                        joined = b"".join(spelled)
                        digest.update(joined[:-1] if k + 1 == len(found) else joined)
                        parts.append(np.unique(np.frombuffer(b"".join(ids), dtype=np.int64), return_counts=True))
                    numbers.append((*sums.tolist(), digest.hexdigest()))
                    pairs.append(summed(parts) if len(parts) > 1 else parts[0])
                held.append(pairs[-1])
                chars += lengths[n]
                if chars >= block_chars:
                    yield rows(batch.column(0).slice(done, n + 1 - done), blocks, numbers, pairs, False)
                    done, blocks, numbers, pairs = n + 1, [], [], []
                    yield from close()
            if blocks:
                yield rows(batch.column(0).slice(done), blocks, numbers, pairs, False)
        yield from close()

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, f"id {id_type}, whole boolean, block bigint, {NUMBERS}, pairs array<bigint>, times array<bigint>")


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
            block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum: one row per document.

    Groups lie between the byte offsets at which tokens of both end. A link is an A and a B
    token occurrence whose bytes overlap; a pair of ids counts its links in all documents.
    ``n_best``: links whose pair has the highest count of its B id, ties included;
    ``count_sum``: the counts of a document's links. Null or empty texts, and those whose
    bytes a tokenizer does not give back, have no tokens: zeros and an empty string.
    Repeated ids are separate documents; an empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    all_rows = written(linked(docs, paths, id_col, text_col, block_chars), "aligned", "whole")
    size = aligner(paths).b_size
    of_blocks = all_rows.where("whole").select("block", F.inline(F.arrays_zip("pairs", "times"))) \
        .withColumnRenamed("pairs", "pair")
    total = of_blocks.groupBy("pair").agg(F.sum("times").alias("total"))
    total = written(total.withColumn("b", F.col("pair") % size), "pair_counts")
    best = F.broadcast(total.groupBy("b").agg(F.max("total").alias("most")))       # a row per entry of B at most
    counts = total.join(best, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("is_best"))
    back = of_blocks.select(F.col("block").alias("in_block"), "pair").join(counts, "pair")
    columns = ["id", *[c.split(" ")[0] for c in NUMBERS.split(", ")], "n_best", "count_sum"]

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("pair")
        known, of, is_best = (right[c].to_numpy() for c in ("pair", "total", "is_best"))
        sizes = left["pairs"].map(len).to_numpy(dtype=np.int64)
        out = left.drop(columns=["block", "pairs", "times"])
        out["n_best"], out["count_sum"] = 0, 0
        if sizes.sum():
            pairs, times = (np.concatenate(left[c].to_list()) for c in ("pairs", "times"))
            at = np.searchsorted(known, pairs)
            row = np.repeat(np.arange(len(left)), sizes)
            for name, weight in (("n_best", times * is_best[at]), ("count_sum", times * of[at])):
                sums = np.zeros(len(left), dtype=np.int64)
                np.add.at(sums, row, weight.astype(np.int64))
                out[name] = sums
        return out[columns]

    left = all_rows.where("not whole").drop("whole")
    return left.groupBy("block").cogroup(back.groupBy("in_block")).applyInPandas(
        look_up, f"id {dict(docs.dtypes)[id_col]}, {NUMBERS}, n_best bigint, count_sum bigint")
