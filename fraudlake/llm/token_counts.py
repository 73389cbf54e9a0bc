"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The vocabulary is the pieces and scores of a public sentencepiece file, read as
a unigram model. A text is cut in front of every space (written as U+2581, one
added in front of the text), as the tokenizer's splitter does. In a word an
Aho-Corasick automaton lists all pieces that end at each position, and dynamic
programming carries, per position, only the best score and the number of
tokens of the path that has it - no path is kept or traced back.

Tie rules of the tokenizer: a later candidate wins only with a strictly higher
score, and candidates for an end come in ascending order of their start, so
the longest piece wins a tie. A character without a piece of its own can also
be unknown, at the lowest score less 10, after the pieces of its start. A run
of unknown characters is one token - or, with byte fallback, one token per byte.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS, CACHE_CHARS = 300_000, 64


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores in id order, and the id of the unknown piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


class Counter:
    def __init__(self, vocab: list[tuple[str, float]], unknown: int, byte_fallback: bool = True):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        scores = dict(vocab)                       # of equal pieces the last one counts
        for piece, score in scores.items():
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.unknown_piece = vocab[unknown][0]
        self.scores = scores
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in scores for b in range(256))
        self.known: dict[str, int] = {}

    def unknown_cost(self, run: str) -> int:
        """Tokens of a run of unknown characters."""
        return len(run.encode("utf-8", "surrogatepass")) if self.bytes else 1

    def word(self, word: str) -> int:
        """Tokens of one word on its best path."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        # start of the run of unknown characters the best path ends with, or -1
        run = [-1] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for last, (length, score) in self.pieces.iter(word):
            ends[last + 1].append((last + 1 - length, score))
            if length == 1:
                single[last] = True
        for end in range(1, n + 1):
            # all starts lie before `end`, so their best paths are final
            for start, score in sorted(ends[end]):
                before = best[start]
                if before is not None and (best[end] is None or before + score > best[end]):
                    best[end], count[end], run[end] = before + score, count[start] + 1, -1
            start = end - 1
            if not single[start] and best[start] is not None:
                score = best[start] + self.unknown
                if best[end] is None or score > best[end]:
                    first = run[start] if run[start] >= 0 else start
                    base = count[first]
                    best[end], run[end] = score, first
                    count[end] = base + self.unknown_cost(word[first:end])
        return count[n]

    def words(self, text: str) -> list[str]:
        """The text cut in front of every U+2581; spaces become it, one is put in front."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if not text.startswith(SPACE):
            text = SPACE + text
        head, *tail = text.split(SPACE)
        return ([head] if head else []) + [SPACE + t for t in tail]

    def count(self, text: str) -> int:
        total, known = 0, self.known
        for w in self.words(text):
            got = known.get(w)
            if got is None:
                got = self.word(w)
                if len(w) <= CACHE_CHARS:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[w] = got
            total += got
        return total


def counter(path: str) -> Counter:
    state = sys.modules.setdefault("_fraudlake_worker", types.ModuleType("_fraudlake_worker"))
    kept = state.__dict__.setdefault("unigram_counts", {})
    if path not in kept:
        kept[path] = Counter(*vocabulary(path))
    return kept[path]


def counted(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_words, n_tokens) per document, where it lies. Null or empty
    text has none of them; repeated ids are separate rows; an empty table gives none."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(c.words(t)) for t in texts], pa.int64()),
                 pa.array([c.count(t) for t in texts], pa.int64())],
                names=[id_col, "n_chars", "n_words", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        run, f"{id_col} {kind}, n_chars bigint, n_words bigint, n_tokens bigint")
