"""BPE encoding and decoding with a public word-level tokenizer file.

Tokens never span white space, so a text is the sequence of its white-space
separated chunks and a worker remembers the encoding of those it has met. The
words of new chunks - cut exactly as the tokenizer's normalizer and splitter
do - are inserted into a trie, and an encoding is read off the trie: the state
of a node is the last token of the encoding of the characters on its path, so
words with a common prefix share the work on it. Sorted words are the trie's
depth-first order; states live as long as the worker, up to a bound. A token
may follow another only if no merge across their border comes before the
merges that build the two; exactly one suffix of a path satisfies this, and
following the last tokens backwards spells out the encoding.

The work per text is a dictionary look-up per chunk. Texts stay where they are:
no shuffle, one Arrow batch at a time, blocks of bounded size within it.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_CHARS = 1_000_000      # a longer text is cut into words part by part
GROUP_CHARS = 200_000        # texts whose new chunks are learnt together
CACHE_CHUNKS = 250_000       # chunks per generation (two are kept) and worker process
CACHE_WORDS = 300_000        # words, likewise
CACHE_NODES = 600_000        # trie nodes kept between blocks
CACHE_CHARS = 64             # longer chunks are encoded anew each time


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of byte-level BPE: visible Latin-1 characters
    stand for themselves, the others for U+0100 onwards in byte order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    others = [b for b in range(256) if b not in table]
    table.update({b: chr(0x100 + i) for i, b in enumerate(others)})
    return table


# Characters on which Python's own classes agree with the tokenizer's: ASCII without the
# separators FS..US, and Latin letters and signs up to U+024F that need no normalization
# (the superscript digits, fractions, no-break space, NEL and dotted capital I go the slow way).
_PLAIN = re.compile("[\t-\r -~¡-±´-¸º»¿-įı-ɏ]*")
_WORDS = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
# the tokenizer's white space; str.split() also splits at FS..US, which it does not count
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def plain_words(chunk: str) -> list[str]:
    """The words of a chunk of plain characters; most are letters and at most one more."""
    low = chunk.lower()
    if low.isalpha():
        return [low]
    if low[:-1].isalpha():
        return [low[:-1], low[-1]]
    return _WORDS.findall(low)


class WordBPE:
    """Encoder for one tokenizer file (BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.all_ids = {**self.ids, **self.special}
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") \
            if self.special else None
        self.alphabet = {chr(b): c for b, c in byte_alphabet().items()}
        self.to_alphabet = str.maketrans(self.alphabet)
        self.built: dict[str, tuple | None] = {}      # token -> its border parts over time
        self.reach: dict[str, int] = {}               # last three characters -> longest token
        self.final_reach: dict[str, int] = {}         # the same for tokens that end a word
        for t in self.ids:
            final = t.endswith(self.end) and len(t) > len(self.end)
            n, of = (len(t) - len(self.end), self.final_reach) if final else (len(t), self.reach)
            if n >= 3:
                of[t[n - 3:n]] = max(of.get(t[n - 3:n], 3), n)
        self.pairs: dict[tuple[str, str], bool] = {}  # tokens -> may stand next to each other
        self.nodes: dict[str, str] = {}               # path -> last token of its encoding
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.elder: dict[str, tuple[bytes, bytes]] = {}
        self.spelled: dict[str, tuple[bytes, bytes]] = {}
        self.spelled_before: dict[str, tuple[bytes, bytes]] = {}
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.all_ids.items()}
        self.text_bytes = {t: t.encode() for t in self.all_ids}

    # --- words ---------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in the byte alphabet."""
        if _PLAIN.fullmatch(text):
            found = plain_words(text)
            if text.isascii():
                return found
            to = self.to_alphabet
            return [w if w.isascii() else w.encode().decode("latin-1").translate(to) for w in found]
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    # --- which tokens may stand side by side -----------------------------------------
    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            chars = list(token[:-len(self.end)])
            chars[-1] += self.end
            return chars
        return list(token)

    def edges(self, token: str) -> tuple[list, list] | None:
        """How merging builds ``token`` from its symbols: the parts that touch its left
        and its right border in turn, each with the rank of the merge that ends it.
        None if the symbols merge to something else."""
        got = self.built.get(token, 0)
        if got != 0:
            return got
        s, never = self.symbols(token), len(self.rank)
        left, right = [], []
        while len(s) > 1:
            ranks = [self.rank.get((a, b), never) for a, b in zip(s, s[1:])]
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            if i == 0:
                left.append((s[0], best))
            if i == len(s) - 2:
                right.append((s[-1], best))
            s[i:i + 2] = [s[i] + s[i + 1]]
        got = (left + [(token, never)], right + [(token, never)]) if s == [token] else None
        self.built[token] = got
        return got

    def may_follow(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self._border_holds(self.edges(a)[1], self.edges(b)[0])
            if len(self.pairs) > CACHE_NODES:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got

    def _border_holds(self, right: list, left: list) -> bool:
        """Play both sides' merges in rank order; at every moment the two parts at the
        border must not merge first (the leftmost of equal merges goes first)."""
        i = j = 0
        never = len(self.rank)
        while True:
            (x, x_ends), (y, y_ends) = right[i], left[j]
            across = self.rank.get((x, y), never)
            if across < x_ends and across <= y_ends and across != never:
                return False
            if x_ends == never and y_ends == never:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    # --- the trie walk --------------------------------------------------------------
    def _last(self, word: str, upto: int, suffix: str, path: list[str]) -> str:
        """Last token of the encoding of ``word[:upto] + suffix``; ``path[j]`` is the
        last token of ``word[:j]``."""
        ids, pairs = self.ids, self.pairs
        # without a token of three characters and more that ends like this, two at most
        reach = (self.final_reach if suffix else self.reach).get(word[upto - 3:upto], 2) if upto > 2 else upto
        for start in range(upto - reach if reach < upto else 0, upto):
            token = word[start:upto] + suffix
            if token in ids and self.edges(token):
                if not start:
                    return token
                follows = pairs.get((path[start], token))
                if follows or follows is None and self.may_follow(path[start], token):
                    return token
        raise ValueError(f"no token ends {word[:upto]!r}")

    def encode_words(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of every word. Sorted words are a depth-first walk of their trie;
        ``path`` holds the states from the root to the current node."""
        out: dict[str, list[str]] = {}
        if len(self.nodes) > CACHE_NODES:
            self.nodes.clear()
        nodes, path, before = self.nodes, [""], ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word) - 1, len(path) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1:]
            keep = len(word) <= CACHE_CHARS
            for i in range(len(path), len(word)):      # inner nodes; the leaf carries the suffix
                last = nodes.get(word[:i]) if keep else None
                if last is None:
                    last = self._last(word, i, "", path)
                    if keep:
                        nodes[word[:i]] = last
                path.append(last)
            tokens, at = [self._last(word, len(word), self.end, path)], len(word)
            at -= len(tokens[0]) - len(self.end)
            while at > 0:
                tokens.append(path[at])
                at -= len(path[at])
            out[word] = tokens[::-1]
            before = word
        return out

    # --- texts ----------------------------------------------------------------------
    def parts(self, text: str) -> Iterator[str]:
        """The text in slices of about ``BLOCK_CHARS``, cut behind white space, where
        neither a word nor a composed character can continue."""
        at = 0
        while len(text) - at > BLOCK_CHARS:
            cut = max(text.rfind(" ", at, at + BLOCK_CHARS), text.rfind("\n", at, at + BLOCK_CHARS)) + 1
            if cut <= at:
                ends = [p for p in (text.find(" ", at + BLOCK_CHARS), text.find("\n", at + BLOCK_CHARS)) if p >= 0]
                if not ends:
                    break
                cut = min(ends) + 1
            yield text[at:cut]
            at = cut
        yield text[at:]

    def chunks(self, text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return [c for c in _SPACE.split(text) if c]
        return text.split()

    def generation(self) -> dict:
        """The words met lately; a full generation becomes the one before."""
        if len(self.spelled) > CACHE_WORDS:
            self.spelled_before, self.spelled = self.spelled, {}
        return self.spelled

    def new_words(self, cut: Iterable[list[str]]) -> list[str]:
        """Words of neither generation; those of the one before are taken over."""
        new, spelled, before = [], self.spelled, self.spelled_before
        for w in {w for ws in cut for w in ws if w not in spelled}:
            if w in before:
                spelled[w] = before[w]
            else:
                new.append(w)
        return new

    def learn(self, fresh: set[str]) -> None:
        """Encode chunks that are not in ``known``: ids as little-endian bytes, and the tokens
        in UTF-8 joined by a space."""
        if len(self.known) + len(fresh) > CACHE_CHUNKS:
            self.elder, self.known = self.known, {}
        known, elder, special, words = self.known, self.elder, self.special, self.words
        cut = {}
        for c in fresh:
            if c in elder:
                known[c] = elder[c]
            elif "<|" in c and self.cut_special:
                cut[c] = [w for p in self.cut_special.split(c) for w in ([p] if p in special else words(p))]
            else:
                cut[c] = words(c)
        spelled, ids, texts = self.generation(), self.id_bytes, self.text_bytes
        new = self.new_words(cut.values())
        for t in special:
            spelled[t] = ids[t], texts[t]
        for w, tokens in self.encode_words([w for w in new if w not in special]).items():
            spelled[w] = b"".join([ids[t] for t in tokens]), b" ".join([texts[t] for t in tokens])
        for c, ws in cut.items():
            if len(ws) == 1:
                known[c] = spelled[ws[0]]
            else:
                known[c] = b"".join([spelled[w][0] for w in ws]), b" ".join([spelled[w][1] for w in ws])

    def look_up(self, parts: list[list[str]]) -> list[list]:
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

    def encode_texts(self, texts: Iterable[str | None]) -> Iterator[Iterable[list]]:
        """For every text, the parts of its encoding: a list of chunks each. Short texts
        are looked up in groups; a long one goes part by part."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if size and size + len(text) > GROUP_CHARS:
                yield from ([part] for part in self.look_up(held))
                held, size = [], 0
            if len(text) > GROUP_CHARS:
                yield (self.look_up([self.chunks(part)])[0] for part in self.parts(text))
            else:
                held.append(self.chunks(text))
                size += len(text) + 1
        if held:
            yield from ([part] for part in self.look_up(held))


def encoder(path: str | None) -> WordBPE:
    """The encoder of this worker process, kept between its tasks; the default file is
    looked up there."""
    state = sys.modules.setdefault("_fraudlake_worker", types.ModuleType("_fraudlake_worker"))
    kept = state.__dict__.setdefault("word_bpe", {})
    if path not in kept:
        kept[path] = WordBPE(path or default_path())
    return kept[path]


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
            text_col: str = "text", ids: bool = False) -> DataFrame:
    """id, n_tokens, SHA-256 of the ids and of the decoded text; with ``ids`` also
    the ids and the decoded text themselves.

    Decoding joins the token strings by a space, as the tokenizer file names no
    decoder. Null or empty text has no tokens. Repeated ids are separate rows;
    an empty table gives no rows.
    """
    schema = docs.select(id_col).schema.simpleString()[len("struct<"):-1].replace(":", " ", 1)
    schema = f"{schema}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if ids:
        schema += ", ids array<bigint>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = encoder(path)
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [],
                                    "ids": [], "decoded": []}
            for parts in bpe.encode_texts(batch.column(1).to_pylist()):
                a, b, n, raw, words = hashlib.sha256(), hashlib.sha256(), 0, [], []
                for found in parts:
                    joined = b"".join([e[0] for e in found])
                    if not joined:
                        continue
                    # a chunk of characters that the normalizer drops has no tokens
                    spelled = b" ".join([e[1] for e in found if e[1]])
                    a.update(joined)
                    b.update(b" " + spelled if n else spelled)
                    n += len(joined) // 4
                    if ids:
                        raw.append(joined)
                        words.append(spelled.decode())
                out["n_tokens"].append(n)
                out["ids_sha256"].append(a.hexdigest())
                out["decoded_sha256"].append(b.hexdigest())
                if ids:
                    out["ids"].append(np.frombuffer(b"".join(raw), dtype="<u4").astype("int64"))
                    out["decoded"].append(" ".join(words))
            cols = [batch.column(0), pa.array(out["n_tokens"], pa.int64()),
                    pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols += [pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["decoded"], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
