"""Byte-level BPE by prefix-sharing trie traversal, and its inverse.

The distinct words of a slice of texts form a trie.  Sorted, they stand in the
trie's depth-first order, and the length of the prefix that a word shares with
the one before says at which node it branches off, so the walk keeps one stack:
for each prefix of the current word the last token of its encoding.  A word
only pays for the nodes below its branch, and its encoding is read off the
stack from its end: each last token leads to the prefix before it.

A prefix's last token is the one token that ends it and fits the last token of
what stands before (`Vocabulary.fits`): two tokens fit if no merge joins pieces
across their boundary before both are complete.  The tokens that may end a
prefix come with its `State`: the longest end of it that some token begins with,
found from the state before by one byte.

Defined results: null and empty texts have no tokens and decode to the empty
text; the special token's string inside a text is the special token, unless
``special=False``; a text is encoded whole, however long, and a word without any
break takes memory in proportion to its length.  Each text is encoded on its
own, so repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded, kept, parts, tidy

#: Fixed value: how a byte-level BPE cuts a text into words.
WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words whose encodings a worker keeps from one slice to the next, in two generations.
KEPT_WORDS = 100_000

_NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte.

    Printable Latin-1 bytes stand for themselves, the others for the letters
    from U+0100 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class State:
    """The longest end of a prefix that begins a token, and where each byte leads from it."""

    __slots__ = ("ends", "next", "text")

    def __init__(self, text: bytes, token: dict[bytes, int]):
        self.text = text
        self.next: dict[int, State] = {}
        #: tokens that end here, longest first: (length, id)
        self.ends = tuple((len(text) - i, token[text[i:]]) for i in range(len(text))
                          if text[i:] in token)


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file, with encodings so far."""

    def __init__(self, text: str):
        data = json.loads(text)
        model, letters = data["model"], byte_letters()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes: dict[int, bytes] = {}
        for word, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.token = {b: i for i, b in self.bytes.items() if i not in self.special.values()}
        self.packed = {i: np.array([i], "<u4").tobytes() for i in self.bytes}
        self._length = {i: len(b) for b, i in self.token.items()}
        self._begins = {b[:i] for b in self.token for i in range(1, len(b) + 1)}
        self._states = {b"": State(b"", self.token)}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = ids[left], ids[right]
            self.rank[a, b] = r
            self.halves.setdefault(ids[left + right], (a, b))
        self._fits: dict[int, bool] = {}
        self._edge: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        self.known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def edge(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """Pieces at a token's left (0) or right (1) edge while it is built, and until when.

        The pieces run from a byte to the token itself; each stays until the
        merge of the given rank takes it into the next.
        """
        found = self._edge.get((token, side))
        if found is None:
            pieces, until, piece = [token], [_NEVER], token
            while (halves := self.halves.get(piece)) is not None:
                until.append(self.rank[halves])
                piece = halves[side]
                pieces.append(piece)
            found = self._edge[token, side] = pieces[::-1], until[::-1]
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the texts of both tokens, put together, are encoded as these two.

        The pieces on either side of the boundary are followed as time, the
        rank of merges, goes on.  A merge across the boundary wins if its rank
        is below that of the left piece's next merge, and not above that of the
        right piece's: of equal ranks, the leftmost comes first.
        """
        found = self._fits.get(left << 32 | right)
        if found is None:
            a, a_until = self.edge(left, 1)
            b, b_until = self.edge(right, 0)
            i = j = 0
            while True:
                cross = self.rank.get((a[i], b[j]), _NEVER)
                if cross < a_until[i] and cross <= b_until[j]:
                    found = False
                    break
                if a_until[i] == b_until[j] == _NEVER:
                    found = True
                    break
                if a_until[i] <= b_until[j]:
                    i += 1
                else:
                    j += 1
            if len(self._fits) >= 300_000:
                self._fits.clear()
            self._fits[left << 32 | right] = found
        return found

    def step(self, state: State, byte: int) -> State:
        """The state after one more byte; there are no more states than beginnings of tokens."""
        text = state.text + bytes((byte,))
        while text and text not in self._begins:
            text = text[1:]
        found = self._states.get(text)
        if found is None:
            found = self._states[text] = State(text, self.token)
        state.next[byte] = found
        return found

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids of distinct words, as little-endian unsigned 32-bit integers."""
        fits, fitting, packed = self.fits, self._fits, self.packed
        out: dict[str, bytes] = {}
        length = self._length
        last = [-1]     # the last token of each prefix of the current path
        states = [self._states[b""]]
        path = b""
        for text, word in sorted([(w.encode("utf-8", "surrogatepass"), w) for w in words]):
            depth = 0
            for x, y in zip(path, text):  # noqa: B905  up to the shorter one
                if x != y:
                    break
                depth += 1
            del last[depth + 1:], states[depth + 1:]
            state, end = states[depth], depth
            for byte in text[depth:]:
                state = state.next.get(byte) or self.step(state, byte)
                end += 1
                for n, ending in state.ends:
                    before = last[end - n]
                    if before < 0:
                        break
                    fit = fitting.get(before << 32 | ending)
                    if fit is None:
                        fit = fits(before, ending)
                    if fit:
                        break
                else:  # a byte-level vocabulary that is whole has a token for each byte
                    raise ValueError(f"no token ends {text[:end]!r}")
                last.append(ending)
                states.append(state)
            ending = last[end]
            if length[ending] == end:
                out[word] = packed[ending]
            else:
                tokens = []
                while end:
                    ending = last[end]
                    tokens.append(packed[ending])
                    end -= length[ending]
                out[word] = b"".join(tokens[::-1])
            path = text
        return out

    def encode(self, texts: list[str], special: bool = True) -> list[bytes]:
        """Token ids of whole texts."""
        pieces: list[list[list[str]]] = []
        marks = [m for m in self.special if special]
        cut = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        found: list[list[bytes]] = []
        new: set[str] = set()
        for text in texts:
            spans = [text]
            between: list[bytes] = []
            if cut is not None and cut.search(text):
                spans = cut.split(text)
                between = [self.packed[self.special[m]] for m in cut.findall(text)]
            words = [WORD.findall(s) for s in spans]
            for w in words:
                new.update(w)
            pieces.append(words)
            found.append(between)
        if len(self.known) > KEPT_WORDS // 2:
            self._older, self.known = self.known, {}
        known, older = self.known, self._older
        new.difference_update(known)
        still = new & older.keys()
        known.update((w, older[w]) for w in still)
        known.update(self.encode_words(new - still))
        out = []
        for words, between in zip(pieces, found, strict=True):
            coded = [b"".join(map(known.__getitem__, w)) for w in words]
            joined = coded[0]
            for mark, more in zip(between, coded[1:], strict=True):
                joined += mark + more
            out.append(joined)
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode(
            "utf-8", "replace")


def vocabulary(text: str) -> Vocabulary:
    """One vocabulary a worker for each tokenizer, kept between tasks."""
    return kept(hashlib.sha256(text.encode()).hexdigest(), lambda: Vocabulary(text))


def _mapped(sent, special: bool, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(sent.value)
        for part in parts(batches):
            texts = part.column("text").fill_null("").to_pylist()
            ids = coder.encode(texts, special)
            columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64())]
            names = ["doc_id", "n_tokens"]
            if texts_too:
                columns += [pa.array(ids, pa.binary()),
                            pa.array([coder.decode(x) for x in ids], pa.string())]
                names += ["ids", "decoded"]
            else:
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                            pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest()
                                      for x in ids])]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _sent(docs: DataFrame, tokenizer: str):
    """The tokenizer file (1.4 MB, whatever the input), sent to the workers once."""
    with open(tokenizer, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer: str, *, special: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text."""
    return bounded(docs).select("doc_id", "text").mapInArrow(
        tidy(_mapped(_sent(docs, tokenizer), special, True), keeps=True),
        "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer: str, *, special: bool = True) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return bounded(docs).select("doc_id", "text").mapInArrow(
        tidy(_mapped(_sent(docs, tokenizer), special, False), keeps=True),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
