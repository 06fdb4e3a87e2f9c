"""BPE encoding and decoding with a public vocabulary file.

The encoder walks a word once. An Aho-Corasick automaton over all tokens gives the
longest token at each place; a token is kept only if the pair that it makes with the
token before it is one that byte-pair merging could leave side by side, else the next
shorter prefix is tried and, when none is left, the walk steps back. The answers to
"may these two stand side by side" are kept in a pair table. The result equals
merging by rank, in time linear in the word.

Texts are split at white space first and each distinct piece is encoded once a worker,
so rare pieces pay for the walk and common ones for a look-up. The table of pieces
stops growing at ``CACHE`` entries; pieces beyond it are encoded anew. A Python worker
that Spark uses again keeps tokenizer and table. Decoding gathers bytes from one buffer
through a table of offsets.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pieces of text that a worker keeps with their ids.
CACHE = 400_000
PAIRS = 2_000_000


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: tokens, merges, the split expression, the end-of-word mark and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_chars()
        self.inner = [self.ids[c] for c in chars]
        self.last = [self.ids[c + self.end] for c in chars] if self.end else self.inner
        self.text = {i: t for t, i in (self.ids | self.special).items()}
        self.size = max(self.text) + 1


def normal(text: str) -> str:
    """Canonical composition, then lower case character by character (no final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join("σ" if c == "Σ" else c.lower() for c in text)


class Encoder:
    """Exact byte-pair encoding of words by backtracking over longest token matches."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = v = vocabulary
        base = set(v.inner) | set(v.last)
        self.split = {i: (i, i) for i in base}
        self.rank = dict.fromkeys(base, -1)
        self.joined: dict[tuple[int, int], int] = {}
        symbols = {i: chr(i + 1) for i in base}
        for rank, (a, b, c) in enumerate(v.merges):
            if c not in self.split:
                self.split[c], self.rank[c], symbols[c] = (a, b), rank, symbols[a] + symbols[b]
            self.joined[a, b] = rank
        self.size = {i: len(s) for i, s in symbols.items()}
        of = {s: i for i, s in symbols.items()}
        self.shorter = {i: next((of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in of), -1) for i, s in symbols.items()}
        self.tokens = ahocorasick.Automaton()
        for s, i in of.items():
            self.tokens.add_word(s, i)
        self.tokens.make_automaton()
        self.whole = of
        self.inner = {b: symbols[i] for b, i in enumerate(v.inner)}
        self.last = [symbols[i] for i in v.last]
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave ``left`` and ``right`` as neighbours.

        The merges of both tokens are undone, latest first; had a pair across the
        border been mergeable before the merge undone last, it would have gone first.
        """
        if (known := self.pairs.get((left, right))) is not None:
            return known
        rank, split, joined = self.rank, self.split, self.joined
        a, b, before, ok = left, right, 1 << 60, True
        while True:
            across = joined.get((a, b))
            if across is not None and across < before:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            # at equal ranks (the same token twice) the left one was merged first
            if ra > rb:
                before, a = ra, split[a][1]
            else:
                before, b = rb + 1, split[b][0]
        if len(self.pairs) < PAIRS:
            self.pairs[left, right] = ok
        return ok

    def word(self, data: bytes) -> list[int]:
        """The ids of one word, given as UTF-8."""
        symbols = data[:-1].decode("latin-1").translate(self.inner) + self.last[data[-1]]
        if (whole := self.whole.get(symbols)) is not None:
            return [whole]
        size, shorter, pairs, n = self.size, self.shorter, self.pairs, len(symbols)
        longest = [0] * n
        for end, token in self.tokens.iter(symbols):
            longest[end + 1 - size[token]] = token
        out: list[int] = []
        at, closed, token, left = 0, bytearray(n + 1), longest[0], -1
        while True:
            end = at + size[token]
            fits = not closed[end]
            if fits and left >= 0 and (fits := pairs.get((left, token))) is None:
                fits = self.compatible(left, token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                at, left, token = end, token, longest[end]
            elif (less := shorter[token]) >= 0:
                token = less
            else:
                closed[at] = 1
                token = out.pop()
                left = out[-1] if out else -1
                at -= size[token]

    def piece(self, data: bytes) -> list[int]:
        """The ids of a piece of text without ASCII white space; special tokens count as such."""
        if data.isalpha() and data.islower():
            return self.word(data)
        v, out, text = self.v, [], data.decode("utf-8", "surrogatepass")
        for part in v.specials.split(text) if v.specials else [text]:
            if part in v.special:
                out.append(v.special[part])
            else:
                for word in v.words.findall(normal(part)):
                    out += self.word(word.encode())
        return out


#: Signs that make a word of their own in the split expression when they follow a letter or digit and end a piece; no special token ends in them.
MARKS = ".,;:!?)]}*#$%&+/=@^_~\"\\-"


_ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])


def _gather(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``tokens`` (start, size) that ``at`` names, one behind the other, and where each ends."""
    size = sizes[at]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    place = np.int32 if max(total, len(tokens)) < 1 << 31 else np.int64
    source = np.repeat((starts[at] - (ends - size)).astype(place), size)
    source += np.arange(total, dtype=place)
    return tokens[source], ends


class Pieces:
    """Ids of whole texts from the ids of their pieces between ASCII white space.

    The pieces of some texts are made distinct by Arrow, and only the distinct ones are
    looked up in the table or, where it lacks them, encoded; ids of whole texts are then
    gathered by numpy. ``encode`` takes a list of pieces and returns the ids of each,
    packed as ``dtype``. A run of ``MARKS`` behind a letter or digit is a word of its own
    in the split expression, so such a piece is looked up as two. A-Z are lower-cased at
    once where no special token can be.
    """

    def __init__(self, encode: Callable[[list[bytes]], Iterable[bytes]], dtype: str, most: int = CACHE) -> None:
        self.encode, self.dtype, self.most = encode, np.dtype(dtype), most
        self.known: dict[bytes, bytes] = {}

    def texts(self, texts: list[str | None], step: int = 4000) -> list[bytes]:
        """The ids of each text, packed as ``dtype``."""
        out: list[bytes] = []
        for k in range(0, len(texts), step):
            out += self._some(pa.array([t or "" for t in texts[k : k + step]], pa.large_string()))
        return out

    def _some(self, texts: pa.Array) -> list[bytes]:
        lower = pc.ascii_lower(texts)
        if pc.any(special := pc.match_substring(texts, "<|")).as_py():
            lower = pc.if_else(special, texts, lower)
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        tokens, starts, sizes = self._distinct(words.dictionary)
        found, ends = _gather(tokens, starts, sizes, words.indices.to_numpy())
        packed = found.tobytes()
        offsets = split.offsets.to_numpy()
        cuts = (np.concatenate([[0], ends])[offsets - offsets[0]] * self.dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one behind the other, with the start and size of each."""
        core = pc.utf8_rtrim(pieces, MARKS)
        length = pc.binary_length(core).to_numpy()
        # by the last bytes of the core: an ASCII letter or digit, or a letter of Latin-1
        offsets = np.frombuffer(core.buffers()[1], np.int64)[core.offset : core.offset + len(core) + 1]
        data = np.frombuffer(core.buffers()[2], np.uint8) if core.buffers()[2] is not None else np.zeros(0, np.uint8)
        data = np.concatenate([[0, 0], data]).astype(np.uint8)
        last, before = data[offsets[1:] + 1], data[offsets[1:]]
        ends_well = _ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        parted = (length > 0) & ends_well & (length < pc.binary_length(pieces).to_numpy())
        core = pc.if_else(pa.array(parted), core, pieces).dictionary_encode()
        marks = self._tails(pieces, length, parted).dictionary_encode()
        ids = self._ids(core.dictionary.cast(pa.large_binary()).to_pylist() + marks.dictionary.cast(pa.large_binary()).to_pylist())
        tokens = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        both = np.stack([core.indices.to_numpy(), marks.indices.to_numpy() + len(core.dictionary)], 1).reshape(-1)
        found, ends = _gather(tokens, starts, sizes, both)
        ends = ends[1::2]
        return found, np.concatenate([[0], ends[:-1]]) if len(ends) else ends, np.diff(ends, prepend=0)

    @staticmethod
    def _tails(pieces: pa.Array, length: np.ndarray, parted: np.ndarray) -> pa.Array:
        """What follows the first ``length`` bytes of the ``parted`` pieces; nothing of the others."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        size = np.where(parted, np.diff(offsets) - length, 0)
        tails, ends = _gather(np.frombuffer(pieces.buffers()[2], np.uint8), offsets[:-1] + length, size, np.arange(len(pieces)))
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(tails)])

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces; an empty one has none."""
        known = self.known
        out = list(map(known.get, pieces))
        wanted = [p for p, ids in zip(pieces, out, strict=True) if ids is None and p]
        fresh = dict(zip(wanted, self.encode(wanted), strict=True)) if wanted else {}
        if (room := self.most - len(known)) > 0:
            known.update(islice(fresh.items(), room))
        return [fresh.get(p, b"") if ids is None else ids for p, ids in zip(pieces, out, strict=True)]


class Decoder:
    """Texts of ids: the tokens' bytes in one buffer, gathered through a table of offsets.

    The vocabulary file names no decoder, so tokens stand side by side with a blank between them.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        parts = [(vocabulary.text.get(i, "") + " ").encode() for i in range(vocabulary.size)]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        source = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.buffer[source[:-1]].tobytes()


#: The typecode of an array for each type of id (tasks run on little-endian machines).
CODES = {"<u2": "H", "<u4": "I"}


def id_type(vocabulary: Vocabulary) -> str:
    return "<u2" if vocabulary.size <= 1 << 16 else "<u4"


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) of every whole text: the operator's plain output."""

    def rows(batch: dict, state: tuple) -> dict:
        pieces, decoder = state
        ids = [np.frombuffer(x, pieces.dtype) for x in pieces.texts(batch["text"])]
        return {"doc_id": batch["doc_id"], "ids": [x.astype(np.int32) for x in ids], "decoded": [decoder(x).decode("utf-8", "replace") for x in ids]}

    return map_rows(_named(docs), rows, "doc_id long, ids array<int>, decoded string", lambda: _tools(path))


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids (little-endian, 32 bits) and of the decoded text.

    A null or empty text has no tokens and decodes to the empty text. Rows are
    independent: repeated rows, empty tables and further columns need no care.
    """

    def rows(batch: dict, state: tuple) -> dict:
        pieces, decoder = state
        ids = [np.frombuffer(x, pieces.dtype) for x in pieces.texts(batch["text"])]
        return {
            "doc_id": batch["doc_id"],
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(decoder(x)).hexdigest() for x in ids],
        }

    return map_rows(_named(docs), rows, RESULT, lambda: _tools(path))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


@functools.lru_cache(maxsize=2)
def _tools(path: str) -> tuple[Pieces, Decoder]:
    """Encoder and decoder of a tokenizer file, made once a worker."""
    v = Vocabulary(path)
    encoder = Encoder(v)
    return Pieces(lambda pieces: [array(CODES[id_type(v)], encoder.piece(p)).tobytes() for p in pieces], id_type(v)), Decoder(v)
