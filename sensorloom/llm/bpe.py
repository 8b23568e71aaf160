"""Byte-pair encoding and decoding with the vocabulary of a tokenizer file.

A word is a contiguous array of parts and, beside each, the rank of the part joined with the next
one. The smallest rank is found by a scan, its boundary deleted and the two neighbouring ranks
refreshed, until no pair has a rank. Words are short, so scanning beats a heap, and new words of one
length are merged together as the rows of a matrix: every row loses one boundary in each step. Each
worker keeps the ids of words it has met.
"""

from __future__ import annotations

import json
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .rows import importable

NO_RANK = 1 << 60
# Entries one worker keeps in each of its two memories; a full one is emptied and filled anew.
KEPT_WORDS = 400_000
# Words up to this many bytes are merged as rows of a matrix; far longer ones in linked blocks.
ROW_WORD = 40
LONG_WORD = 512
# Texts are taken up to this many characters (one text at least) at a time.
CHARACTERS = 4_000_000
SLICE = 2_000
IDS = T.ArrayType(T.IntegerType(), False)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one byte-level BPE file (no normalizer, no prefix space)."""

    # The split rule of byte-level pre-tokenizers; a fixed value.
    WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        step = config["pre_tokenizer"] or {}
        if config["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True) or config["normalizer"]:
            raise ValueError("only plain byte-level BPE files can be read")
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: t.encode() for t, i in self.special.items()}
        ids = {}
        for token, i in config["model"]["vocab"].items():
            if token not in self.special:
                ids[bytes(letters[c] for c in token)] = i
                self.bytes_of[i] = bytes(letters[c] for c in token)
        self.ids = ids
        # The rank of a pair is the place of its rule. Where each token has one rule, the joined
        # bytes tell the rule: all lower ranks inside them are merged by the time it comes up.
        self.ranks: dict[bytes, int] = {}
        for place, rule in enumerate(config["model"]["merges"]):
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            joined = bytes(letters[c] for c in left + right)
            if self.ranks.setdefault(joined, place) != place:
                raise ValueError("a token with two merge rules")
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        # The same ranks by the ids of both parts, for whole columns of words.
        pairs = []
        for place, rule in enumerate(config["model"]["merges"]):
            left, right = (bytes(letters[c] for c in part) for part in (rule.split(" ") if isinstance(rule, str) else rule))
            pairs.append(((ids[left] << 32) | ids[right], place, ids[left + right]))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks = np.append(table[:, 0], -1 + (1 << 62)), np.append(table[:, 1], NO_RANK)
        self.joined = np.zeros(len(pairs), np.int64)
        self.joined[table[:, 1]] = table[:, 2]
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.words = regex.compile(self.WORDS)
        self.spaces = regex.compile(r"\s\s")
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Packed ids of what follows a space (keyed without it), and of other words.
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        n = len(word)
        if n == 1:
            return [self.ids[word]]
        find = self.ranks.get
        starts = list(range(n + 1))
        ranks = [find(word[i : i + 2], NO_RANK) for i in range(n - 1)]
        if n > LONG_WORD:
            return self._merge_long(word, starts, ranks)
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            del starts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = find(word[starts[at] : starts[at + 2]], NO_RANK)
            if at:
                ranks[at - 1] = find(word[starts[at - 1] : starts[at + 1]], NO_RANK)
        ids = self.ids
        return [ids[word[a:b]] for a, b in zip(starts, starts[1:])]

    def _merge_long(self, word: bytes, starts: list[int], ranks: list[int]) -> list[int]:
        """The same for a very long run without a break: ranks lie in blocks that each know their
        smallest one, and parts are linked, so that a merge touches two or three blocks only."""
        n, size = len(starts) - 1, 256
        find, ids = self.ranks.get, self.ids
        rank = np.full(-(-n // size) * size, NO_RANK, np.int64)
        rank[: n - 1] = ranks
        blocks = rank.reshape(-1, size)
        lows = blocks.min(axis=1)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))

        def put(at: int, value: int) -> None:
            rank[at] = value
            lows[at // size] = blocks[at // size].min()

        while True:
            block = int(lows.argmin())
            if lows[block] == NO_RANK:
                break
            at = block * size + int(blocks[block].argmin())
            gone = after[at]
            after[at], end[at] = after[gone], end[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, NO_RANK)
            follow = after[at]
            put(at, find(word[at : end[follow]], NO_RANK) if follow < n else NO_RANK)
            if before[at] >= 0:
                put(before[at], find(word[before[at] : end[at]], NO_RANK))
        found, at = [], 0
        while at < n:
            found.append(ids[word[at : end[at]]])
            at = after[at]
        return found

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def _merge_rows(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of one length: one row each, a boundary less in every step."""
        parts = self.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        ranks = self._pair_rank(parts[:, :-1], parts[:, 1:])
        found: list[bytes] = [b""] * len(words)
        rows = np.arange(len(words))

        def finish(done: np.ndarray) -> None:
            packed, size = parts[done].astype(np.uint32).tobytes(), 4 * parts.shape[1]
            for i, row in enumerate(rows[done].tolist()):
                found[row] = packed[i * size : (i + 1) * size]

        while parts.shape[1] > 1:
            at = ranks.argmin(axis=1)
            low = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            over = low == NO_RANK
            if over.any():
                finish(over)
                parts, ranks, rows, at, low = (x[~over] for x in (parts, ranks, rows, at, low))
            if not len(rows):
                return found
            n, width = parts.shape
            here = np.arange(n)
            parts[here, at] = self.joined[low]
            keep = np.ones((n, width), bool)
            keep[here, at + 1] = False
            parts = parts[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[here, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            for some, left in ((np.flatnonzero(at < width - 2), at), (np.flatnonzero(at > 0), at - 1)):
                ranks[some, left[some]] = self._pair_rank(parts[some, left[some]], parts[some, left[some] + 1])
        finish(np.ones(len(rows), bool))
        return found

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of any length."""
        found: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = defaultdict(list)
        for i, size in enumerate(map(len, words)):
            by_length[size].append(i)
        for size, places in by_length.items():
            group = [words[i] for i in places]
            merged = self._merge_rows(group) if size <= ROW_WORD else [array("I", self.merge(w)).tobytes() for w in group]
            for i, packed in zip(places, merged):
                found[i] = packed
        return found

    def _learn(self, pieces: set[str], firsts: list[str]) -> None:
        """Makes every piece known, and every word of what stands first in a text."""
        spaced, bare, find = self.spaced, self.bare, self.words.findall
        new = pieces.difference(spaced)
        heads = {p for p in new if p.isalpha()}
        mixed = []
        for piece in new.difference(heads):
            if piece[:-1].isalpha():
                head, tails = piece[:-1], [piece[-1]]
            else:
                first, *tails = find(" " + piece)
                head = first[1:]
            mixed.append((piece, head, tails))
        heads.update([m[1] for m in mixed])
        new_heads = list(heads.difference(spaced))
        new_tails = list(set().union(*[m[2] for m in mixed], *map(find, firsts)).difference(bare))
        spaced.update(zip(new_heads, self._merge_all([(" " + h).encode("utf-8", "replace") for h in new_heads])))
        bare.update(zip(new_tails, self._merge_all([t.encode("utf-8", "replace") for t in new_tails])))
        tail = bare.__getitem__
        spaced.update([(piece, spaced[head] + b"".join(map(tail, tails))) for piece, head, tails in mixed])

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text.

        A single space between two other characters always begins a word, so texts are cut there
        and the pieces looked up; the split rule runs on new pieces only.
        """
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CHARACTERS:
                yield from self._encode_some(held)
                held, size = [], 0
        yield from self._encode_some(held)

    def _encode_some(self, texts: list[str]) -> Iterator[np.ndarray]:
        laid = [self._lay(text) for text in texts]
        plain = [part for parts in laid for part in parts if isinstance(part, list)]
        for known in (self.spaced, self.bare):
            if len(known) > KEPT_WORDS:
                known.clear()
        firsts = [part[0] for part in plain]
        self._learn(set().union(*(part[1:] for part in plain)), firsts)
        word, piece, find = self.bare.__getitem__, self.spaced.__getitem__, self.words.findall
        for parts in laid:
            packed = []
            for part in parts:
                if isinstance(part, list):
                    packed += map(word, find(part[0]))
                    packed += map(piece, part[1:])
                else:
                    packed.append(array("I", [part]).tobytes())
            yield np.frombuffer(b"".join(packed), np.uint32)

    def _lay(self, text: str) -> list[list[str] | int]:
        """A text as lists of pieces and, between them, the ids of special tokens."""
        parts = [text] if self.specials is None or not self.specials.search(text) else self.specials.split(text)
        return [self.special[p] if p in self.special else self.cut.split(p) if self.spaces.search(p) else p.split(" ") for p in parts if p]

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    """The coder of a file, once in each worker."""
    return ByteBpe(path)


def shared_coder(name: str) -> ByteBpe:
    return coder(SparkFiles.get(name))


def share(spark: SparkSession, path: str) -> str:
    """Hands the file to every executor; the name to ask for it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _ids_array(parts: list[np.ndarray], kind: pa.DataType = pa.int32()) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32), kind))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids, special tokens in the text taken as such.

    A null text counts as empty and has no ids. Other columns pass through; ``name`` must be free.
    """
    return _with_columns(docs, path, text, {name: IDS}, _encode_batch)


def _encode_batch(bpe: ByteBpe, texts: pa.Array) -> list[pa.Array]:
    return [_encoded(bpe, texts)]


def _encoded(bpe: ByteBpe, texts: pa.Array) -> pa.ListArray:
    return _ids_array(list(bpe.encode_all([t or "" for t in texts.to_pylist()])))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of the ids; bytes that are no UTF-8 become U+FFFD. Null ids: empty."""
    return _with_columns(encoded, path, ids, {name: T.StringType()}, _decode_batch)


def _decode_batch(bpe: ByteBpe, ids: pa.Array) -> list[pa.Array]:
    return [pa.array([bpe.decode(i or []) for i in ids.to_pylist()], pa.string())]


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, as ``decode(encode(docs))`` but in one pass of Python."""
    return _with_columns(docs, path, text, {"ids": IDS, "decoded": T.StringType()}, _round_trip)


def _round_trip(bpe: ByteBpe, texts: pa.Array) -> list[pa.Array]:
    ids = _encoded(bpe, texts)
    return [ids, *_decode_batch(bpe, ids)]


def _with_columns(df: DataFrame, path: str | None, source: str, new: dict[str, T.DataType], make) -> DataFrame:
    if taken := set(new) & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} exist")
    spark = df.sparkSession
    importable(spark)
    file, place = share(spark, path or default_path()), df.columns.index(source)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_coder(file)
        for batch in batches:
            # In slices, so that one worker holds few texts with all that is made of them.
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(bpe, part.column(place))], [*part.schema.names, *new])

    # Names only matter outside: inside the columns are numbered.
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = T.StructType([*plain.schema.fields, *(T.StructField(n, kind) for n, kind in new.items())])
    return plain.mapInArrow(apply, schema).toDF(*df.columns, *new)
