"""Exact byte-level BPE by backtracking, and decoding by an offset table.

Encoding a pre-token takes, at each place, the longest vocabulary entry that an
Aho-Corasick automaton finds there. The entry is kept if it may stand beside its
left neighbour, which a pair-compatibility table says; else the next shorter
entry is tried, and where none is left the encoder steps back and marks the place
as a dead end. No place is a dead end twice, so the work is linear in the text.
The result is that of applying the merges in the order of their ranks.

Decoding joins the entries' bytes out of one buffer by a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from itertools import pairwise

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ready

#: The pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CACHED_WORDS, _CACHED_CHUNKS, _CACHED_PAIRS, _SEGMENT = 100_000, 600_000, 1_000_000, 1 << 20
_BORDER = regex.compile(r"(?<=\S)\s")
_tables: dict[str, BpeTable] = {}


def byte_letters() -> str:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return "".join(rest.get(b, chr(b)) for b in range(256))


class _Words(dict):
    """Ids of the pre-tokens seen, as int32 bytes; emptied when full, which changes no result."""

    def __init__(self, table: BpeTable):
        self.table = table

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        ids = self[word] = array("i", self.table.encode_word(word)).tobytes()
        return ids


class _Odd(Exception):
    """A chunk after which a text can't be parted."""


class _Chunks(dict):
    """Ids of a blank and the characters after it, up to the next blank; emptied when full."""

    def __init__(self, table: BpeTable):
        self.table = table

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[-1].isspace():
            raise _Odd
        if len(self) >= _CACHED_CHUNKS:
            self.clear()
        core = chunk.rstrip(".,")
        words = self.table.words
        if core.isalpha() and len(chunk) - len(core) < 2:  # what the pattern finds here is plain
            ids = words[" " + core] if core is chunk else words[" " + core] + words[chunk[-1]]
        else:
            ids = self.table.by_pattern(" " + chunk)
        self[chunk] = ids
        return ids


class BpeTable:
    """What encoding and decoding look up, from the text of a ``tokenizer.json``."""

    def __init__(self, spec: str):
        import ahocorasick

        spec = json.loads(spec)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser or prefix space is supported")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.to_letters = {b: c for b, c in enumerate(letters)}
        back = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.length, self.formed, self.halves = [0] * size, [-1] * size, [(0, 0)] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.pair_rank[a, b] = rank
            if self.formed[whole] < 0:
                self.formed[whole], self.halves[whole] = rank, (a, b)
        automaton, reachable = ahocorasick.Automaton(), {w: i for w, i in vocab.items() if len(w) == 1 or self.formed[i] >= 0}
        for word, i in reachable.items():
            self.length[i] = len(word)
            automaton.add_word(word, i)
        automaton.make_automaton()
        self.matches, self.longest_matches = automaton.iter, automaton.iter_long
        self.direct, self.blank = reachable, letters[0x20]
        self.shorter = [-1] * size
        for word, i in reachable.items():
            self.shorter[i] = next((reachable[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in reachable), -1)
        pieces = [b""] * size
        for word, i in vocab.items():
            pieces[i] = bytes(back[c] for c in word)
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that strip or need word ends aren't supported")
            self.special[t["content"]] = t["id"]
            pieces[t["id"]] = t["content"].encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.pattern = regex.compile(PRE_TOKEN)
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words, self.chunks = _Words(self), _Chunks(self)
        self.pairs: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` side by side are what the merges make of their bytes.

        The merges that formed the two are undone, the latest first. A pair across
        the border whose rank comes before the merge undone last would have been
        taken earlier. At equal ranks the left place comes first.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        key, bar, fine = (a, b), len(self.pair_rank) + 1, True
        while True:
            rank = self.pair_rank.get((a, b))
            if rank is not None and rank < bar:
                fine = False
                break
            late_a, late_b = self.formed[a], self.formed[b]
            if late_a < 0 and late_b < 0:
                break
            if late_a > late_b:
                bar, a = late_a, self.halves[a][1]
            else:
                bar, b = late_b + 1, self.halves[b][0]
        if len(self.pairs) >= _CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fine
        return fine

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token: the longest entries one after the other, if all may be neighbours, else by stepping back."""
        text = word.replace(" ", self.blank) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.to_letters)
        known = self.direct.get(text)
        if known is not None:
            return [known]
        pairs = self.pairs
        greedy = [i for _, i in self.longest_matches(text)]
        for pair in pairwise(greedy):
            fine = pairs.get(pair)
            if not (self.apart(*pair) if fine is None else fine):
                return self.backtrack(text)
        return greedy

    def backtrack(self, text: str) -> list[int]:
        n, length, shorter, pairs = len(text), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for end, i in self.matches(text):
            longest[end - length[i] + 1] = i  # ends come in order, so the last one is the longest
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end]:
                fine = not out or pairs.get((out[-1], token))
                if fine or fine is None and self.apart(out[-1], token):
                    out.append(token)
                    if end == n:
                        return out
                    at, token = end, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def segments(self, text: str):
        """Parts of a long text. No pre-token holds a white-space character after another one, so parts end there."""
        at = 0
        while at < len(text):
            to = at + _SEGMENT
            if to < len(text):
                border = _BORDER.search(text, to)
                to = border.start() if border else len(text)
            yield text[at:to]
            at = to

    def plain(self, text: str):
        """Ids of a text without special tokens, part by part.

        As parts end before a white-space character that follows another one, a
        part is looked up blank by blank. Where a blank follows white space, the
        pattern goes through the whole part.
        """
        for part in self.segments(text):
            first, *rest = part.split(" ")
            try:
                if rest and (not first or first[-1].isspace()):
                    raise _Odd
                yield self.by_pattern(first) + b"".join(map(self.chunks.__getitem__, rest))
            except _Odd:
                yield self.by_pattern(part)

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        if self.split_special and any(s in text for s in self.special):
            for m in self.split_special.finditer(text):
                parts += [*self.plain(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
                at = m.end()
        parts += self.plain(text[at:])
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        parts = []
        for at in range(0, len(ids), _SEGMENT):
            i = ids[at : at + _SEGMENT]
            start, size = self.offsets[i], self.offsets[i + 1] - self.offsets[i]
            ends = np.cumsum(size)
            parts.append(self.buffer[np.arange(ends[-1]) + np.repeat(start - ends + size, size)].tobytes())
        return b"".join(parts)


def table_of(spec: str) -> BpeTable:
    """The table of a vocabulary, built once in each process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = BpeTable(spec)
    return _tables[key]


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All columns of ``df`` and ``ids``: the token ids of the whole ``text``.

    ``path`` names a ``tokenizer.json``; the driver reads it and sends its text,
    whose size doesn't depend on the data. A null or empty text has no ids. The
    strings of special tokens in a text become those tokens, as the library does
    by default. An input column named as ``ids`` is replaced.
    """
    import pyarrow as pa

    spark = ready(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    df = df.drop(ids)
    where = df.columns.index(text)

    def run(batches):
        table = table_of(spec.value)
        for batch in batches:
            found = [table.encode(x or "") for x in batch.column(where).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), values)], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, df.withColumn(ids, F.lit(None).cast("array<int>")).schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` decoded to ``text``, special tokens as their strings; null ids become an empty text.

    Bytes that aren't UTF-8 become U+FFFD. An input column named as ``text`` is replaced.
    """
    import pyarrow as pa

    spark = ready(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    df = df.drop(text)
    where = df.columns.index(ids)

    def run(batches):
        table = table_of(spec.value)
        for batch in batches:
            column = batch.column(where)
            texts = [table.decode(np.asarray(x.values, dtype=np.int32)).decode("utf-8", "replace") if x.is_valid and len(x) else "" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, df.withColumn(text, F.lit(None).cast("string")).schema)


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
