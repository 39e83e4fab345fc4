"""Byte-level BPE encoding and decoding that reproduces exact merges in linear time.

Every vocabulary entry, its bytes read as Latin-1, goes into one pyahocorasick automaton. A pre-token's matches give the tokens that
start at each byte, longest first. The encoder takes the longest one that is compatible with the token before it, and steps back where
none is: a sequence of tokens is what the merges would make exactly when each adjacent pair is, and whether a pair is so depends on
nothing else, so that it is worked out once and remembered. A position that was left once is never tried again, hence linear time.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrane.llm.text import batch_of

#: Remembered pre-tokens of one worker; a full memory becomes the older one and a new one starts. Token pairs: four times as many.
REMEMBERED = 200_000
#: Rows whose results are held at once.
ROWS = 128
_LONG = 1 << 20


#: Of a pre-token: its ids, the same as text, and the bytes that they decode to.
Entry = tuple[tuple[int, ...], str, bytes]


class ByteBpe:
    """Encoder and decoder for a vocabulary of ranks (bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pieces = regex.compile(pattern)
        # ASCII texts need no Unicode classes, and the standard library's matcher is faster on them.
        self.ascii_pieces = re.compile(pattern.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.joined: dict[bytes, tuple[bytes, bytes]] = {}
        self.spines: dict[int, list[tuple[bytes, int]]] = {}
        made = {b: i for b, i in ranks.items() if len(b) == 1}
        for b, i in ranks.items():
            if len(b) > 1:
                parts, last = self.merged(b)
                if parts == [b]:  # others never come out of merging
                    made[b], self.joined[b] = i, last
        for b, i in made.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = {i: len(b) for b, i in ranks.items()}
        self.shorter = {i: next((made[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in made), -1) for b, i in made.items()}
        self.known: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}
        self.fits: dict[int, bool] = {}

    def merged(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """Plain merging, lowest rank first, leftmost among equals, and the last two parts that it joined; for single tokens."""
        parts, rank, last = [data[i : i + 1] for i in range(len(data))], self.ranks.get, None
        while len(parts) > 1:
            best, at = min((rank(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand in turn at a token's left (0) or right (1) edge while it is merged, each with the rank that ends it."""
        if (known := self.spines.get(token << 1 | side)) is None:
            part, until, known = self.bytes_of[token], 1 << 40, []
            while True:
                known.append((part, until))
                if len(part) == 1:
                    break
                until, part = self.ranks[part], self.joined[part][side]
            self.spines[token << 1 | side] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again.

        It doesn't if some part at the right edge of the first and some part at the left edge of the second, both there at the time,
        would join before either is used up; of equal ranks the leftmost goes first.
        """
        rank, left = self.ranks.get, self.spine(b, 0)
        for x, until_x in self.spine(a, 1):
            for y, until_y in left:
                if (m := rank(x + y)) is not None and m < until_x and m <= until_y:
                    return False
        return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        length, shorter, fits, matches, n = self.length, self.shorter, self.fits, self.automaton.iter_long, len(data)
        latin = data.decode("latin-1")
        tokens: list[int] = []
        left = None  # ends from which no way led on
        at, before = 0, -1
        option = next(matches(latin))[1]
        while True:
            while option >= 0:
                to = at + length[option]
                if left is None or not left[to]:
                    if before < 0:
                        break
                    pair = before << 32 | option
                    if (fit := fits.get(pair)) is None:
                        if len(fits) >= 4 * self.remembered:
                            fits.clear()
                        fit = fits[pair] = self.compatible(before, option)
                    if fit:
                        break
                option = shorter[option]
            if option >= 0:
                tokens.append(option)
                if to == n:
                    return tuple(tokens)
                at, before, option = to, option, next(matches(latin, to))[1]
            else:
                left = left or bytearray(n + 1)
                left[at] = 1
                last = tokens.pop()
                at -= length[last]
                before, option = tokens[-1] if tokens else -1, shorter[last]

    def entries(self, text: str) -> Iterator[list[Entry]]:
        """What is known of each pre-token, in runs; a very long text isn't split into all its pre-tokens at once."""
        pattern = self.ascii_pieces if text.isascii() else self.pieces
        runs = iter([pattern.findall(text)]) if len(text) < _LONG else iter(lambda m=(x.group() for x in pattern.finditer(text)): list(islice(m, 1 << 16)), [])
        for pieces in runs:
            known = self.known
            found = list(map(known.get, pieces))
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                piece = pieces[at]
                if (entry := known.get(piece)) is None:
                    if (entry := self.older.get(piece)) is None:
                        ids = self.encode_piece(piece)
                        entry = (ids, " ".join(map(str, ids)), self.decode(ids))
                    if len(piece) < 256:
                        if len(known) >= self.remembered:
                            self.older = known
                            known = self.known = {}
                        known[piece] = entry
                found[at] = entry
            yield found

    def encode(self, text: str) -> list[int]:
        return [i for found in self.entries(text) for entry in found for i in entry[0]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: What encode() can return for a text, and the Arrow type of each.
OUTPUTS = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"n_tokens": "long", "token_ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def _kernel(vocabulary, name: str, pattern: str, schema: pa.Schema, outputs: list[str], remembered: int) -> Callable:
    def make():
        global _encoder
        key = (name, pattern, remembered)
        if _encoder is None or _encoder[0] != key:
            _encoder = (key, ByteBpe(vocabulary.value, pattern, remembered))
        bpe = _encoder[1]
        ids_of, text_of, bytes_of = itemgetter(0), itemgetter(1), itemgetter(2)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, ROWS):
                gc.disable()  # what is remembered holds no cycles, and is large to walk
                try:
                    out = encoded(batch.slice(at, ROWS))
                finally:
                    gc.enable()
                yield out

        def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: dict[str, list] = {k: [] for k in outputs}
            for cell in batch.column(batch.num_columns - 1):
                n, all_ids, data = 0, array('i'), []
                ids_hash, data_hash = hashlib.sha256(), hashlib.sha256()
                for found in bpe.entries(cell.as_py() or ""):
                    if "ids_sha256" in rows and found:
                        ids_hash.update(((" " if n else "") + " ".join(map(text_of, found))).encode())
                    n += sum(map(len, map(ids_of, found)))
                    if "decoded_sha256" in rows or "decoded" in rows:
                        back = b"".join(map(bytes_of, found))
                        data_hash.update(back)
                        if "decoded" in rows:
                            data.append(back)
                    if "token_ids" in rows:
                        all_ids.extend(chain.from_iterable(map(ids_of, found)))
                for k, v in (("n_tokens", n), ("token_ids", np.frombuffer(all_ids, np.int32) if all_ids else np.zeros(0, np.int32)), ("decoded", b"".join(data)), ("ids_sha256", ids_hash.hexdigest()), ("decoded_sha256", data_hash.hexdigest())):
                    if k in rows:
                        rows[k].append(v)
            return batch_of(schema, [*batch.columns[:-1], *rows.values()])

        return run

    return make


_encoder = None


def encode(docs: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "token_ids"), id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row per row of ``docs``: its id and the ``outputs`` asked for.

    Null and empty texts have no tokens. Repeated rows each give a row, null ids stay null, other columns of ``docs`` are not read.
    The vocabulary is read on the driver and broadcast: its size is fixed by the file and doesn't grow with the data.
    """
    ranks = read_ranks(ranks_path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()  # workers keep the encoder of a vocabulary from task to task
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_text"))
    names = [k for k in OUTPUTS if k in outputs]
    schema = ", ".join([f"doc_id {dict(picked.dtypes)['doc_id']}", *(f"{k} {_SQL[k]}" for k in names)])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = pa.schema([to_arrow_schema(StructType(picked.schema.fields[:1])).field(0), *((k, OUTPUTS[k]) for k in names)])
    make = _kernel(vocabulary, name, pattern, arrow, names, remembered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = make()
        for batch in batches:
            yield from encoded(batch)

    return picked.mapInArrow(run, schema)
