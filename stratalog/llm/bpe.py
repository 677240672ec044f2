"""Byte-level BPE by a finite-state transducer that is determinised as it is needed.

The encoding of a prefix ends in exactly one token, and what stands before that token is the
encoding of a shorter prefix; two tokens may stand beside each other exactly if the merges leave
the two alone. A state therefore needs the last token that is certain and the bytes after it, and
on a byte it finds the one token that can end there. As soon as all positions from which a longer
token may still start agree on their past, the tokens they agree on are put out; the lookahead is
bounded by the longest token. States and transitions are kept as they come up, in bounded tables.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .pretok import shared_file, splitter

MAX_STATES = 50_000
MAX_PAIRS = 200_000
MAX_PIECES = 200_000
LONG_PIECE = 64
SLICE = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """The tokens of a piece by merging the adjacent pair of lowest rank again and again, by ranks
    under ``below``: the definition, used for single tokens when the transducer is compiled."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        best = min(found)
        if best >= below:
            break
        at = found.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes byte pieces. ``step`` reads a byte and may put out tokens, ``finish`` puts out the rest.

    A state has the bytes since the last certain token and, for each position in them, where its
    last token starts and which it is; ``live`` are the positions where a token that ends later may
    start. The certain token itself only counts while position 0 is live, so other states forget it.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.ranks, self.max_states = ranks, max_states
        self.token_bytes = {r: b for b, r in ranks.items()}
        self.reachable: dict[bytes, int] = {}
        self.whole: dict[bytes, int] = {}  # tokens that merges don't build: only a whole piece gives them
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge of each token
        for b, r in ranks.items():
            halves = merge(b, ranks, r) if len(b) > 1 else [r]
            if len(halves) == 2:
                self.halves[r] = (halves[0], halves[1])
            (self.reachable if len(halves) <= 2 else self.whole)[b] = r
        self.prefixes = {b[:i] for b in self.reachable for i in range(len(b))}
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {}
        self.states: list[tuple[bytes, list[int], list[int], list[int]]] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # by 256 times the state plus the byte
        self.seen: set[int] = set()  # moves that were asked for once
        self.start = self._state(b"", [0], [0], [-1])

    def _state(self, pending: bytes, live: list[int], starts: list[int], tokens: list[int]) -> int:
        key = (tokens[0] if live[0] == 0 else -2, pending)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append((pending, live, starts, tokens))
        return found

    def _beside(self, a: int, b: int) -> bool:
        """Whether the merges leave two tokens apart: undoing their merges from the last to the
        first, no merge across the border may have come before the one that is undone."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            words, ranks, halves = self.token_bytes, self.ranks, self.halves
            x, y, limit, after, known = a, b, 1 << 60, False, True
            while True:
                across = ranks.get(words[x] + words[y], 1 << 60)
                # a merge at the right of the border that has the rank of one across it comes later
                if across < limit or across == limit and after and across < 1 << 60:
                    known = False
                    break
                left = x if x in halves else -1
                right = y if y in halves else -1
                if left < 0 and right < 0:
                    break
                if left > right:
                    limit, after, x = left, False, halves[x][1]
                else:
                    limit, after, y = right, True, halves[y][0]
            self.pairs[a << 32 | b] = known
        return known

    def _read(self, text: bytes, n: int, live: list[int], starts: list[int], tokens: list[int]) -> list[int]:
        """Read the byte before ``n``: appends to ``starts`` and ``tokens``, gives the new live positions."""
        reachable, prefixes = self.reachable, self.prefixes
        for q in live:
            token = reachable.get(text[q:n])
            if token is not None and (tokens[q] == -1 or self._beside(tokens[q], token)):
                break
        else:
            raise RuntimeError("no token ends here; the ranks are not those of a byte-level BPE")
        starts.append(q)
        tokens.append(token)
        live = [p for p in live if text[p:n] in prefixes]
        live.append(n)
        return live

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one move: the target state and the tokens that became certain."""
        pending, live, starts, tokens = self.states[state]
        text = pending + bytes((byte,))
        n = len(text)
        starts, tokens = starts.copy(), tokens.copy()
        live = self._read(text, n, live, starts, tokens)
        root = n
        for p in live:  # the last position that all live ones have in their past
            while p != root:
                if p > root:
                    p = starts[p]
                else:
                    root = starts[root]
        out, p = [], root
        while p:
            out.append(tokens[p])
            p = starts[p]
        if root:
            live = [p - root for p in live]
            starts = [max(0, p - root) for p in starts[root:]]
            tokens = tokens[root:]
        move = self.moves[state << 8 | byte] = (self._state(text[root:], live, starts, tokens), tuple(out[::-1]))
        return move

    def finish(self, state: int, rest: bytes = b"") -> list[int]:
        """The tokens from a state to the end, after reading ``rest`` without making states."""
        pending, live, starts, tokens = self.states[state]
        if rest:
            text, starts, tokens = pending + rest, starts.copy(), tokens.copy()
            for n in range(len(pending) + 1, len(text) + 1):
                live = self._read(text, n, live, starts, tokens)
        out, p = [], len(starts) - 1
        while p:
            out.append(tokens[p])
            p = starts[p]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """All tokens of a piece. A move is determinised when it is asked for a second time; what
        follows a move that comes up for the first time is read without making states."""
        if (single := self.whole.get(piece)) is not None:
            return [single]
        if len(self.states) > self.max_states or len(self.seen) > 4 * self.max_states:
            self._reset()
        state, out, moves = self.start, [], self.moves
        for i, byte in enumerate(piece):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in self.seen:
                    self.seen.add(key)
                    out.extend(self.finish(state, piece[i:]))
                    return out
                move = self.step(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.finish(state))
        return out


class Encoder(dict):
    """Whole texts to token ids; remembers the tokens of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.split = Transducer(ranks), splitter(pattern)
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            found = tuple(self.transducer.encode(piece.encode("utf-8", "replace")))
        if len(piece) <= LONG_PIECE:
            if len(self) >= MAX_PIECES:  # what is in use comes back from the older half
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []


class Utf8:
    """An incremental UTF-8 decoder as a state machine. The state is the unfinished character's
    bytes, of which there are at most three; ill-formed input gives one U+FFFD for each maximal
    well-formed beginning, like the standard library's."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def bounds(held: bytes) -> tuple[int, int]:
        """The bytes that may follow an unfinished character."""
        if len(held) == 1:
            return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(held[0], (0x80, 0xBF))
        return 0x80, 0xBF

    @staticmethod
    def width(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0

    def feed(self, data: bytes) -> str:
        out, held = [], self.held
        for byte in data:
            if held:
                low, high = self.bounds(held)
                if low <= byte <= high:
                    held += bytes([byte])
                    if len(held) == self.width(held[0]):
                        out.append(held.decode())
                        held = b""
                    continue
                out.append("�")
                held = b""
            width = self.width(byte)
            if width == 1:
                out.append(chr(byte))
            elif width:
                held = bytes([byte])
            else:
                out.append("�")
        self.held = held
        return "".join(out)

    def finish(self) -> str:
        out, self.held = "�" * bool(self.held), b""
        return out


class Decoder:
    """Token ids back to bytes and, as they stream in, to text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.table[r] = b
        self.alone: list[str | None] = [None] * len(self.table)
        for r, b in enumerate(self.table):
            try:
                self.alone[r] = None if b is None else b.decode()
            except UnicodeDecodeError:
                pass
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def to_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each token completes, and at the end what is left."""
        machine, alone, moves = Utf8(), self.alone, self.moves
        for i in ids:
            if not machine.held and (whole := alone[i]) is not None:
                yield whole
                continue
            key = (machine.held, i)
            if (move := moves.get(key)) is None:
                if len(moves) > MAX_STATES:
                    moves.clear()
                move = moves[key] = (machine.feed(self.table[i]), machine.held)
            machine.held = move[1]
            if move[0]:
                yield move[0]
        if rest := machine.finish():
            yield rest

    def to_text(self, ids: list[int]) -> str:
        parts = list(map(self.alone.__getitem__, ids))
        return "".join(self.stream(ids) if None in parts else parts)


_coders: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def _coder(shared, pattern: str) -> tuple[Encoder, Decoder]:
    digest, data = shared.value
    if (digest, pattern) not in _coders:
        ranks = read_ranks(data)
        _coders[digest, pattern] = (Encoder(ranks, pattern), Decoder(ranks))
    return _coders[digest, pattern]


def _uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, with garbage looked for after each of them only: the tables have no cycles, and
    looking for some all the time takes longer than the work. Afterwards all is as it was."""
    was = gc.isenabled()
    gc.disable()
    try:
        for batch in batches:
            yield batch
            gc.collect()
    finally:
        if was:
            gc.enable()


def defaults(path: str | None = None, pattern: str | None = None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id, ids array<int>)`` for every row: the whole text's tokens, without special tokens.

    A null text gives no tokens, like an empty one. Rows are kept as they are, repeated ids too;
    other columns are not looked at. One pass over the partitions, no shuffle.
    """
    path, pattern = defaults(path, pattern)
    shared = shared_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _coder(shared, pattern)[0]
        for batch in _uncollected(batches):
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                ids = [np.array(encoder.encode(t), np.int32) for t in rows.column("text").to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(ends, np.concatenate(ids))], names=["id", "ids"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = slim.select("id", F.array(F.lit(0)).alias("ids")).schema
    return slim.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, ids, decoded binary, decoded_text string)``: the bytes of the tokens, and their text
    from the streaming decoder. A null list decodes like an empty one."""
    path, pattern = defaults(path)
    shared = shared_file(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _coder(shared, pattern)[1]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                column = rows.column("ids")
                ends = column.offsets.to_numpy()
                flat, ends = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy().tolist(), (ends - ends[0]).tolist()
                lists = [flat[a:b] for a, b in zip(ends, ends[1:])]
                raw = [decoder.to_bytes(x) for x in lists]
                text = [decoder.to_text(x) for x in lists]
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("ids"), pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=["id", "ids", "decoded", "decoded_text"])

    slim = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    out = slim.withColumns({"decoded": F.lit(b""), "decoded_text": F.lit("")}).schema
    return slim.mapInArrow(run, out).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id, ids array<int>, decoded binary)`` for every row: the text's tokens, and the bytes that
    the streaming decoder and its state machine make of them again.

    The same as ``decode(encode(docs))`` in one pass and one worker a task, so token lists don't
    travel between workers. Nulls and repeated rows are as there.
    """
    path, pattern = defaults(path, pattern)
    shared = shared_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coder(shared, pattern)
        for batch in _uncollected(batches):
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                lists = [encoder.encode(t) for t in rows.column("text").to_pylist()]
                raw = [decoder.to_text(x).encode() for x in lists]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(ends, flat), pa.array(raw, pa.binary())], names=["id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = slim.select("id", F.array(F.lit(0)).alias("ids"), F.lit(b"").alias("decoded")).schema
    return slim.mapInArrow(run, out).withColumnRenamed("id", id_col)
