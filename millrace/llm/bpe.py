"""Byte-level BPE through a lazily determinised finite-state transducer.

BPE with ranked merges has a local characterisation: a token sequence is the
encoding of its bytes exactly if every adjacent pair of tokens is the encoding
of the pair's own bytes.  So encoding is a finite-state relation: a
non-deterministic transducer walks the trie of all tokens, may close a token
where the pair with the token before is compatible, and outputs it.  Each
prefix of the input has one valid closed run and a few open ones, none longer
than the longest token, so after bounded lookahead the runs agree on their
first tokens and those can be emitted.  The subset construction is done lazily:
a state is a set of runs without their common output, transitions are built the
first time a byte is seen in a state, and the table is emptied when it exceeds
a bound, as lazy DFAs of regular-expression engines do; within a pre-token, the
state that it has reached is carried over, so the bound holds for any length.

Decoding is streamed: ids map to bytes and an incremental UTF-8 state machine
holds back at most three bytes of an unfinished character.

Null texts count as empty, an empty text has no tokens, repeated rows are
encoded alike, texts of any length take memory in proportion to that one text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import slices, texts, uncollected, worker_state

#: States and cached pre-tokens that one Python worker keeps at most.
MAX_STATES = 320_000
MAX_PIECES = 650_000


# Letters and numbers assigned after Unicode 16.  The tokenizer's own
# splitter doesn't know them yet and takes them for other characters.
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
#: A private character, which is no letter, number or space to any splitter.
_OTHER = chr(0xE000)


def splitter(pattern: str):
    """Function from a text to its matches of ``pattern``, later letters taken for other characters."""
    import regex

    split = regex.compile(pattern)
    later = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_LETTERS) + "]")

    def run(text: str) -> list[str]:
        if text.isascii() or not later.search(text):
            return split.findall(text)
        return [text[m.start() : m.end()] for m in split.finditer(later.sub(_OTHER, text))]

    return run


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def _shared(one: tuple[int, ...], other: tuple[int, ...]) -> tuple[int, ...]:
    """The longest common prefix."""
    n = 0
    for a, b in zip(one, other):
        if a != b:
            break
        n += 1
    return one[:n]


class Transducer:
    """Maps the bytes of one pre-token to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.max_states = max_states
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        # trie nodes: children by byte, and the token that ends there (-1: none)
        self.children: list[dict[int, int]] = [{}]
        self.ending: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self.children[node].get(byte)
                if following is None:
                    following = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ending.append(-1)
                node = following
            self.ending[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list[int], list[int]] | None] = {}
        self._reset()

    def _reset(self, carried: tuple | None = None, final: tuple[int, ...] = ()) -> int:
        """Empties the table of states but for the start and the one carried over; its number."""
        start = ((-1, 0, ()),)
        self.state_of = {start: 0}
        self.runs = [start]
        #: state * 256 + byte to (next state * 256, tokens emitted)
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.finals: list[tuple[int, ...]] = [()]
        if carried is None or carried == start:
            return 0
        self.state_of[carried] = 1
        self.runs.append(carried)
        self.finals.append(final)
        return 1

    def merge(self, piece: bytes) -> list[bytes]:
        """Ranked merging as such, for the bytes of one token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks) * 2), i) for i in range(len(parts) - 1))
            if rank >= len(ranks) * 2 or (len(parts) == 2):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: int) -> tuple[list[int], list[int]] | None:
        """Tokens at the left and the right end of ``token`` while it is merged.

        From the single byte to the token itself, in the order in which they
        come to be; None if merging the token's bytes doesn't yield it.
        """
        if token in self.edges:
            return self.edges[token]
        piece = self.token_bytes[token]
        if len(piece) == 1:
            found = ([token], [token])
        else:
            parts, found = self.merge(piece), None
            if len(parts) == 2:
                left, right = (self._edges(self.ranks[part]) for part in parts)
                if left and right:
                    found = ([*left[0], token], [*right[1], token])
        self.edges[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left, right`` encodes its own bytes; left -1: ``right`` alone.

        Merging runs through the ranks upwards.  At each time one token ends at
        the boundary and one starts there; the pair is broken if those two would
        merge before either grows away from the boundary (of equal ranks the
        leftmost merges first).
        """
        if left < 0:
            holds = self.pairs[left, right] = self._edges(right) is not None
            return holds
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * self.max_states:
                self.pairs.clear()
            known = self.pairs[key] = self._boundary_holds(left, right)
        return known

    def _boundary_holds(self, left: int, right: int) -> bool:
        ends, starts = self._edges(left), self._edges(right)
        if ends is None or starts is None:
            return False
        before, after, ranks, token_bytes = ends[1], starts[0], self.ranks, self.token_bytes
        i = j = 0
        never = 1 << 62
        while True:
            grows_left = before[i + 1] if i + 1 < len(before) else never
            grows_right = after[j + 1] if j + 1 < len(after) else never
            across = ranks.get(token_bytes[before[i]] + token_bytes[after[j]])
            if across is not None and across < grows_left and across <= grows_right:
                return False
            if grows_left is never and grows_right is never:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1

    def _step(self, base: int, byte: int) -> tuple[int, tuple[int, ...]]:
        runs, closed, common = [], (), None
        children, ending, pairs = self.children, self.ending, self.pairs
        for last, node, pending in self.runs[base >> 8]:
            following = children[node].get(byte)
            if following is None:
                continue
            if children[following]:
                runs.append((last, following, pending))
                if common is None:
                    common = pending
                elif common and pending[: len(common)] != common:
                    common = _shared(common, pending)
            token = ending[following]
            if token >= 0:
                holds = pairs.get((last, token))
                if holds if holds is not None else self.compatible(last, token):
                    closed = (*pending, token)
                    runs.append((token, 0, closed))
                    if common is None:
                        common = closed
                    elif common and closed[: len(common)] != common:
                        common = _shared(common, closed)
        if common:
            n = len(common)
            runs = [(last, node, pending[n:]) for last, node, pending in runs]
            closed = closed[n:]
        key = tuple(runs)
        target = self.state_of.get(key)
        if target is None:
            target = self.state_of[key] = len(self.runs)
            self.runs.append(key)
            self.finals.append(closed)
        move = self.moves[base | byte] = (target << 8, common)
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        base, known = 0, self.moves.get
        for byte in piece:
            move = known(base | byte)
            if move is None:
                if len(self.runs) > self.max_states or len(self.moves) > 4 * self.max_states:
                    base = self._reset(self.runs[base >> 8], self.finals[base >> 8]) << 8
                    known = self.moves.get
                move = self._step(base, byte)
            base = move[0]
            if move[1]:
                out += move[1]
        out += self.finals[base >> 8]
        return out


class Utf8Stream:
    """Incremental UTF-8 state machine over chunks of bytes.

    ``feed`` returns the longest prefix of all bytes so far that ends between
    characters; an unfinished character of up to three bytes is the state.
    """

    def __init__(self) -> None:
        self.held = b""

    def feed(self, chunk: bytes) -> bytes:
        data = self.held + chunk
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte < 0x80:  # ASCII: complete
                break
            if byte >= 0xC0:  # a lead byte: complete if as many bytes follow as it announces
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if back < need:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        data, self.held = self.held, b""
        return data


def decode_stream(chunks: Iterable[Iterable[int]], token_bytes) -> Iterator[bytes]:
    """Bytes of the ids, chunk by chunk, never cut within a character."""
    machine = Utf8Stream()
    for ids in chunks:
        yield machine.feed(b"".join(map(token_bytes.__getitem__, ids)))
    rest = machine.finish()
    if rest:
        yield rest


class _Pieces(dict):
    """Pre-token to its ids as little-endian 32-bit integers.

    Bounded in two generations: when the young one is full it becomes the old
    one, and what is still used moves back.
    """

    def __init__(self, transducer: Transducer, limit: int = MAX_PIECES):
        super().__init__()
        self.transducer, self.limit, self.old = transducer, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            tokens = self.transducer.encode(piece.encode("utf-8"))
            ids = pack(f"<{len(tokens)}I", *tokens)
        if len(piece) <= 64:
            if len(self) >= self.limit // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.transducer = Transducer(ranks, max_states)
        self.split = splitter(pattern)
        self.pieces = _Pieces(self.transducer, max_pieces)
        # by id; ids that no token has decode to nothing
        self.token_bytes = [b""] * (1 + max(self.transducer.token_bytes, default=-1))
        for token, content in self.transducer.token_bytes.items():
            self.token_bytes[token] = content

    def encode(self, text: str) -> bytes:
        """Ids as consecutive little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes, chunk: int = 8192) -> Iterator[bytes]:
        values = np.frombuffer(ids, "<u4")
        return decode_stream((values[i : i + chunk].tolist() for i in range(0, len(values), chunk)), self.token_bytes)


def _codec(content: bytes, pattern: str, max_states: int, max_pieces: int) -> Codec:
    """The worker's codec, built once for all its tasks."""
    key = ("bpe", hashlib.sha256(content).hexdigest(), pattern, max_states, max_pieces)

    def make() -> Codec:
        with uncollected():
            return Codec(parse_ranks(content), pattern, max_states, max_pieces)

    return worker_state(key, make)


def _ranks_content(ranks_path: str) -> bytes:
    with open(ranks_path, "rb") as file:
        return file.read()


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens; no shuffle.

    The rank file is read on the driver and broadcast; its size is that of the
    vocabulary and does not grow with the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_ranks_content(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, max_states, max_pieces)
        for batch in batches:
            for part in slices(batch):
                with uncollected():
                    ids = [codec.encode(text) for text in texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks_path: str, pattern: str = "") -> DataFrame:
    """doc_id and text of rows of ``encode``; null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_ranks_content(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {rank: token for token, rank in parse_ranks(shared.value).items()}
        for batch in batches:
            for part in slices(batch):
                out = []
                for ids in part.column(1).to_pylist():
                    chunks = (np.frombuffer(ids or b"", "<u4").tolist(),)
                    out.append(b"".join(decode_stream(chunks, table)).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES, with_ids: bool = False) -> DataFrame:
    """Encode, decode again and return digests of both, in one pass over the rows; ``with_ids``: the ids as well.

    ``max_states`` and ``max_pieces`` trade memory for speed; results don't depend on them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_ranks_content(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, max_states, max_pieces)
        for batch in batches:
            for part in slices(batch):
                counts, encoded, decoded, kept = [], [], [], []
                with uncollected():
                    for text in texts(part.column(1)):
                        ids = codec.encode(text)
                        if with_ids:
                            kept.append(ids)
                        digest = hashlib.sha256()
                        for chunk in codec.decode(ids):
                            digest.update(chunk)
                        counts.append(len(ids) // 4)
                        encoded.append(hashlib.sha256(ids).hexdigest())
                        decoded.append(digest.hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if with_ids else columns, schema.fieldNames())

    schema = T.StructType([*DIGESTS.fields, T.StructField("ids", T.BinaryType())]) if with_ids else DIGESTS
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
