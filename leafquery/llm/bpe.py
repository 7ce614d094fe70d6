"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A state of the transducer is what the future can still change: the last token that is settled and the bytes read
after it. Reading a byte extends those bytes; every start of a token that could still reach past the end stays
alive, and the tokens that all live starts have in common are emitted. Which tokens may stand side by side is decided
by the merges: two tokens are neighbours of a tokenisation exactly if encoding their joined bytes gives them back.
Moves are made when first missing, one for each piece that misses one, in a table of bounded size; what lies behind a
missing move is simulated from the same live starts. So the transducer is compiled only as far as texts come again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquery.llm.common import file_bytes, short_batches, texts_of

#: Moves, neighbour pairs, words and pieces that a worker keeps. A full table of moves gets no more, one of pairs is
#: emptied; of words and pieces the last full table is kept beside the new one.
MOST_MOVES, MOST_PAIRS, MOST_WORDS, MOST_PIECES = 200_000, 400_000, 400_000, 300_000
#: Tokens that are decoded at a time.
RUN = 4096


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Transducer:
    """encode(piece) gives the ids of one match of the splitting pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        #: The vocabulary as a trie: node << 8 | byte -> node; the token that ends at a node, and which nodes go on.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for data, token in ranks.items():
            node = 0
            for byte in data:
                key = node << 8 | byte
                if (node := self.child.get(key, -1)) < 0:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = token
        self.inner = bytearray(len(self.token_at))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.reset()

    def reset(self) -> None:
        #: A state: the bytes after the settled token; the link of the settled token; the live starts, each a node of
        #: the trie and the link of the token before it. A link: the link before it, its token, how many came before.
        root = (None, -1, 0)
        self.states: list[tuple[bytes, tuple, tuple]] = [(b"", root, ((0, root),))]
        self.number = {(-1, b""): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition: join the neighbouring pair of least rank, leftmost first, as long as there is one."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
            if rank == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this one joins; None for a byte, and for a token that merging its
        own bytes does not give."""
        if token not in self.split:
            parts = self.bytes_of[token]
            parts = [parts[i : i + 1] for i in range(len(parts))]
            while len(parts) > 2:
                rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
                if rank == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def usable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def neighbours(self, a: int, b: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives the two back.

        Merges are undone beside the seam, the latest first. If what meets at the seam then could merge earlier than
        the merge just undone (or, at equal rank, further left), the seam would not have lasted.
        """
        if (known := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.usable(b) and self._lasts(a, b)
        return known

    def _lasts(self, x: int, y: int) -> bool:
        bound = 1 << 62
        while True:
            if self.ranks.get(self.bytes_of[x] + self.bytes_of[y], bound) < bound:
                return False
            left, right = self.halves(x), self.halves(y)
            if left is None and right is None:
                return True
            if right is None or left is not None and x > y:
                bound, x = x, left[1]
            else:
                bound, y = y + 1, right[0]

    @staticmethod
    def back(link: tuple, root: tuple) -> tuple[int, ...]:
        """The tokens after root up to a link."""
        out = []
        while link is not root:
            out.append(link[1])
            link = link[0]
        return tuple(out[::-1])

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        held, root, alive = self.states[state]
        child, inner, found, going = self.child, self.inner, None, []
        for node, link in alive:  # the longest token first; exactly one start fits
            if (node := child.get(node << 8 | byte)) is None:
                continue
            if found is None and (token := self.token_at[node]) >= 0:
                before = link[1]
                if self.neighbours(before, token) if before >= 0 else self.usable(token):
                    found = (link, token, link[2] + 1)
            if inner[node]:
                going.append((node, link))
        going.append((0, found))
        top = going[0][1]
        for _, link in going[1:]:
            while top is not link:
                if top[2] >= link[2]:
                    top = top[0]
                else:
                    link = link[0]
        data, out = held + bytes((byte,)), ()
        if top is not root:
            out = self.back(top, root)
            data = data[sum(len(self.bytes_of[t]) for t in out) :]
        if (number := self.number.get((top[1], data))) is None:
            number = self.number[top[1], data] = len(self.states)
            self.states.append((data, top, tuple(going)))
        done = self.moves[state << 8 | byte] = (number, out)
        return done

    def end(self, state: int) -> tuple[int, ...]:
        _, root, alive = self.states[state]
        done = self.ends[state] = self.back(alive[-1][1], root)
        return done

    def simulate(self, state: int, rest: bytes) -> tuple[int, ...]:
        """The tokens of what a state holds and the rest of a piece, without making states for it."""
        _, root, alive = self.states[state]
        child, inner, token_at, pairs, found = self.child, self.inner, self.token_at, self.pairs, None
        for byte in rest:
            found, going = None, []
            for node, link in alive:
                if (node := child.get(node << 8 | byte)) is None:
                    continue
                if found is None and (token := token_at[node]) >= 0:
                    before = link[1]
                    if before < 0:
                        if self.usable(token):
                            found = (link, token, 0)
                    else:
                        fits = pairs.get(before << 32 | token)
                        if self.neighbours(before, token) if fits is None else fits:
                            found = (link, token, 0)
                if inner[node]:
                    going.append((node, link))
            going.append((0, found))
            alive = going
        return self.back(found, root)

    def encode(self, piece: bytes) -> list[int]:
        """Follows known moves; where one is missing it is made, for the next piece that comes so far, and the rest of
        this piece is simulated. Once the table is full, no more moves are made."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        state, out, moves = 0, [], self.moves
        for i, byte in enumerate(piece):
            step = moves.get(state << 8 | byte)
            if step is None:
                if len(moves) < MOST_MOVES:
                    self.move(state, byte)
                out.extend(self.simulate(state, piece[i:]))
                return out
            state = step[0]
            if step[1]:
                out.extend(step[1])
        tail = self.ends.get(state)
        out.extend(self.end(state) if tail is None else tail)
        return out


class Utf8Machine:
    """Incremental UTF-8: feed() takes bytes as they come and gives the text that is complete so far.

    The state is the count of continuation bytes still owed and the range allowed for the next one; ill-formed bytes
    become U+FFFD, one for each maximal part of a character, and valid becomes false.
    """

    def __init__(self):
        self.held, self.owed, self.least, self.most = bytearray(), 0, 0x80, 0xBF
        self.valid = True

    def feed(self, data: bytes) -> str:
        tail = self._tail(data)
        whole, rest = bytes(self.held) + data[: len(data) - tail], data[len(data) - tail :]
        if not rest and self.owed and len(data) < self.owed and not tail:  # only continuation bytes, still too few
            for byte in data:
                if not self.least <= byte <= self.most:
                    break
                self.held.append(byte)
                self.owed, self.least, self.most = self.owed - 1, 0x80, 0xBF
            else:
                return ""
            whole = bytes(self.held) + data[data.index(byte) :]
        self.held, self.owed, self.least, self.most = bytearray(rest), 0, 0x80, 0xBF
        if rest:
            self._begin(rest)
        return self._text(whole)

    def finish(self) -> str:
        out = self._text(bytes(self.held))
        self.held, self.owed, self.least, self.most = bytearray(), 0, 0x80, 0xBF
        return out

    def _text(self, data: bytes) -> str:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            self.valid = False
            return data.decode("utf-8", "replace")

    def _begin(self, part: bytes) -> None:
        lead = part[0]
        self.owed = (1 if lead < 0xE0 else 2 if lead < 0xF0 else 3) - (len(part) - 1)
        if len(part) == 1:
            self.least, self.most = self._second(lead)

    @staticmethod
    def _second(lead: int) -> tuple[int, int]:
        return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))

    def _tail(self, data: bytes) -> int:
        """How many bytes at the end begin a character that is not complete."""
        for k in range(1, min(3, len(data)) + 1):
            lead = data[-k]
            if 0x80 <= lead <= 0xBF:
                continue
            need = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead <= 0xF4 else 1
            if need <= k:
                return 0
            low, high = self._second(lead)
            return k if k == 1 or low <= data[-k + 1] <= high else 0
        return 0


class Codec:
    """encode: text to ids as little-endian 32-bit integers. decode: ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        space = r"\p{White_Space}"
        self.pieces = regex.compile(pattern.replace(r"[^\s", "[^" + space).replace(r"\S", r"\P{White_Space}").replace(r"\s", space))
        self.two = regex.compile(space + space)
        self.memo: dict[str, bytes] = {}
        self.memo_before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table = [self.fst.bytes_of.get(i, b"") for i in range(max(self.fst.bytes_of) + 1)]

    def slow(self, text: str) -> bytes:
        memo, out = self.memo, []
        for piece in self.pieces.findall(text):
            if (found := memo.get(piece)) is None:
                if (found := self.memo_before.get(piece)) is None:
                    ids = self.fst.encode(piece.encode("utf-8", "surrogatepass"))
                    found = struct.pack(f"<{len(ids)}I", *ids)
                if len(memo) >= MOST_PIECES:
                    self.memo_before, self.memo = memo, {}
                    memo = self.memo
                memo[piece] = found
            out.append(found)
        return b"".join(out)

    def word(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.slow(text)
        if len(self.words) >= MOST_WORDS:
            self.older, self.words = self.words, {}
        self.words[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """Where no two white-space characters meet, the pattern never looks past a space and the word after it, so
        such words are encoded once and remembered. Other texts are matched as a whole."""
        if self.two.search(text):
            return self.slow(text)
        parts = text.split(" ")
        out = []
        if parts[0]:
            out.append(self.word(parts[0]))
        for part in parts[1:]:
            part = " " + part
            found = self.words.get(part)
            out.append(self.word(part) if found is None else found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_digest(self, ids: bytes) -> tuple[str, bool]:
        """The sha256 of the decoded text and whether all of it is well-formed, from the text as it grows by RUN tokens.
        The digest is of the bytes as they are if some are ill-formed."""
        machine, digest = Utf8Machine(), hashlib.sha256()
        for at in range(0, len(ids), 4 * RUN):
            digest.update(machine.feed(self.decode(ids[at : at + 4 * RUN])).encode())
        digest.update(machine.finish().encode())
        return (digest.hexdigest() if machine.valid else hashlib.sha256(self.decode(ids)).hexdigest()), machine.valid

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text as it grows, never half a character."""
        machine = Utf8Machine()
        for i in ids:
            if part := machine.feed(self.table[i]):
                yield part
        if part := machine.finish():
            yield part


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """One for each worker and vocabulary."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(data), pattern)
        gc.collect()
        gc.freeze()  # the vocabulary stays; the collector need not walk it again and again
        gc.set_threshold(100_000, 50, 1000)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens, ids (little-endian 32-bit; only if keep_ids), ids_sha256, decoded_sha256 and
    valid_utf8, by encoding the whole text and decoding the ids again.

    Null texts count as empty: no tokens, the hash of nothing. Null ids, repeated rows and further columns are allowed;
    each row gives one row, further columns are dropped. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    data = spark.sparkContext.broadcast(file_bytes(ranks_path))
    schema = "doc_id long, n_tokens long" + ", ids binary" * keep_ids + ", ids_sha256 string, decoded_sha256 string, valid_utf8 boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(data.value, pattern)
        for batch in batches:
            ids = [use.encode(t) for t in texts_of(batch)]
            cols = [batch.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if keep_ids:
                cols.append(pa.array(ids, pa.binary()))
            cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
            decoded = [use.decode_digest(x) for x in ids]
            cols += [pa.array([d for d, _ in decoded], pa.string()), pa.array([v for _, v in decoded], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
