"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three transducers are compiled from a BPE model file.  The normaliser reads
characters and writes them, a word mark for a space.  The piece transducer is a
trie: its arcs read characters, and where a piece ends, an arc back to the root
writes it.  Byte fallback reads a character that no piece spells and writes its
bytes.  Weights are those of the tropical semiring, minimum and plus.  Which
piece a merge by rank leaves behind another depends on that other one, so the
arcs that write a piece remember it, and weigh zero if merging the text of the
two gives back just that pair, infinity if not; they are worked out when first
met.  Composed with an input this is a lattice of places and last pieces.  Its
shortest path, searched best first and composed only as far as the search goes,
is the sequence that merging by rank gives.

No piece holds a word mark behind another character (this is checked when the
model is compiled) and none holds a tab or line feed, so the lattice falls
apart there and equal parts are solved once.

Null texts encode like empty ones, to no pieces; texts of any length are taken
whole.  Rows may repeat, ids may be null.  Other columns are ignored.  An empty
table gives an empty result.  The model's path is a parameter; the file is read
on the driver and its content travels with the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Parts that a worker remembers, in each of two generations.
PARTS = 400_000
#: Weights of pairs that a worker remembers.
PAIRS = 300_000
INFINITE = float("inf")
_PART = re.compile(r" *[^ \t\n]+| +|[\t\n]")


def _fields(b: bytes):
    """Field numbers and values of a protocol buffer."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift += 7
            i += 1
            if b[i - 1] < 128:
                return value, i

    i = 0
    while i < len(b):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        elif key & 7 == 2:
            size, i = number(i)
            value, i = b[i : i + size], i + size
        elif key & 7 in (1, 5):
            size, form = (8, "<d") if key & 7 == 1 else (4, "<f")
            value, i = struct.unpack(form, b[i : i + size])[0], i + size
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class Machine:
    """The compiled model.  ``encode`` and ``decode`` are inverse but for what the normaliser changes."""

    def __init__(self, model: bytes):
        pieces, spec, kind = [], {}, 1
        for field, value in _fields(model):
            if field == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), x.get(2, 0.0), x.get(3, 1)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                spec = dict(_fields(value))
        if kind != 2 or spec.get(2):
            raise ValueError("only BPE models without a character map are compiled here")
        self.prefix, self.trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.text = [p for p, _, _ in pieces]
        self.bytes_at = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == 2)
        self.rank = {p: (-s, i) for i, (p, s, k) in enumerate(pieces) if k == 1}
        if any(MARK in p.lstrip(MARK) or len(p) > 1 and re.search(r"[\t\n]", p) for p in self.rank):
            raise ValueError("a piece holds a word mark or a line feed inside")
        self.longest = max(map(len, self.rank))
        back = {i: bytes([b]) for b, i in self.bytes_at.items()}
        self.out = [back.get(i, b"" if k in (3,) else b" \xe2\x81\x87 " if k == 2 else p.replace(MARK, " ").encode()) for i, (p, _, k) in enumerate(pieces)]
        # neighbours that no piece holds: no merge crosses them, so a part may be cut there
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        # a piece that its own text does not merge into is on no path; for the others, the last merge
        self.live, self.made, self.left, self.right = set(), {}, {}, {}
        for p in self.rank:
            steps = self._merge(p, whole=True)
            if len(p) == 1 or steps:
                self.live.add(p)
            if steps:
                self.made[p], (self.left[p], self.right[p]) = self.rank[p][0], steps
        self.spelled = {" ": MARK}  # the normaliser's arcs that change a character
        self.arcs: list[dict[str, int]] = [{}]  # the piece transducer: by state, the state that a character leads to
        self.writes: list[str | None] = [None]  # by state, the piece that ends there
        for p in sorted(self.live):
            state = 0
            for c in p:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.writes.append(None)
                state = self.arcs[state][c]
            self.writes[state] = p
        self.pairs: dict[str, float] = {}
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merge(self, text: str, whole: bool = False):
        """Merge neighbours by rank, leftmost first: the parts; with ``whole`` the last
        two parts, or None if they don't merge into the text."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = min(((r[0], i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1]))), default=None)
            if best is None:
                break
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (last if len(parts) == 1 else None) if whole else parts

    def _meets(self, a: str, b: str) -> bool:
        """Whether the weight of b behind a is zero.

        Merges are undone from the latest on; if at some time the pieces that then
        touch could merge before the one undone was made, they would have."""
        if len(a) > 1 and a[-1] == MARK:  # runs of marks share a rank
            return self._merge(a + b) == [a, b]
        rank, made, most = self.rank, self.made, float("inf")
        while True:
            r = rank.get(a + b)
            if r and r[0] < most:
                return False
            x, y = made.get(a, -1), made.get(b, -1)
            if x > y:
                most, a = x, self.right[a]
            elif y >= 0:
                most, b = y + 0.5, self.left[b]  # of equal merges the left one comes first
            else:
                return True

    def weight(self, last: str | None, piece: str) -> float:
        """Of the arc that writes ``piece`` behind ``last``."""
        if last is None:
            return 0.0
        w = self.pairs.get(pair := f"{last}\t{piece}")
        if w is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            w = self.pairs[pair] = 0.0 if self._meets(last, piece) else INFINITE
        return w

    def written(self, text: str, at: int) -> list[tuple[int, str]]:
        """The pieces that paths through the piece transducer write from a place on, and where they end; a character
        that none of them spells goes through byte fallback."""
        arcs, writes, out, state = self.arcs, self.writes, [], 0
        for end in range(at, len(text)):
            state = arcs[state].get(text[end])
            if state is None:
                break
            if writes[state] is not None:
                out.append((end + 1, writes[state]))
        if not out or out[0][0] > at + 1:
            out.append((at + 1, text[at]))
        return out

    def path(self, part: str) -> list[str]:
        """The pieces on the shortest path through the lattice that a part is composed to.

        A state is a place and the piece written last.  The lightest open state is settled first, of equal ones the
        farthest; the arcs behind it are composed then.  The first settled state at the end closes the shortest path."""
        text = "".join([self.spelled.get(c, c) for c in part])
        n, start = len(text), (0, None)
        best: dict[tuple, tuple[float, tuple | None]] = {start: (0.0, None)}
        open_: list[tuple] = [(0.0, 0, start)]
        weight, met = self.weight, 0
        while open_:
            so_far, _, state = heapq.heappop(open_)
            at, last = state
            if so_far > best[state][0]:
                continue  # reached by a lighter path since
            if at == n:
                out = []
                while state[1] is not None:
                    out.append(state[1])
                    state = best[state][1]
                return out[::-1]
            for end, piece in self.written(text, at):
                total = so_far + weight(last, piece)
                if total < best.get((end, piece), (INFINITE,))[0]:
                    best[end, piece] = total, state
                    met += 1
                    heapq.heappush(open_, (total, -end * (1 << 32) + met, (end, piece)))
        raise AssertionError(f"no path through {part!r}")

    def _solved(self, part: str) -> bytes:
        ids = array("i")
        for piece in self.path(part):
            r = self.rank.get(piece)
            if r:
                ids.append(r[1])
            elif self.bytes_at:
                ids.extend(self.bytes_at[b] for b in piece.encode())
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Piece numbers, each in four bytes of this machine's order."""
        if not text:
            return b""
        if MARK in text:  # reads like a space
            text = text.replace(MARK, " ")
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        parts = _PART.findall(" " + text if self.prefix else text)
        found = [*map(self.parts.get, parts)]
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self._known(parts[i])
        return b"".join(found)

    def _known(self, part: str) -> bytes:
        """The path's numbers, from the memory of parts or anew; long parts are cut where no merge can cross."""
        found = self.parts.get(part) or self.older.get(part)
        if found is None:
            joined, cuts = self.joined, [0]
            marked = part.replace(" ", MARK)
            cuts += [i for i in range(1, len(part)) if marked[i - 1 : i + 1] not in joined]
            found = self._solved(part) if len(cuts) == 1 else b"".join([self._known(part[a:b]) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)])
        if len(part) <= 64:
            if len(self.parts) >= PARTS:
                self.older, self.parts = self.parts, {}
            self.parts[part] = found
        return found

    def decode(self, ids: bytes) -> str:
        """The text; bytes that are no UTF-8 become replacement characters."""
        numbers = array("i")
        numbers.frombytes(ids)
        out = self.out
        text = b"".join([out[i] for i in numbers]).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_machines: dict[str, Machine] = {}


def _machine(model: bytes) -> Machine:
    """One machine for each Python worker and model; its memory of parts outlives a task."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _machines:
        _machines[name] = Machine(model)
    return _machines[name]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: array of piece numbers."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches):
        m = _machine(model.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                packed = [m.encode(x) for x in part.column(1).to_pylist()]
                offsets = array("i", [0])
                for x in packed:
                    offsets.append(offsets[-1] + len(x) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    model = encoded.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches):
        m = _machine(model.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [m.decode(array("i", x or []).tobytes()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def digests(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode it again: DIGESTS.  ``ids_sha256`` is over the
    numbers as little-endian 32-bit integers; ``round_trip`` tells whether the
    decoded text is the text itself."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches):
        m = _machine(model.value)
        first, last = (min(m.bytes_at.values()), max(m.bytes_at.values())) if m.bytes_at else (0, -1)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = []
                for id_, text in zip(*(batch.column(i).slice(at, 1024).to_pylist() for i in range(2)), strict=True):
                    ids = m.encode(text)
                    back = m.decode(ids)
                    numbers = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)]).to_numpy(zero_copy_only=False)
                    small = int(((numbers >= first) & (numbers <= last)).sum())
                    rows.append((id_, len(numbers), small, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DIGESTS)
