"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The vocabulary of a given model file is used; nothing is trained. Text is escaped as the model
does (a leading space, spaces as U+2581), cut where no piece can reach across, and each unit is
merged by an agenda: candidates come off it in order of score, and a keyed hash of (seed, document,
number of the unit in it, place, piece) decides which are skipped. What a unit gives without skips is
remembered with the candidates met on the way; an occurrence whose own hash skips none of them gives
the same, and every other is merged on its own. Characters without a piece become bytes. Whatever is
skipped, the pieces of a unit spell the unit, so decoding gives the text back byte for byte.

With `dropout` 0 the ids are those of the SentencePiece library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.shingles import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LITERAL = "\ud800"  # stands for a U+2581 of the text itself
MASK = 0xFFFFFFFF
CACHED = 300_000  # units that a task remembers
SHORT = 24  # characters of units that are merged many at a time
CHUNK_BYTES = 1 << 19
NEVER = np.iinfo(np.int32).max


def _candidate(place, piece):
    """The part of a candidate's hash that is the same in all occurrences of a unit."""
    return (place * 0x9E3779B1 ^ piece * 0x85EBCA77) & MASK


def _hash(key, candidate):
    """Numbers or arrays of them, of 32 bits."""
    h = ((key ^ candidate) & MASK) * 0xC2B2AE3D & MASK
    h = (h ^ h >> 15) * 0x27D4EB2F & MASK
    return h ^ h >> 13


class Pieces:
    """The merges and the byte table of a BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece] = i
                self.rank[piece] = -model.get_score(i)
                self.bytes.append(piece.replace(SPACE, " ").encode())
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("pieces reach across spaces: units cannot be cut there")
        self._tabulate(longer)
        joined = set().union(*longer)  # characters that some merge can reach
        self.unit = re.compile(f"{SPACE}*[{re.escape(''.join(sorted(joined - {SPACE})))}]+|{SPACE}+|.", re.S)

    def _tabulate(self, longer: list[str]) -> None:
        """Pairs of pieces that make a piece, sorted by (left, right): what they make, and its place
        in the order of scores."""
        place = {r: i for i, r in enumerate(sorted({self.rank[p] for p in longer}))}  # equal scores stay equal: the leftmost goes first
        rows = [
            (self.ids[p[:k]] << 32 | self.ids[p[k:]], self.ids[p], place[self.rank[p]])
            for p in longer for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids
        ]
        rows.sort()
        self.pair = np.array([r[0] for r in rows], np.int64)
        self.made = np.array([r[1] for r in rows], np.int64)
        self.order = np.array([r[2] for r in rows], np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.whole = all(c in self.ids for p in longer for c in p)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.order[at], NEVER), self.made[at]

    def merge_many(self, units: list[str], keys: list[int] | np.ndarray, limit: int, traced: bool = False) -> tuple[list[tuple[int, ...]], list[list[int]]]:
        """`merge` of many units of one length; and with *traced* the candidates of each, as the part of
        their hash that has no key."""
        found = self.merge_arrays(units, keys, limit, traced)
        ids, traces = ([x.tolist() for x in np.split(flat, sizes.cumsum()[:-1])] for flat, sizes in (found[:2], found[2:]))
        return [tuple(x) for x in ids], traces if traced else []

    def merge_arrays(self, units: list[str], keys: list[int] | np.ndarray, limit: int, traced: bool = False) -> tuple[np.ndarray, ...]:
        """As `merge_many`, a step of all agendas at a time: ids and how many each unit has, candidates and
        how many each unit has."""
        n, length = len(units), len(units[0])
        flat = self.of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        symbols, key = flat.reshape(n, length).astype(np.int64), np.asarray(keys, np.int64)
        met: list[tuple[np.ndarray, np.ndarray]] = []
        after = np.tile(np.arange(1, length + 1, dtype=np.int32), (n, 1))
        before = after - 2
        alive = np.ones((n, length), bool)
        rank, made = np.full((n, length), NEVER, np.int32), np.zeros((n, length), np.int64)  # of the pair that begins here
        rank[:, :-1], made[:, :-1] = self._pairs(symbols[:, :-1], symbols[:, 1:])
        row = np.arange(n)
        while True:
            left = rank[row]
            at = left.argmin(1)
            more = left[np.arange(len(row)), at] < NEVER
            row, at = row[more], at[more]
            if not len(row):
                break
            piece = made[row, at]
            r, i = row, at
            if traced:
                met.append((r, _candidate(i, piece)))
            if limit:
                skipped = _hash(key[r], _candidate(i, piece)) < limit
                rank[r[skipped], i[skipped]] = NEVER
                r, i, piece = r[~skipped], i[~skipped], piece[~skipped]
            j = after[r, i]
            k = after[r, j]
            symbols[r, i], after[r, i] = piece, k
            alive[r, j], rank[r, j], rank[r, i] = False, NEVER, NEVER
            inner = k < length
            x, y, z = r[inner], i[inner], k[inner]
            before[x, z] = y
            rank[x, y], made[x, y] = self._pairs(symbols[x, y], symbols[x, z])
            k = before[r, i]
            inner = k >= 0
            x, y, z = r[inner], k[inner], i[inner]
            rank[x, y], made[x, y] = self._pairs(symbols[x, y], symbols[x, z])
        ids, sizes = symbols[alive].astype(np.int32), alive.sum(1)
        if (ids < 0).any():
            lists = [[x for a in np.flatnonzero(alive[i]).tolist() for x in ([symbols[i, a]] if symbols[i, a] >= 0 else self._as_bytes(units[i][a]))] for i in range(n)]
            ids, sizes = np.array([x for ids in lists for x in ids], np.int32), np.array([len(ids) for ids in lists], np.int64)
        who, what = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return ids, sizes, what[who.argsort(kind="stable")].astype(np.uint32), np.bincount(who, minlength=n)

    def _as_bytes(self, character: str) -> list[int]:
        raw = SPACE.encode() if character == LITERAL else character.encode("utf-8", "surrogateescape")
        return [self.byte_ids[b] for b in raw]

    def escaped(self, text: str) -> str:
        return (" " + text).replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""

    def merge(self, unit: str, key: int, limit: int, trace: list[int] | None = None) -> tuple[int, ...]:
        """Ids of one unit; candidates whose hash is below *limit* are skipped, and all are added to *trace*."""
        ids, rank = self.ids, self.rank
        symbols = list(unit)
        n = len(symbols)
        if n > 1:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            agenda = []
            for i in range(n - 1):
                piece = symbols[i] + symbols[i + 1]
                if (r := rank.get(piece)) is not None:
                    agenda.append((r, i, i + 1, piece))
            heapq.heapify(agenda)
            while agenda:
                _, i, j, piece = heapq.heappop(agenda)
                if symbols[i] is None or after[i] != j or symbols[j] is None or symbols[i] + symbols[j] != piece:
                    continue
                if trace is not None:
                    trace.append(_candidate(i, ids[piece]))
                if limit and _hash(key, _candidate(i, ids[piece])) < limit:
                    continue
                symbols[i], symbols[j] = piece, None
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    next_piece = piece + symbols[k]
                    if (r := rank.get(next_piece)) is not None:
                        heapq.heappush(agenda, (r, i, k, next_piece))
                k = before[i]
                if k >= 0:
                    next_piece = symbols[k] + piece
                    if (r := rank.get(next_piece)) is not None:
                        heapq.heappush(agenda, (r, k, i, next_piece))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if s in ids:
                    out.append(ids[s])
                else:
                    out += self._as_bytes(s)
        return tuple(out)

    def decode(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])[1:]


class Lists:
    """Lists of numbers, one behind the other in one array."""

    def __init__(self, kind):
        self.flat, self.size = np.empty(1 << 16, kind), 0
        self.starts, self.sizes, self.n = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, size = self.n + len(sizes), self.size + len(flat)
        if size > len(self.flat):
            self.flat = np.resize(self.flat, size * 5 // 4)
        if n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, n * 5 // 4), np.resize(self.sizes, n * 5 // 4)
        self.flat[self.size : size], self.sizes[self.n : n] = flat, sizes
        self.starts[self.n : n] = self.size + sizes.cumsum() - sizes
        self.n, self.size = n, size


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all members of lists that begin at *starts*."""
    ends = sizes.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Encoder:
    variants = 1  # what is remembered of a unit has no skips in it

    def __init__(self, pieces: Pieces, dropout: float, seed: int, cached: int = CACHED):
        self.pieces, self.seed, self.cached = pieces, seed, cached
        self.limit = int(dropout * (MASK + 1))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # of the unit in the lists
        self.ids, self.candidates = Lists(np.int32), Lists(np.uint32)  # without skips

    @property
    def known(self) -> list[dict[str, tuple[tuple[int, ...], tuple[int, ...]]]]:
        """What is remembered, by variant: ids without skips and candidates of each unit."""
        return [{u: tuple(tuple(x.flat[x.starts[i] : x.starts[i] + x.sizes[i]].tolist()) for x in (self.ids, self.candidates)) for u, i in self.number.items()}]

    def encode(self, texts: list[str], documents: list[int]) -> list[list[int]]:
        ids, sizes = self.encode_arrays(texts, documents)
        ends = sizes.cumsum().tolist()
        return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]

    def encode_arrays(self, texts: list[str], documents: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and how many each has."""
        per_text = [self.pieces.unit.findall(self.pieces.escaped(t)) for t in texts]
        n_units = np.array([len(us) for us in per_text], np.int64)
        keys = np.concatenate([self._keys(d, len(us)) for d, us in zip(documents, per_text)]) if self.limit and texts else None
        flat = [u for us in per_text for u in us]
        del per_text
        if not flat:
            return np.zeros(0, np.int32), n_units
        if len(self.number) >= self.cached or self.ids.size >= 16 * self.cached:
            self._forget()
        number = self.number
        # Longer units are too rare and too large to keep, and hardly ever without a skip.
        self._learn([(0, u) for u in dict.fromkeys(flat) if u not in number and not (self.limit and len(u) > SHORT)])
        which = np.fromiter(map(number.get, flat, repeat(-1)), np.int64, len(flat))
        sizes = np.where(which >= 0, self.ids.sizes[which], 0)
        again: list[tuple[np.ndarray, np.ndarray]] = []
        if self.limit:
            some = self._skipping(which, keys)
            for part, ids, n, _, _ in self._merged([flat[o] for o in some.tolist()], keys[some], self.limit):
                again.append((some[part], ids))
                sizes[some[part]] = n
            which[some] = -1
        else:
            for u in [u for u in dict.fromkeys(flat) if len(u) > SHORT]:
                del number[u]
        ends = sizes.cumsum()
        starts, out = ends - sizes, np.empty(ends[-1], np.int32)
        plain = np.flatnonzero(which >= 0)
        out[_places(starts[plain], sizes[plain])] = self.ids.flat[_places(self.ids.starts[which[plain]], sizes[plain])]
        for part, ids in again:
            out[_places(starts[part], sizes[part])] = ids
        last = n_units.cumsum()
        upto = np.concatenate(([0], ends))
        return out, upto[last] - upto[last - n_units]

    def _keys(self, document: int, n: int) -> np.ndarray:
        """A key of 32 bits for each unit of a document."""
        with np.errstate(over="ignore"):
            start = np.array([(document * 0x9E3779B97F4A7C15 + self.seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF], np.uint64)
            return (mix(start + np.arange(n, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.int64)

    def _skipping(self, which: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The occurrences that skip a candidate of their unit, and those of units that are not kept."""
        skips = which < 0
        kept = np.flatnonzero(~skips)
        sizes = self.candidates.sizes[which[kept]]
        met = self.candidates.flat[_places(self.candidates.starts[which[kept]], sizes)].astype(np.int64)
        of = np.repeat(kept, sizes)
        skips[of[_hash(keys[of], met) < self.limit]] = True
        return np.flatnonzero(skips)

    def _learn(self, missing: Iterable[tuple[int, str]]) -> None:
        units = [u for _, u in missing]
        for part, ids, sizes, met, n_met in self._merged(units, np.zeros(len(units), np.int64), 0, traced=True):
            self.number.update(zip([units[i] for i in part.tolist()], range(self.ids.n, self.ids.n + len(part))))
            self.ids.add(ids, sizes)
            self.candidates.add(met, n_met)

    def _merged(self, units: list[str], keys: np.ndarray, limit: int, traced: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """Units of one length at a time: their places in *units*, and what `Pieces.merge_arrays` gives."""
        if not units:
            return
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = lengths.argsort(kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if 1 < lengths[some[0]] <= SHORT and len(some) > 8 and self.pieces.whole:
                for start in range(0, len(some), 8192):
                    part = some[start : start + 8192]
                    yield part, *self.pieces.merge_arrays([units[i] for i in part.tolist()], keys[part], limit, traced)
            else:
                traces: list[list[int]] = [[] for _ in some]
                lists = [self.pieces.merge(units[i], int(keys[i]), limit, t if traced else None) for i, t in zip(some.tolist(), traces)]
                flat = [np.array([x for one in those for x in one], kind) for those, kind in ((lists, np.int32), (traces, np.uint32))]
                yield some, flat[0], np.array([len(x) for x in lists], np.int64), flat[1], np.array([len(x) for x in traces], np.int64)


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 1, model: str = MODEL, decoded: str | None = None,
) -> DataFrame:
    """*docs* with further columns n_tokens and token_ids (array<int>), and on demand *decoded*, the text
    that the ids give (as `decode` would, without a second pass).

    The ids depend on the text, the identifier (null counts as 0), *seed* and *dropout* only, not on how rows are dealt out. A null or empty text has no ids. Rows that repeat an
    identifier and text get the same ids. An empty table gives an empty result. Columns of *docs*
    that bear the names of the new ones are replaced.
    """
    docs = docs.drop("n_tokens", "token_ids", *([decoded] if decoded else []))
    schema = f"{docs._jdf.schema().toDDL()}{', ' if docs.columns else ''}n_tokens bigint, token_ids array<int>{f', `{decoded}` binary' if decoded else ''}"
    out = docs.mapInArrow(_encoded(docs.columns.index(id_col), docs.columns.index(text_col), dropout, seed, model, decoded), schema)
    return out.withColumn(decoded, F.col(decoded).cast("string")) if decoded else out


def decode(encoded: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """*encoded* with a column *out_col*, the text of its ids; null ids give the empty text."""
    rows = encoded.drop(out_col)
    return rows.mapInArrow(_decoded(rows.columns.index(ids_col), model, out_col), f"{rows._jdf.schema().toDDL()}, `{out_col}` binary").withColumn(out_col, F.col(out_col).cast("string"))


def _encoded(id_at: int, text_at: int, dropout: float, seed: int, model: str, decoded: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        encoder = Encoder(pieces, dropout, seed)
        for batch in batches:
            names = [*batch.schema.names, "n_tokens", "token_ids", *([decoded] if decoded else [])]
            column = batch.column(text_at).cast(pa.binary())
            upto = np.concatenate(([0], pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()))
            start = 0
            while start < len(batch):
                end = max(start + 1, int(np.searchsorted(upto, upto[start] + CHUNK_BYTES, "right")) - 1)
                texts = [(x or b"").decode("utf-8", "surrogateescape") for x in column.slice(start, end - start).to_pylist()]
                ids, lengths = encoder.encode_arrays(texts, [d or 0 for d in batch.column(id_at).slice(start, end - start).to_pylist()])
                ends = np.concatenate(([0], lengths.cumsum()))
                more = [pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
                if decoded:
                    more.append(pa.array([pieces.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, *more], names)
                start = end

    return run


def _decoded(ids_at: int, model: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            column = batch.column(ids_at)
            texts = [pieces.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, name])

    return run
