"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three machines: the normaliser (space to the
meta symbol, the added first space, space removal if the model asks for it), the
pieces as a prefix tree whose paths emit piece ids, and the byte fallback, which
emits the UTF-8 bytes of a character without a piece. Each input is composed
with them on the fly, and the shortest path in the tropical semiring (costs add,
the least wins) is the encoding.

Costs are the negated piece scores in a unigram model. In a merge (BPE) model a
step costs 1 unless merging would not have left its piece behind the one before,
which costs infinity; merges act locally, so exactly one path is finite, and it is
the merge result. No path step goes over two neighbouring characters that no
piece holds side by side, so texts are cut there (before runs of spaces, first of
all), equal cuts are composed once for many texts, all at the same time as
arrays, and each worker keeps the paths of frequent ones.
"""

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest model file that is sent to the tasks.
MAX_MODEL_BYTES = 64 << 20
#: A worker forgets its paths and pair checks beyond so many (tens of MB).
MAX_KEPT = 400_000
#: Different characters in the pieces of a model, at most.
MAX_CLASSES = 16_000
#: Longer cuts of characters are never kept, and composed one by one.
MAX_KEPT_RUN = 48
#: Characters of text that are composed at a time.
CHARS_AT_ONCE = 1 << 20
META = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) fields of one message in the model file."""
    def varint(at):
        shift = value = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if size == 4 else "<d", raw[at:at + size])[0], at + size
        yield tag >> 3, value


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and flags of a model file, as plain values."""
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"model file over {MAX_MODEL_BYTES} bytes")
    m = {"pieces": [], "scores": [], "kinds": [], "type": _UNIGRAM, "prefix": True, "trim": True}
    for number, value in _fields(raw):
        if number == 1:
            p = dict(_fields(value))
            m["pieces"].append(p.get(1, b"").decode("utf-8"))
            m["scores"].append(p.get(2, 0.0))
            m["kinds"].append(p.get(3, _NORMAL))
        elif number == 2:
            m["type"] = dict(_fields(value)).get(3, _UNIGRAM)
        elif number == 3:
            n = dict(_fields(value))
            if n.get(2):
                raise ValueError("models with a character map in the normaliser are not supported")
            m["prefix"], m["trim"] = bool(n.get(3, 1)), bool(n.get(4, 1))
    if m["type"] not in (_UNIGRAM, _BPE):
        raise ValueError("only unigram and BPE models can be compiled")
    return m


class Transducer:
    """A compiled model."""

    def __init__(self, model: dict):
        self.pieces, self.merges = model["pieces"], model["type"] == _BPE
        self.prefix, self.trim = model["prefix"], model["trim"]
        kinds, scores = model["kinds"], model["scores"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] in (_NORMAL, _USER)}
        self.scores = scores
        self.unknown = next((i for i, k in enumerate(kinds) if k == _UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == _BYTE}
        self.low = min((scores[i] for i in self.ids.values()), default=0.0) - 10
        self.tree: dict = {}
        for piece, i in self.ids.items():
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self._tables()
        self.out = [b""] * len(self.pieces)  # what an id decodes to; bytes and pieces alike
        for p, i in self.ids.items():
            self.out[i] = p.replace(META, " ").encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.out[self.unknown] = " ⁇ ".encode()
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.cuts: dict[str, bytes] = {}

    def _tables(self) -> None:
        """The prefix tree as sorted arrays: a step from a state by a character
        is found under ``state << 21 | character``."""
        keys, accepts, todo, count = [], [-1], [(0, self.tree)], 1
        targets = []
        while todo:
            state, node = todo.pop()
            for c, child in node.items():
                if c == "":
                    continue
                keys.append(state << 21 | ord(c))
                targets.append(count)
                accepts.append(child.get("", -1))
                todo.append((count, child))
                count += 1
        order = np.argsort(keys)
        self.step_keys, self.step_to = np.array(keys, np.int64)[order], np.array(targets, np.int64)[order]
        self.accepts = np.array(accepts, np.int64)
        # characters by number (0: in no piece), and which pairs occur side by side
        chars = sorted({c for p in self.ids for c in p})
        self.classes = len(chars) + 1
        if self.classes > MAX_CLASSES:
            raise ValueError(f"the pieces have more than {MAX_CLASSES} characters")
        number = {c: i for i, c in enumerate(chars, 1)}
        self.char_class = np.zeros(0x110000, np.int64)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, self.classes)
        self.beside = np.zeros(self.classes ** 2, bool)
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self.beside[number[a] * self.classes + number[b]] = True

    # ------------------------------------------------------------ encoding

    def _merged(self, text: str) -> list[str]:
        """Merging from characters: the best scored neighbours first, the left of equals."""
        ids, scores, parts = self.ids, self.scores, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, key: int) -> bool:
        """Whether merging leaves a piece behind another (or at a start): ``key``
        is ``(last + 1) * number of pieces + piece``."""
        last, piece = divmod(key, len(self.pieces))
        a, b = self.pieces[last - 1] if last else "", self.pieces[piece]
        if a and a + b in self.ids:
            return False  # these two would have been merged
        return self._merged(a + b) == ([a, b] if a else [b])

    def _step(self, last: int, piece: int) -> float:
        """Cost of ``piece`` behind the piece ``last`` (-1: start or a fallback)."""
        if not self.merges:
            return -self.scores[piece]
        key = (last + 1) * len(self.pieces) + piece
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > MAX_KEPT:
                self.pairs.clear()
            ok = self.pairs[key] = self._follows(key)
        return 1.0 if ok else float("inf")

    def _steps(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``_step`` of many; what was found is kept in sorted arrays."""
        if not self.merges:
            return -np.array(self.scores)[piece]
        keys, back = np.unique((last + 1) * len(self.pieces) + piece, return_inverse=True)
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        known = self.pair_keys[at] == keys if len(self.pair_keys) else np.zeros(len(keys), bool)
        ok = np.zeros(len(keys), bool)
        ok[known] = self.pair_ok[at[known]]
        if not known.all():
            new = keys[~known]
            ok[~known] = [self._follows(int(k)) for k in new]
            if len(self.pair_keys) > 5 * MAX_KEPT:
                self.pair_keys, self.pair_ok = new, ok[~known]
            else:
                merged = np.concatenate([self.pair_keys, new])
                order = np.argsort(merged, kind="stable")
                self.pair_keys, self.pair_ok = merged[order], np.concatenate([self.pair_ok, ok[~known]])[order]
        return np.where(ok, 1.0, np.inf)[back]

    def paths_of(self, cuts: list[str]) -> list[bytes]:
        """``path`` of many short cuts whose characters all have pieces, as
        arrays: row by row the same steps, one position after the other."""
        n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        rows, width = len(cuts), int(n.max(initial=0))
        flat = np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)
        char = np.zeros((rows, width), np.int64)
        char[np.arange(width) < n[:, None]] = flat
        cost = np.full((rows, width + 1), np.inf)
        cost[:, 0] = 0
        back, last = np.zeros((rows, width + 1), np.int64), np.full((rows, width + 1), -1, np.int64)
        for j in range(width):
            row = np.flatnonzero((n > j) & np.isfinite(cost[:, j]))
            state, i, found = np.zeros(len(row), np.int64), j, []
            while len(row) and i < width:
                key = state << 21 | char[row, i]
                at = np.searchsorted(self.step_keys, key)
                at[at == len(self.step_keys)] = 0
                hit = (self.step_keys[at] == key) & (n[row] > i)
                row, state, i = row[hit], self.step_to[at[hit]], i + 1
                piece = self.accepts[state]
                use = piece >= 0
                if self.merges:  # a position that is reached has its only finite path
                    use &= ~np.isfinite(cost[row, i])
                found.append((row[use], np.full(int(use.sum()), i), piece[use]))
            if not found:
                continue
            row, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
            new = cost[row, j] + self._steps(last[row, j], piece)
            better = new < cost[row, end]
            row, end, piece, new = row[better], end[better], piece[better], new[better]
            cost[row, end], back[row, end], last[row, end] = new, j, piece
        ids, at, size = np.zeros((rows, width), np.int32), n.copy(), np.zeros(rows, np.int64)
        row = np.flatnonzero(at > 0)
        while len(row):  # from the ends back to the starts
            size[row] += 1
            ids[row, width - size[row]] = last[row, at[row]]
            at[row] = back[row, at[row]]
            row = row[at[row] > 0]
        raw = ids.astype("<i4").tobytes()
        step = 4 * width
        return [raw[r * step + step - 4 * k:(r + 1) * step] for r, k in enumerate(size.tolist())]

    def path(self, run: str) -> list[int]:
        """Ids on the shortest path through one normalised run of characters."""
        n, inf = len(run), float("inf")
        cost, back, last = [inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        cost[0], step, tree = 0.0, self._step, self.tree
        for j in range(n):
            c, prev, node, i = cost[j], last[j], tree, j
            if c == inf:
                continue
            while i < n:
                node = node.get(run[i])
                if node is None:
                    break
                i += 1
                piece = node.get("")
                if piece is not None and (new := c + step(prev, piece)) < cost[i]:
                    cost[i], back[i], last[i] = new, j, piece
            if run[j] not in self.ids and (new := c + (1.0 if self.merges else -self.low)) < cost[j + 1]:
                cost[j + 1], back[j + 1], last[j + 1] = new, j, -1
        out, i = [], n
        while i:
            j = back[i]
            if last[i] >= 0:
                out.append(last[i])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(run[j:i].encode("utf-8", "replace"))]
            else:
                out.append(self.unknown)
            i = j
        return out[::-1]

    def normalise(self, text: str) -> str:
        """Spaces for meta symbols, cut or added as the model says."""
        text = text.replace(META, " ")
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if text and self.prefix else text

    def _cut_marks(self, text: str) -> np.ndarray:
        """Where a new cut starts in a text: between characters that no piece holds side by side."""
        c = self.char_class[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return np.concatenate([[True], ~self.beside[c[:-1] * self.classes + c[1:]]])

    def _keep(self, cuts: set[str]) -> dict[str, bytes]:
        """Find the paths of all ``cuts`` that are not kept yet; those of long
        cuts are returned, not kept."""
        if len(self.cuts) > MAX_KEPT:
            self.cuts.clear()
        todo = [c for c in cuts if c not in self.cuts]
        short = sorted((c for c in todo if len(c) <= MAX_KEPT_RUN and (len(c) > 1 or c in self.ids)), key=len)
        for a in range(0, len(short), 1 << 14):  # cuts of like length side by side
            part = short[a:a + (1 << 14)]
            self.cuts.update(zip(part, self.paths_of(part), strict=True))
        once = {}
        for c in todo:
            if c not in self.cuts:  # a character without a piece, or a long cut
                (self.cuts if len(c) <= MAX_KEPT_RUN else once)[c] = np.array(self.path(c), "<i4").tobytes()
        return once

    def _encode_part(self, texts: list[str | None]) -> list[bytes | None]:
        texts = [None if t is None else self.normalise(t).replace(" ", META) for t in texts]
        joined = "".join(t for t in texts if t)
        if not joined:
            return [None if t is None else b"" for t in texts]
        ends = np.cumsum([len(t or "") for t in texts])
        marks = np.append(self._cut_marks(joined), True)
        marks[ends] = True
        at = np.flatnonzero(marks)
        bounds = at.tolist()
        cuts = [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        once = self._keep(set(cuts))
        found = list(map((self.cuts | once if once else self.cuts).__getitem__, cuts))
        last = np.searchsorted(at, ends).tolist()
        out = [None if t is None else b"".join(found[a:b]) for t, a, b in zip(texts, [0, *last], last, strict=False)]
        return out if self.bytes else [x and self._one_unknown(x) for x in out]

    def _one_unknown(self, raw: bytes) -> bytes:
        """Without byte fallback, unknown characters in a row are one unknown id."""
        ids = np.frombuffer(raw, "<i4")
        off = ids == self.unknown
        off[1:] &= off[:-1].copy()
        off[:1] = False
        return ids[~off].tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of whole texts, as little-endian 32-bit integers."""
        out, part, held = [], [], 0
        for text in texts:
            part.append(text)
            held += len(text or "")
            if held > CHARS_AT_ONCE:
                out += self._encode_part(part)
                part, held = [], 0
        return out + self._encode_part(part)

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    # ------------------------------------------------------------ decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD, the added
        first space goes, ids outside the vocabulary and control ids are skipped."""
        out, size = self.out, len(self.out)
        if ids and not 0 <= min(ids) <= max(ids) < size:
            ids = [i for i in ids if 0 <= i < size]
        raw = b"".join(map(out.__getitem__, ids)).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw[:1] == " " else raw


def _compiled(shared) -> Transducer:
    """The transducer of a broadcast model, built once in each worker."""
    value = shared.value
    if "compiled" not in value:
        value["compiled"] = Transducer(value)
    return value["compiled"]


class SentencePiece:
    """Columns that encode and decode with one model file (read on the driver;
    its size is bounded, its values are broadcast)."""

    def __init__(self, spark: SparkSession, path: str):
        self.shared = spark.sparkContext.broadcast(read_model(path))

    def encode(self, text: Column) -> Column:
        """Ids of a text column (array<int>); null for null, empty for empty."""
        shared = self.shared

        def run(texts: pa.Array) -> pa.Array:
            return _id_lists(_compiled(shared).encode_all(texts.to_pylist()))

        return F.arrow_udf(run, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        """Text of an id column; null for null, null ids are skipped."""
        shared = self.shared

        def run(rows: pa.Array) -> pa.Array:
            t = _compiled(shared)
            flat = pc.fill_null(rows.flatten(), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)).tolist()
            return pa.array([t.decode(flat[a:b].tolist()) if ok else None
                             for a, b, ok in zip([0, *ends], ends, rows.is_valid().to_pylist(), strict=False)], pa.string())

        return F.arrow_udf(run, "string")(ids)

    def encode_and_check(self, text: Column) -> Column:
        """``ids`` of a text column, and ``same``: whether they decode to the
        text again (a literal meta symbol counts as a space); both null for null.
        The ids are decoded where they are made and need not travel for it."""
        shared = self.shared

        def run(texts: pa.Array) -> pa.Array:
            t, rows = _compiled(shared), texts.to_pylist()
            found = t.encode_all(rows)
            same = [None if x is None else t.decode(np.frombuffer(x, "<i4").tolist()) == row.replace(META, " ")
                    for x, row in zip(found, rows, strict=True)]
            return pa.StructArray.from_arrays([_id_lists(found), pa.array(same, pa.bool_())], ["ids", "same"])

        return F.arrow_udf(run, "struct<ids:array<int>,same:boolean>")(text)


def _id_lists(parts: list[bytes | None]) -> pa.Array:
    sizes = np.fromiter((len(p) // 4 if p else 0 for p in parts), np.int64, len(parts))
    values = pa.array(np.frombuffer(b"".join(p for p in parts if p), "<i4"))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    nulls = np.array([p is None for p in parts] + [False])  # a null start marks a null list
    return pa.ListArray.from_arrays(pa.array(ends, mask=nulls) if nulls.any() else pa.array(ends), values)


def with_pieces(docs: DataFrame, model: str, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """``docs`` and the ids of ``text_col`` as ``out_col`` (which replaces a
    column of that name). Null texts give null, empty ones an empty array;
    everything else passes through."""
    return docs.withColumn(out_col, SentencePiece(docs.sparkSession, model).encode(F.col(text_col)))
