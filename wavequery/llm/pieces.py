"""SentencePiece encoding and decoding by suffix-array matching.

The model (BPE with byte fallback) is read from its file and goes to the
executors with the task.  Text is cut between neighbours that no piece holds,
so no token can cross a cut.  The distinct cuts of a batch that the worker has
not met yet are concatenated; a suffix array of that text (sorted by the first
``longest piece`` characters) is binary-searched for every piece, the resulting
occurrence ranges become edges (start, length, piece), edges are sorted by
where they end, and positions are relaxed in order, all cuts at once.

Relaxation: a token sequence is the BPE encoding exactly if every two
neighbours are the encoding of their own concatenation.  So among the edges
that end at a position, the one that is kept is the longest whose piece agrees
with the token kept where it starts.  If none agrees, the cut is merged plainly.
Cuts of over ``FAR`` characters (runs without any place to cut) are merged
window by window; neighbours agree where windows meet, so the result is exact.

Encoding a text and decoding the ids gives the text back, but for U+2581, which
the format itself writes for a space.  Every text's ids are decoded and compared;
where they differ for any other reason (two cuts with one hash), the text is
encoded anew without what the worker remembers, so results don't depend on a
worker's history.

Edge cases: null and empty texts have no ids and decode to the empty text;
characters without a piece become their UTF-8 bytes; repeated rows, and rows
without a doc_id, are encoded each; very long texts are encoded whole, in parts
of bounded size; an empty table gives an empty result; other columns are kept,
those named as the operator's own replaced.
"""

from __future__ import annotations

import heapq
import struct
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_bytes, map_arrow, read_documents, row_steps, span_hashes, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6

#: Characters of text that are cut and encoded at a time; of new cuts that one
#: suffix array indexes; cuts that a worker remembers.
PART, INDEX, REMEMBERED = 1 << 19, 1 << 16, 300_000

#: Characters of a cut from which it is merged in windows; of a window; of what
#: is left to the next window.
FAR, WINDOW, LEFT = 1024, 4096, 128


def _fields(data: bytes):
    """(number, value) of a protobuf message: ints, 4-byte floats, bytes."""
    i, n = 0, len(data)

    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = {5: 4, 1: 8}[kind]
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def load_model(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            out.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
    return out


class Pieces:
    """Encoder and decoder of one model; what it learns of cuts it remembers."""

    def __init__(self, model: list[tuple[str, float, int]]) -> None:
        self.model = model
        self.ids = {p: i for i, (p, _, kind) in enumerate(model) if kind == NORMAL}
        self.costs = {p: -s for p, s, kind in model if kind == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(model) if kind == BYTE}
        self.plain = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else p.encode() if kind == NORMAL else b"" for p, _, kind in model]
        self.plain_bytes = np.frombuffer(b"".join(self.plain), np.uint8)
        self.plain_sizes = np.array([len(x) for x in self.plain])
        self.plain_starts = np.cumsum(self.plain_sizes) - self.plain_sizes
        self.longest = max(map(len, self.ids), default=1)
        # Neighbours that some piece holds: a text can be cut between all others.
        within = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.rank = np.zeros(0x110000, np.int16)
        self.rank[[ord(c) for c in within]] = np.arange(1, len(within) + 1)
        self.joined = np.zeros((len(within) + 1, len(within) + 1), bool)
        for p in self.ids:
            r = self.rank[[ord(c) for c in p]]
            self.joined[r[:-1], r[1:]] = True
        chars = sorted({c for p in self.ids for c in p})
        # Two bytes a character, none 0 or 255, so keys sort and pad as bytes; 1, 1 is any other.
        codes = {c: bytes([2 + k // 253, 1 + k % 253]) for k, c in enumerate(chars)}
        self.codes = np.full(0x110000, 0x0101, "<u2")
        self.codes[[ord(c) for c in chars]] = [int.from_bytes(codes[c], "little") for c in chars]
        self.width = 2 * self.longest
        by_key = sorted((b"".join(codes[c] for c in p), len(p), i) for p, i in self.ids.items())
        self.keys = np.array([k for k, _, _ in by_key], f"S{self.width}")
        self.ends = np.array([k.ljust(self.width, b"\xff") for k, _, _ in by_key], f"S{self.width}")
        self.lengths = np.array([n for _, n, _ in by_key])
        self.of_key = np.array([i for _, _, i in by_key])
        self._learn_merges()
        self.forget()

    def _learn_merges(self) -> None:
        """Pieces by rank (the order in which merges are preferred), the two parts
        that each is merged from, and which pairs are merged into which piece."""
        order = sorted(self.ids, key=lambda p: (self.costs[p], self.ids[p]))
        rank = {p: r for r, p in enumerate(order)}
        self.rank_of = np.zeros(len(self.model), np.int64)
        self.rank_of[[self.ids[p] for p in order]] = np.arange(len(order))
        self.left, self.right = np.arange(len(order)), np.arange(len(order))
        pairs = []
        for r, p in enumerate(order):
            pairs += [(rank[p[:k]] * len(order) + rank[p[k:]], r) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
            if len(p) > 1 and (parts := self.merged(p, last=True)) is not None:
                self.left[r], self.right[r] = rank[parts[0]], rank[parts[1]]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of known cuts, sorted
        self.places = np.zeros((0, 2), np.int64)  # where each one's ids are, and how many
        self.new_hashes, self.new_places = self.hashes, self.places  # the same, learned lately
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    # -------------------------------------------------------------- encoding
    def merged(self, cut: str, last: bool = False):
        """Plain BPE: the best-scored, leftmost pair is merged until none is left.
        ``last``: the two parts of the merge that makes all of it, or None."""
        if len(cut) > 64:
            return self._merged_by_heap(cut)
        parts, none, cost, pair = list(cut), float("inf"), self.costs.get, None
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < none:
            k = costs.index(best)
            pair = parts[k : k + 2]
            parts[k : k + 2] = [pair[0] + pair[1]]
            del costs[k]
            if k:
                costs[k - 1] = cost(parts[k - 1] + parts[k], none)
            if k < len(costs):
                costs[k] = cost(parts[k] + parts[k + 1], none)
        if last:
            return pair if len(parts) == 1 else None
        return parts

    def _merged_by_heap(self, cut: str) -> list[str]:
        parts: list[str | None] = list(cut)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(c, i, cut[i : i + 2]) for i in range(n - 1) if (c := self.costs.get(cut[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(piece) or parts[i] + parts[j] != piece:
                continue  # a neighbour has changed meanwhile
            parts[i], parts[j], after[i] = piece, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (c := self.costs.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (c, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    def _plain_ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        return out

    def merged_far(self, cut: str) -> np.ndarray:
        """The ids of a long cut: windows are merged one after the other, each
        from where the one before is settled; if the tokens that meet there don't
        agree, from a token earlier."""
        done, parts, at = [], [], 0
        while at < len(cut):
            more = self.merged(cut[at : at + WINDOW])
            if parts and parts[-1] in self.ids and more[0] in self.ids and self.merged(parts[-1] + more[0]) != [parts[-1], more[0]]:
                at -= len(parts.pop())
                continue
            if at + WINDOW < len(cut):
                rest = 0
                while rest < LEFT:
                    rest += len(more.pop())
            at += sum(map(len, more))
            parts += more
            if len(parts) > 4096:
                done.append(np.array(self._plain_ids(parts[:-1024]), np.int32))
                parts = parts[-1024:]
        return np.concatenate([*done, np.array(self._plain_ids(parts), np.int32)])

    def direct(self, text: str) -> np.ndarray:
        """The ids of a text (with its spaces marked) by merging alone."""
        units = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        rank = self.rank[units]
        start = np.flatnonzero(np.append(True, ~self.joined[rank[:-1], rank[1:]])).tolist()
        out = [np.zeros(0, np.int32)]
        for a, b in zip(start, [*start[1:], len(text)]):
            out.append(self.merged_far(text[a:b]) if b - a > FAR else np.array(self._plain_ids(self.merged(text[a:b])), np.int32))
        return np.concatenate(out)

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b encode their own concatenation; a < 0 is a
        character without a piece, which merges with nothing.

        They don't if a merge across the border comes before the merges that make
        the two.  The last part of the left piece and the first part of the right
        one meet there at every moment: seen backwards, the one of the later merge
        is taken apart, and a pair that meets must not have a merge that is
        preferred to the one that was just undone."""
        out = np.ones(len(a), bool)
        todo = np.flatnonzero(a >= 0)
        x, y = self.rank_of[a[todo]], self.rank_of[b[todo]]
        n = len(self.left)
        limit = np.full(len(todo), n + 1)
        while len(todo):
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            out[todo[bad]] = False
            left_later = x > y
            # Undo the later merge; if that piece has no parts, the other one's.
            x2, y2 = self.right[x], self.left[y]
            take_x = np.where(left_later, x2 != x, (y2 == y) & (x2 != x))
            take_y = np.where(left_later, (x2 == x) & (y2 != y), y2 != y)
            limit = np.where(take_x, x, y + 1)
            x, y = np.where(take_x, x2, x), np.where(take_y, y2, y)
            go = ~bad & (take_x | take_y)
            todo, x, y, limit = todo[go], x[go], y[go], limit[go]
        return out

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of all occurrences of all pieces."""
        units = self.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tobytes()
        padded = np.frombuffer(units + bytes(self.width), np.uint8)
        suffixes = np.lib.stride_tricks.as_strided(padded, (len(text), self.width), (2, 1)).copy().view(f"S{self.width}").ravel()
        order = np.argsort(suffixes)
        ranked = suffixes[order]
        lo, hi = np.searchsorted(ranked, self.keys, "left"), np.searchsorted(ranked, self.ends, "right")
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return order[lo[which] + inside], self.lengths[which], self.of_key[which]

    def encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the cuts in a row, and how many each has: one suffix array
        for all, then every position relaxed, the same offset of all cuts at once."""
        text = "".join(cuts)
        size = np.array([len(c) for c in cuts])
        first = np.cumsum(size) - size
        own = np.repeat(np.arange(len(cuts)), size)
        start, length, piece = self.edges(text)
        inside = start + length <= first[own[start]] + size[own[start]]
        start, length, piece = start[inside], length[inside], piece[inside]
        offset = start + length - first[own[start]]
        group = offset * (self.longest + 1) + (self.longest - length)
        by = np.argsort(group)
        start, length, piece, offset, group = start[by], length[by], piece[by], offset[by], group[by]
        bounds = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        bounds = np.append(bounds, len(group)) if len(bounds) == 0 or bounds[-1] != len(group) else bounds
        alone = np.ones(len(text), bool)  # characters without a piece
        alone[start[length == 1]] = False
        # kept[p]: the token that ends after character p; back[p]: its length.
        kept, back = np.full(len(text), -2, np.int64), np.zeros(len(text), np.int64)
        kept[alone], back[alone] = -1, 1
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            s, n, t = start[lo:hi], int(length[lo]), piece[lo:hi]
            open_ = kept[s + n - 1] == -2
            if offset[lo] > n:
                before = kept[s - 1]
                open_ &= before != -2
                open_[open_] = self.agree(before[open_], t[open_])
            kept[s[open_] + n - 1], back[s[open_] + n - 1] = t[open_], n
        # From each cut's end back to its start, all cuts a step at a time.
        at, which = first + size - 1, np.arange(len(cuts))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        failed = np.zeros(len(cuts), bool)
        while len(at):
            failed[which[back[at] == 0]] = True
            good = back[at] > 0
            at, which = at[good], which[good]
            steps.append((at, which))
            at = at - back[at]
            more = at >= first[which]
            at, which = at[more], which[more]
        ends = np.sort(np.concatenate([x[~failed[w]] for x, w in steps])) if steps else np.zeros(0, np.int64)
        ids, of = kept[ends], own[ends]
        plain = np.flatnonzero(ids < 0)
        if len(plain) or failed.any():
            out, sizes = [], np.zeros(len(cuts), np.int64)
            cells: list[list[int]] = [[] for _ in cuts]
            for k, e, c in zip(ids.tolist(), ends.tolist(), of.tolist()):
                cells[c] += [k] if k >= 0 else [self.bytes[b] for b in text[e].encode()]
            for c in np.flatnonzero(failed).tolist():
                cells[c] += self._plain_ids(self.merged(cuts[c]))
            for c, x in enumerate(cells):
                out += x
                sizes[c] = len(x)
            return np.array(out, np.int32), sizes
        return ids.astype(np.int32), np.bincount(of, minlength=len(cuts))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Place and size of the ids of known cuts; size -1: not known."""
        out = np.full((len(hashes), 2), -1, np.int64)
        for table, places in ((self.hashes, self.places), (self.new_hashes, self.new_places)):
            if len(table):
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                hit = table[at] == hashes
                out[hit] = places[at[hit]]
        return out

    def learn(self, hashes: np.ndarray, cuts: list[str]) -> None:
        ids, sizes = (x := self.merged_far(cuts[0]), np.array([len(x)])) if len(cuts[0]) > FAR else self.encode_cuts(cuts)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        places = np.stack([self.used + np.cumsum(sizes) - sizes, sizes], 1)
        self.used += len(ids)
        self.new_hashes, self.new_places = _sorted(np.concatenate([self.new_hashes, hashes]), np.concatenate([self.new_places, places]))
        if len(self.new_hashes) > 50_000:
            self.hashes, self.places = _sorted(np.concatenate([self.hashes, self.new_hashes]), np.concatenate([self.places, self.new_places]))
            self.new_hashes, self.new_places = self.hashes[:0], self.places[:0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts in a row, how many each has, and whether the ids
        give the text back.  Takes the texts together; see ``encode_all``."""
        text = "".join(texts)
        units = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        if not len(units):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        rank = self.rank[units]
        cut = np.ones(len(units), bool)
        cut[1:] = ~self.joined[rank[:-1], rank[1:]]
        cut[offs[:-1][offs[:-1] < len(units)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(units))
        hashes, where, inverse = np.unique(span_hashes(units.view(np.uint8), 4 * start, 4 * end), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(self.lookup(hashes)[:, 1] < 0)
        new = new[np.argsort(end[where[new]] - start[where[new]], kind="stable")]
        begin, stop = start[where[new]], end[where[new]]
        chars = np.cumsum(stop - begin)
        near = int(np.searchsorted(stop - begin, FAR, "right"))
        i = 0
        while i < len(new):  # a suffix array for INDEX characters; longer cuts alone
            j = min(near, max(i + 1, int(np.searchsorted(chars, (chars[i - 1] if i else 0) + INDEX, "right")))) if i < near else i + 1
            self.learn(hashes[new[i:j]], [text[a:b] for a, b in zip(begin[i:j].tolist(), stop[i:j].tolist())])
            i = j
        places = self.lookup(hashes)[inverse.ravel()]
        ids = self.flat[_ragged(places[:, 0], places[:, 1])]
        upto = np.concatenate([[0], np.cumsum(places[:, 1])])[np.searchsorted(start, offs)]
        exact = self._decodes(ids, upto, texts)
        wrong = [k for k in np.flatnonzero(~exact).tolist() if texts[k]]
        if wrong:  # of two cuts with one hash, one has the other's ids
            each = np.split(ids, upto[1:-1])
            for k in wrong:
                each[k] = self.direct(texts[k])
            ids, upto = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
            exact = self._decodes(ids, upto, texts)
        return ids, np.diff(upto), exact

    def _decodes(self, ids: np.ndarray, upto: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether each text's ids decode to it, as bytes, a stretch of ids at a time."""
        ends = np.cumsum(self.plain_sizes[ids])
        bounds = np.concatenate([[0], ends])[upto].tolist()
        plain = b"".join([self.plain_bytes[_ragged(self.plain_starts[x], self.plain_sizes[x])].tobytes() for x in (ids[i : i + INDEX] for i in range(0, len(ids), INDEX))])
        return np.array([plain[a:b] == t.encode() for a, b, t in zip(bounds[:-1], bounds[1:], texts)], bool)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, after the space that is put before a text, about PART
        characters at a time; a longer text goes in parts, cut where no piece
        can cross."""
        parts, of = [], []
        for k, text in enumerate(texts):
            text = SPACE + text.replace(" ", SPACE) if text else ""
            while len(text) > PART:
                units = np.frombuffer(text[PART - 1 :].encode("utf-32-le"), np.uint32)
                free = np.flatnonzero(~self.joined[self.rank[units[:-1]], self.rank[units[1:]]])
                if not len(free):
                    break
                at = PART + int(free[0])
                parts.append(text[:at])
                of.append(k)
                text = text[at:]
            parts.append(text)
            of.append(k)
        ids, sizes, exact = [], [], []
        i = 0
        while i < len(parts):
            j, chars = i, 0
            while j < len(parts) and (j == i or chars + len(parts[j]) <= PART):
                chars += len(parts[j])
                j += 1
            x = self.encode(parts[i:j])
            ids.append(x[0])
            sizes.append(x[1])
            exact.append(x[2])
            i = j
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        size = np.bincount(of, np.concatenate(sizes), len(texts)).astype(np.int64)
        wrong = np.bincount(of, ~np.concatenate(exact), len(texts)) + [SPACE in t for t in texts]  # a space's mark comes back as a space
        return np.concatenate(ids), size, wrong == 0

    # -------------------------------------------------------------- decoding
    def decode(self, ids) -> str:
        text = b"".join([self.plain[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _sorted(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(hashes)
    return hashes[by], places[by]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def _worker(model) -> Pieces:
    """One encoder for all tasks of a Python worker."""
    kept = sys.modules.setdefault("_kept_pieces", types.ModuleType("_kept_pieces"))
    key = (len(model), hash(tuple(model)))
    if getattr(kept, "key", None) != key:
        kept.key, kept.pieces = key, Pieces(model)
    return kept.pieces


def encode(docs: DataFrame, path: str = MODEL, col: str = "text") -> DataFrame:
    """All columns of ``docs`` (``col`` with null as empty), then ids, n_pieces
    and exact: whether decoding the ids gives the text back.  Columns of these
    names in ``docs`` are replaced."""
    model = load_model(path)
    docs = docs.drop("ids", "n_pieces", "exact")
    names = docs.columns
    docs = docs.withColumn(col, text_or_empty(col))
    at = names.index(col)

    def rows(batch):
        pieces = _worker(model)
        _, offs = arrow_bytes(batch.column(at))
        for i, j in row_steps(offs, PART):  # the ids of about PART bytes at a time
            flat, sizes, exact = pieces.encode_all(batch.column(at).slice(i, j - i).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            part = [c.slice(i, j - i) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*part, ids, pa.array(sizes.astype(np.int32)), pa.array(exact)], [*names, "ids", "n_pieces", "exact"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, rows, f"{schema}, ids array<int>, n_pieces int, exact boolean")


def decode(docs: DataFrame, path: str = MODEL, col: str = "ids") -> DataFrame:
    """doc_id and the text of the ids (null: empty)."""
    model = load_model(path)

    def rows(batch):
        pieces = _worker(model)
        texts = [pieces.decode(x or []) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return map_arrow(docs.selectExpr("doc_id", f"`{col}` AS ids"), rows, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_pieces", "exact", "ids")
