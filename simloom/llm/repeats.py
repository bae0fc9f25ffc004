"""Removal of long repeated strings by suffix sorting.

A symbol goes if it lies in a string of ``length`` symbols that also starts anywhere
else, in the same text or in another. Symbols are bytes, or whole words (BYTES, WORDS):
a word is a lower-cased (A-Z) run of digits, a-z and characters beyond ASCII, known by
CODE bytes of its hash; what lies between removed words goes with them. Sorting every
suffix of a large corpus is out of reach, so the suffixes to sort are chosen first,
without loss:

1. Equal texts are one row with a mark. A text that occurs twice is a repeat
   as a whole if it has ``length`` symbols.
2. In each window of ``length`` symbols the k-gram of least hash is its anchor.
   Equal windows have equal anchors, at the same place of the window. The
   windows of an anchor are dealt to two lanes by how far they start before it;
   all windows of a lane hold the same ``length - (length - k) / 2`` symbols around the
   anchor, whose hash is the key. Keys that occur once are dropped.
3. Anchors of a key whose surroundings are equal are one string with a count, as equal
   suffixes need no order. The different strings of a key, right and left (reversed)
   of its anchors, are suffix sorted with the lengths of common prefixes: multikey
   quicksort on 8-byte characters to a shallow depth, then blind tries for the groups
   that still agree. A window repeats if another one shares its part right of the
   anchor and its part left of it, both read off the sorted orders.
4. A key with more than HOT different strings is split before it is sorted: its lane
   is halved, so that the windows of a half share a longer string, whose hash is the new
   key. Halves are split on until they are small; at the latest when a lane is one
   window, all strings of a key are equal.

Nulls count as empty texts. Texts shorter than ``length`` lose nothing. Rows may
repeat: each is a text of its own. Results are keyed by the digest of the text,
so neither missing nor repeated ids matter; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize, release
from simloom.llm.bytescan import gram_hashes, mix, powers, slices, utf8, word_spans

LENGTH, GRAM = 400, 64
#: Words of a passage, and of the grams that anchor one: passages of over 50 words are sought.
PASSAGE, PASSAGE_GRAM = 51, 12
#: Kinds of symbols by the bytes that one takes; of a word's hash so many bytes are kept.
BYTES, CODE = 1, 4
WORDS = CODE
#: Depth in bytes to which multikey quicksort goes, and strings of a key that one task sorts.
SHALLOW, HOT = 64, 1_000
#: Rows sorted together: whole keys up to so many bytes.
GATHER_BYTES = 16 << 20


def coded(data: np.ndarray, offsets: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts as bytes, ``unit`` for each, with their offsets."""
    if unit == BYTES:
        return data, offsets
    hashed, doc, _, _ = word_spans(data, offsets)
    sizes = np.bincount(doc, minlength=len(offsets) - 1)[: len(offsets) - 1]
    return (hashed >> np.uint64(32)).astype("<u4").view(np.uint8), np.append(0, np.cumsum(sizes)) * CODE


def _one(text: bytes, unit: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return coded(data, np.array([0, len(data)]), unit)[0]


# --- suffix sorting -------------------------------------------------------------------------------------------


def multikey_quicksort(words: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refine groups of rows by their first ``depth`` 8-byte characters.

    ``order`` lists rows so that equal ``group`` stand together. All groups are
    partitioned at once: in each round the rows of a group are split into those
    less than, equal to and greater than a pivot, the median of three; the equal
    ones go on to the next character. Returns the order and, for each place in
    it, the number of the group it ended in.
    """
    n = len(order)
    at = np.zeros(n, np.int64)  # next character of each place
    done = np.zeros(n, bool)
    group = group.copy()
    while True:
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        owner = np.repeat(np.arange(len(starts)), sizes)
        done = (sizes[owner] == 1) | (at >= depth)
        if done.all():
            return order, owner
        live = np.flatnonzero(~done)
        key = words[order[live], at[live]]
        own = owner[live]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(first, len(own)))
        three = np.stack([key[first], key[first + size // 2], key[first + size - 1]])
        three.sort(axis=0)
        pivot = np.repeat(three[1], size)
        side = 1 + (key > pivot).astype(np.int8) - (key < pivot)
        rank = np.repeat(np.arange(len(first)), size) * 3 + side
        move = np.argsort(rank, kind="stable")
        order[live] = order[live[move]]
        next_at = at[live][move] + (side[move] == 1)
        at[live] = next_at
        mark = np.zeros(n, np.int64)
        mark[live] = rank[move] + 1
        group = owner * (3 * len(first) + 2) + mark


class BlindTrie:
    """Orders strings of one length that share a long prefix.

    A node holds the length at which its strings part and its children by the
    byte there; a new string goes down blindly by those bytes to some leaf, is
    compared with it once, and is put in where they part.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: object = None  # a leaf is a list of indices, a node is (depth, {byte: child})
        for k in range(len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):
            child = node[1].get(s[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        other = self.strings[node[0]]
        if other == s:
            node.append(k)
            return
        depth = common(other, s)
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][s[depth]] = [k]
            return
        split = (depth, {other[depth]: node, s[depth]: [k]})
        if parent is None:
            self.root = split
        else:
            parent[1][s[parent[0]]] = split

    def sorted(self) -> tuple[list[int], list[int]]:
        """Indices in order, and the common prefix of each with the one before it (of the first: 0)."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple[object, int]] = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, list):
                order += node
                shared += [lcp] + [len(self.strings[node[0]])] * (len(node) - 1)
                continue
            depth, children = node
            keys = sorted(children, reverse=True)
            for c in keys[:-1]:
                stack.append((children[c], depth))
            stack.append((children[keys[-1]], lcp))
        return order, shared


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    gap = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (gap.bit_length() + 7) // 8


def suffix_sort(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes within their groups, and common prefixes with the row before (0 for the first of a group).

    ``strings`` is a matrix of bytes whose width is a multiple of 8; ``group``
    ascends. Multikey quicksort to SHALLOW bytes, then a blind trie for each
    group that still agrees.
    """
    n, width = strings.shape
    words = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    shallow = min(SHALLOW, width) // 8
    order, owner = multikey_quicksort(words, np.arange(n), group, shallow)
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[:n])
    ends = np.append(starts[1:], n)
    lcp = np.zeros(n, np.int64)
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        rows = order[a:b]
        placed, shared = BlindTrie([strings[r].tobytes() for r in rows]).sorted()
        order[a:b] = rows[placed]
        lcp[a:b] = shared
    heads = starts[1:]
    heads = heads[group[order[heads]] == group[order[heads - 1]]]
    if len(heads):  # neighbours that parted in the shallow sort
        x, y = words[order[heads], :shallow], words[order[heads - 1], :shallow]
        word = (x != y).argmax(axis=1)
        gap = x[np.arange(len(heads)), word] ^ y[np.arange(len(heads)), word]
        lead = np.zeros(len(heads), np.int64)
        for k in range(1, 8):
            lead += (gap >> np.uint64(64 - 8 * k)) == 0
        lcp[heads] = word * 8 + lead
    return order, lcp


def repeated_windows(left: np.ndarray, right: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, unit: int = BYTES) -> np.ndarray:
    """Which windows repeat: a matrix [row, offset] of booleans.

    Row i has the windows that start ``low[i]`` to ``high[i]`` - 1 symbols before its
    anchor; column o stands for the start ``low.min() + o``. ``right`` has the
    bytes from the anchor on, ``left`` those before it, nearest first, padded
    with zeros where the text ends.
    """
    n = len(group)
    base, top = int(low.min()), int(high.max())
    out = np.zeros((n, top - base), bool)
    r_order, r_lcp = suffix_sort(right, group)
    l_order, l_lcp = suffix_sort(left, group)
    r_new, l_new = _heads(group, r_order), _heads(group, l_order)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(base, top):
        at = np.flatnonzero((low <= o) & (o < high))
        if not len(at):
            continue
        r_class[r_order] = np.cumsum(r_new | (r_lcp < (length - o) * unit))
        l_class[l_order] = np.cumsum(l_new | (l_lcp < o * unit))
        key = r_class[at] * np.int64(n + 1) + l_class[at]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(at), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out[at, o - base] = hit
    return out


def _heads(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    return new


# --- anchors --------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, unit: int = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of coded symbols: place, first and end window start of the windows that they anchor, in order.

    The anchor of a window is its gram of least hash, the first one on ties.
    """
    if len(data) < length * unit:
        return (np.zeros(0, np.int64),) * 3
    h = gram_hashes(data, gram * unit)[::unit]
    w = length - gram + 1  # grams of a window
    if len(h) < (1 << 24):
        packed = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        least = _sliding_min(packed, w) & np.uint64((1 << 24) - 1)
    else:  # a text of over 16 million symbols, piece by piece
        pieces = []
        step = (1 << 24) - w
        for a in range(0, len(h) - w + 1, step):
            part = h[a : a + step + w - 1]
            packed = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
            pieces.append((_sliding_min(packed, w) & np.uint64((1 << 24) - 1)) + np.uint64(a))
        least = np.concatenate(pieces)
    least = least.astype(np.int64)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[first], first, np.append(first[1:], len(least))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: block-wise running minima from either side."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def lanes(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, unit: int = BYTES) -> list[np.ndarray]:
    """Keys of the lanes of coded symbols: key, anchor, and the least and end offset of the windows before the anchor."""
    place, first, end = anchors(data, length, gram, unit)
    out = []
    for low, high in _bounds(length, gram):
        a, b = np.maximum(place - end + 1, low), np.minimum(place - first + 1, high)
        at = a < b
        # all windows of the lane hold the symbols from place - low to place - high + 1 + length
        begin, stop = place[at] - low, place[at] - high + 1 + length
        out.append((_range_hash(data, begin * unit, stop * unit) + np.uint64(low), place[at], a[at], b[at]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _bounds(length: int, gram: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """The offsets before the anchor that the two lanes take."""
    half = (length - gram) // 2 + 1
    return (0, half), (half, length - gram + 1)


def _range_hash(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of byte ranges."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[stop] - total[begin]) * down[begin])


# --- the job --------------------------------------------------------------------------------------------------


def _scan(length: int, gram: int, unit: int):
    """Lanes of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, places = utf8(batch.column(1))
            rows: list[list] = [[], [], [], [], []]
            held = 0
            for first, last in slices(places):
                data, offsets = coded(whole[places[first] : places[last]], places[first : last + 1] - places[first], unit)
                for i in np.flatnonzero(np.diff(offsets) >= length * unit).tolist():
                    got = lanes(data[offsets[i] : offsets[i + 1]], length, gram, unit)
                    for k, x in enumerate(got):
                        rows[k].append(x)
                    rows[4].append(np.full(len(got[0]), first + i))
                    held += len(got[0])
                    if held > 50_000:
                        yield _rows(rows, batch.column(0))
                        rows, held = [[], [], [], [], []], 0
            if held:
                yield _rows(rows, batch.column(0))

    return run


def _rows(rows: list, ids: pa.Array) -> pa.RecordBatch:
    key, place, low, high, row = (np.concatenate(x) for x in rows)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(row)), pa.array(place), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["key", "id", "place", "low", "high"])


_LANE = "key long, id binary, place long, low int, high int"


def _listed(array: pa.Array, row: int) -> list[np.ndarray]:
    """The fields of a row's array of structs."""
    inside = array[row].values
    return [inside.field(k).to_numpy(zero_copy_only=False) for k in range(inside.type.num_fields)]


def _members(length: int, unit: int):
    """(id, text, lanes) come in; lanes with a hash of the surroundings go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                key, place, low, high = _listed(batch.column(2), r)
                data = _one(batch.column(1)[r].as_py(), unit)
                around = _range_hash(data, (place - high + 1) * unit, (place - low + length) * unit)
                around = mix(around + low.astype(np.uint64) * np.uint64(1009) + high.astype(np.uint64)).view(np.int64)
                for a in range(0, len(key), 10_000):
                    k = slice(a, a + 10_000)
                    ids = pa.array([batch.column(0)[r].as_py()] * len(key[k]), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key[k]), ids, *(pa.array(x[k]) for x in (place, low, high, around))], names=["key", "id", "place", "low", "high", "around"])

    return run


#: A string of a key: the windows of ``id`` that start ``low`` to ``high`` - 1 symbols before ``place``, how
#: often it occurs, the bounds of the lane, and the bytes left and right of the place.
_STRING = "key long, id binary, place long, low int, high int, n long, floor int, ceiling int, left binary, right binary"
_STRING_NAMED = [x.split()[0] for x in _STRING.split(", ")]


def _strings(length: int, gram: int, unit: int):
    """(id, text, representatives) come in; these go out as strings."""
    (_, half), (_, top) = _bounds(length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ident = batch.column(0)[r].as_py()
                data = _one(batch.column(1)[r].as_py(), unit).tobytes()
                key, place, low, high, n = _listed(batch.column(2), r)
                for a in range(0, len(key), 5_000):
                    k = slice(a, a + 5_000)
                    p, lo, hi = place[k].tolist(), low[k].tolist(), high[k].tolist()
                    left = [data[(x - h + 1) * unit : x * unit] for x, h in zip(p, hi, strict=True)]
                    right = [data[x * unit : (x - w + length) * unit] for x, w in zip(p, lo, strict=True)]
                    late = low[k] >= half
                    floor, ceiling = np.where(late, half, 0).astype(np.int32), np.where(late, top, half).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array([ident] * len(p), pa.binary()), pa.array(place[k]), pa.array(low[k]), pa.array(high[k]), pa.array(n[k]), pa.array(floor), pa.array(ceiling), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=_STRING_NAMED)

    return run


def _halves(length: int, unit: int):
    """Strings come in; each goes out for either half of its lane, with the key of the half and a hash of its own surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 1_000) for a in range(0, batch.num_rows, 1_000)):
                out: list[list] = [[] for _ in range(len(_STRING_NAMED) + 1)]
                for _, ident, place, low, high, n, floor, ceiling, left, right in zip(*(part.column(c).to_pylist() for c in _STRING_NAMED), strict=True):
                    middle = (floor + ceiling) // 2
                    for f, c in ((floor, middle), (middle, ceiling)):
                        a, b = max(low, f), min(high, c)
                        if a < b:
                            bounds = struct.pack("<4i", f, c, a, b)
                            shared = left[len(left) - f * unit :] + right[: (length - c + 1) * unit]
                            own_left, own_right = left[len(left) - (b - 1) * unit :], right[: (length - a) * unit]
                            row = (_digest(bounds[:8] + shared), ident, place, a, b, n, f, c, own_left, own_right, _digest(bounds[8:] + own_left + own_right))
                            for x, v in zip(out, row, strict=True):
                                x.append(v)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[*_STRING_NAMED, "around"])

    return run


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _padded(array: pa.Array, width: int, backwards: bool) -> np.ndarray:
    data, offsets = utf8(array)
    out = np.zeros((len(offsets) - 1, width), np.uint8)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    if backwards:
        within = np.repeat(sizes, sizes) - 1 - within
    out[row, within] = data
    return out


def _sort_keys(length: int, gram: int, unit: int):
    """Strings in order of their keys come in; starts of repeated windows go out as runs (id, start, end)."""
    left_width, right_width = -(-(length - gram) * unit // 8) * 8, -(-length * unit // 8) * 8

    def solve(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        key = table["key"].to_numpy()
        group = np.cumsum(np.append(0, key[1:] != key[:-1]))
        low, high, place, n = (table[c].to_numpy().astype(np.int64) for c in ("low", "high", "place", "n"))
        left, right = _padded(table["left"], left_width, True), _padded(table["right"], right_width, False)
        hit = repeated_windows(left, right, group, low, high, length, unit)
        hit[n > 1] = False  # known to repeat as a whole
        # columns ascend with the distance before the anchor, so starts descend
        edge = np.zeros((len(key), hit.shape[1] + 2), np.int8)
        edge[:, 1:-1] = hit
        step = np.diff(edge, axis=1)
        row, begin = np.nonzero(step == 1)
        _, stop = np.nonzero(step == -1)
        if len(row):
            base = int(low.min())
            start, end = place[row] - (base + stop - 1), place[row] - (base + begin) + 1
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(pa.array(row)), pa.array(start), pa.array(end)], names=["id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                part = batch.slice(a, 2_000)
                if size > GATHER_BYTES:
                    key = part.column(0).to_numpy()
                    new = np.flatnonzero(np.append(key[0] != held[-1].column(0)[-1].as_py(), key[1:] != key[:-1]))
                    if len(new):
                        yield from solve([*held, part.slice(0, int(new[0]))])
                        held, size, part = [], 0, part.slice(int(new[0]))
                held.append(part)
                size += part.num_rows * (left_width + right_width + 40)
        if size:
            yield from solve(held)

    return run


def text_id(text: str) -> Column:
    """The key of a text: half of its SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 16)


def repeated_runs(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, unit: int = BYTES, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Runs (id, start, end) of the starts of windows that occur in another place, in symbols, and the texts (id, text binary, copied) that have some or are ``copied``.

    Of different texts only: a copied text repeats as a whole if it is long enough.
    ``id`` is ``text_id``. Grams are a quarter of ``length`` at most.
    """
    gram = min(gram, max(1, length // 4))
    texts = docs.select(text_id(text).alias("id"), F.col(text).cast("binary").alias("text")).where(F.length("text") >= (length if unit == BYTES else 2 * length - 1))
    found = materialize(texts.mapInArrow(_scan(length, gram, unit), _LANE), "lanes")
    who = F.xxhash64("id", "place")
    many = found.select("key", who.alias("who")).groupBy("key").agg(F.min("who").alias("a"), F.max("who").alias("b")).where("a <> b").select("key")
    many = materialize(many, "keys")  # as a table of its own, so that the join below can split a hot key
    listed = found.join(many, "key", "left_semi").groupBy("id").agg(F.collect_set(F.struct("key", "place", "low", "high")).alias("at"))
    unique = texts.groupBy("id").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("copied"))
    texts = materialize(unique.join(listed, "id", "left").where("copied or at is not null"), "texts")
    release(found, many)
    members = materialize(texts.where("at is not null").select("id", "text", "at").mapInArrow(_members(length, unit), _LANE + ", around long"), "members")
    one = F.min(F.struct("id", "place", "low", "high"))
    groups = materialize(members.groupBy("key", "around").agg(F.count("*").alias("n"), one.alias("one")), "groups")
    whole = _runs_of(members.join(groups.where("n > 1").select("key", "around"), ["key", "around"], "left_semi"))
    several = groups.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = groups.join(several.select("key"), "key", "left_semi").select("one.id", F.struct("key", "one.place", "one.low", "one.high", "n").alias("x"))
    mixed = mixed.groupBy("id").agg(F.collect_list("x").alias("xs"))
    strings = materialize(texts.select("id", "text").join(mixed, "id").mapInArrow(_strings(length, gram, unit), _STRING), "strings")
    runs = [materialize(whole, "whole")]
    release(members, groups)
    while True:
        kinds = strings.groupBy("key").agg(F.count("*").alias("kinds"))
        large = materialize(kinds.where(F.col("kinds") > hot).select("key"), "large-keys")
        few = strings.join(large, "key", "left_anti")
        runs.append(materialize(few.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_keys(length, gram, unit), "id binary, start long, end long"), "sorted"))
        if large.isEmpty():
            release(strings)
            break
        halves = materialize(strings.join(large, "key", "left_semi").mapInArrow(_halves(length, unit), _STRING + ", around long"), "halves")
        groups = halves.groupBy("key", "around").agg(F.sum("n").alias("total"), F.min(F.struct("id", "place", "low", "high", "floor", "ceiling", "left", "right")).alias("one"))
        groups = materialize(groups, "half-groups")
        runs.append(_runs_of(halves.where("n = 1").join(groups.where("total > 1").select("key", "around"), ["key", "around"], "left_semi")))
        several = groups.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
        last = [strings, large]
        strings = materialize(groups.join(several, "key", "left_semi").select("key", "one.*", F.col("total").alias("n")).select(*_STRING_NAMED), "strings")
        release(*last)
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out, texts.select("id", "text", "copied")


def _runs_of(rows: DataFrame) -> DataFrame:
    """The starts of all windows of lanes, as runs."""
    return rows.select("id", (F.col("place") - F.col("high") + 1).alias("start"), (F.col("place") - F.col("low") + 1).alias("end"))


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals, ascending; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    last = np.append(new[1:], True)
    return starts[new], ends[last]


def _cut(text: bytes, begin: list[int], end: list[int]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True))


def removals(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, unit: int = BYTES, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """What to remove of each different text that repeats somewhere: (id, n_removed bytes, n_spans, kept_sha256[, kept]).

    With ``keep_text``, ``kept`` is the text without the spans, as a string; there
    a character that a span's edge splits stays whole.
    """
    runs, texts = repeated_runs(docs, text, length, gram, unit, hot)
    gathered = materialize(runs.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("runs")), "runs")
    names = ["id", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]

    def spans(whole: bytes, copied: bool, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte spans to remove."""
        if unit == BYTES:
            n = len(whole)
        else:
            data = np.frombuffer(whole, np.uint8)
            _, _, begins, ends = word_spans(data, np.array([0, len(data)]))
            n = len(begins)
        if copied and n >= length:
            a, b = np.array([0]), np.array([n])
        elif len(start):
            a, b = covered(start, end - 1 + length)
        else:
            a = b = np.zeros(0, np.int64)
        return (a, b) if unit == BYTES else (begins[a], ends[b - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                whole = batch.column(1)[r].as_py()
                start, end = _listed(batch.column(3), r) if batch.column(3)[r].is_valid else (none, none)
                a, b = spans(whole, batch.column(2)[r].as_py(), start, end)
                kept = _cut(whole, a.tolist(), b.tolist())
                row = [[batch.column(0)[r].as_py()], [int((b - a).sum())], [len(a)], [hashlib.sha256(kept).hexdigest()]]
                if keep_text:
                    for k in range(len(a)):
                        while a[k] < b[k] and whole[a[k]] & 0xC0 == 0x80:
                            a[k] += 1
                        while b[k] < len(whole) and b[k] > a[k] and whole[b[k]] & 0xC0 == 0x80:
                            b[k] -= 1
                    row.append([_cut(whole, a.tolist(), b.tolist()).decode()])
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.binary()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64()), *(pa.array(x, pa.string()) for x in row[3:])], names=names)

    schema = "id binary, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    return texts.join(gathered, "id", "left").mapInArrow(run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int | None = PASSAGE) -> DataFrame:
    """One row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256 of the bytes left.

    With ``passage``, also passage_bytes and n_passages: the bytes and runs that lie in
    strings of so many words that occur elsewhere, which ``length`` bytes may miss.
    """
    found = materialize(removals(docs, text, length).withColumnRenamed("kept_sha256", "kept"), "removals")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), text_id(text).alias("id"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("sha"))
    none = F.lit(0).cast("long")
    columns = [key, "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")]
    if passage:
        words = removals(docs, text, passage, PASSAGE_GRAM, WORDS)
        words = words.select("id", F.col("n_removed").alias("inside"), F.col("n_spans").alias("passages"))
        found = materialize(found.join(words, "id", "full"), "both")  # one table for one join, which can split a hot text
        columns += [F.coalesce("inside", none).alias("passage_bytes"), F.coalesce("passages", none).alias("n_passages")]
    return rows.join(found, "id", "left").select(*columns)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, unit: int = BYTES) -> DataFrame:
    """The rows of ``docs`` with the repeated spans cut out of ``text``; a null stays null."""
    found = materialize(removals(docs, text, length, gram, unit, keep_text=True).where("n_spans > 0").select("id", "kept"), "kept-texts")
    marked = docs.select(text_id(text).alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(found, "id", "left")
    return marked.select(*((F.coalesce("kept", f"row.`{c}`") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
