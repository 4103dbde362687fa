"""Passage dedup over UTF-8 bytes by a Burrows-Wheeler transform.

A byte is removed if a string of `LENGTH` bytes that covers it also starts in a document
with a smaller doc_id. Strings are judged on the input; matches never cross documents.

The corpus doesn't fit one suffix array, so windows of LENGTH bytes are dealt to buckets
by contents: a window goes by its anchor, the least hash of its 16-byte strings, so that
equal windows meet. Consecutive windows with one anchor travel as one fragment.
 1. Texts are packed into batches, written once; they stay there.
 2. 32-bit tags of each batch's anchors go to tag buckets, which say of each whether other
    batches or documents have it. (Tags that agree by chance cost work, no error.)
 3. Bytes of fragments whose anchor recurs go to fragment buckets, each different one once
    for a batch, with its least doc_id. An anchor with more than `HOT` fragments is split
    by a second anchor of each window, taken by another hash.
 4. In a bucket, equal fragments are one text (bytes are compared). Where an anchor has one
    text only, as inside copied passages, its least doc_id decides all its windows, as it does
    where no hash of a window occurs twice. The others form one text with a Burrows-Wheeler
    transform. Breadth-first backward extension
    finds, for lengths 0, 1, 2, ..., where neighbouring suffixes stop agreeing, and ends at
    LENGTH: suffixes without a boundary between them share LENGTH bytes. Each such
    interval's least doc_id decides its windows.
 5. A bitmap of removed windows for each fragment goes back to its batch.
A passage, line or copy that a third of all documents have is sent once a batch.

Null and empty texts have no bytes. Null doc_id counts as the least id; it is given back
as null. Rows with equal doc_id never remove each other's bytes. Columns beside doc_id and
text are not used. Texts of any length work: anchors are found piece by piece. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.llm.common import saved, shuffles_end_with_steps

LENGTH, GRAM = 50, 16
BATCH, PIECE = 1 << 23, 1 << 20
#: Bytes of text for each bucket of tags, and of fragments.
TAG_BUCKET, FRAG_BUCKET = 1 << 27, 1 << 22
#: Fragments of an anchor (those of a batch count up to 127) beyond which it is split.
HOT = 8192
LEAST = -(1 << 63)
#: Ends a fragment. No UTF-8 text has this byte, and it sorts after all that it has.
STOP = 0xFF
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words8(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each position as a number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
    out = np.empty(len(data), U)
    for j in range(min(8, len(data))):
        n = (len(data) - j + 7) // 8
        out[j::8] = np.frombuffer(padded, order + "u8", n, j)
    return out


def runs_of(data: np.ndarray, ends: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of maximal runs of windows with one anchor inside documents
    that end at `ends`. Another salt chooses other anchors."""
    found = []
    start_of = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for a in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        piece = data[a : a + PIECE + LENGTH - 1]
        n = len(piece) - LENGTH + 1
        w = words8(piece, "<")
        h = mix(w[: len(piece) - GRAM + 1] * U(0x9E3779B97F4A7C15) + mix(w[8 : len(piece) - GRAM + 9] + U(0xD1B54A32D192ED03) + U(salt)))
        width, span = 1, LENGTH - GRAM + 1
        while width * 2 <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        least = np.minimum(h[:n], h[span - width : span - width + n])
        # a window starts in a document if it ends in it too
        near = ends[(ends > a) & (ends < a + n + LENGTH)] - a
        whole = np.zeros(n + 1, np.int64)
        np.add.at(whole, np.clip(near - LENGTH + 1, 0, n), 1)
        np.add.at(whole, np.clip(near, 0, n), -1)
        whole = np.cumsum(whole)[:n] == 0
        change = np.ones(n, bool)
        change[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
        inner = start_of[(start_of > a) & (start_of < a + n)] - a
        change[inner] = True
        at = np.flatnonzero(change)
        size = np.diff(np.append(at, n))
        ok = whole[at]
        found.append((at[ok] + a, size[ok], mix(least[at[ok]])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*found))


def packed(docs: DataFrame) -> DataFrame:
    """batch, n_bytes, payload (zstd of all texts), ids, nulls, lens (binary arrays): about BATCH
    bytes a row."""

    def run(batches):
        press, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()

        def row():
            arrays = [np.array(ids, np.int64), np.array(nulls, bool), np.array([*map(len, texts)], np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([size], pa.int64()), pa.array([press.compress(b"".join(texts))], pa.binary()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], ["batch", "n_bytes", "payload", "ids", "nulls", "lens"])

        texts, ids, nulls, size, number = [], [], [], 0, 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                texts.append((t or "").encode())
                ids.append(LEAST if i is None else i)
                nulls.append(i is None)
                size += len(texts[-1])
                if size >= BATCH or len(texts) >= 65_536:
                    yield row()
                    texts, ids, nulls, size, number = [], [], [], 0, number + 1
        if texts:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "batch long, n_bytes long, payload binary, ids binary, nulls binary, lens binary")


#: What a tag bucket says of a tag: nobody else has it; its fragments are compared; they are split
#: by a second anchor before that.
ALONE, ASK, SPLIT = 0, 1, 2


class Batch:
    """A packed batch: its bytes, documents, runs, and the runs' tags, which stand in the order of
    their buckets."""

    def __init__(self, payload: bytes, ids: bytes, lens: bytes, buckets: int):
        self.raw = zstandard.ZstdDecompressor().decompress(payload) if payload else b""
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.ends = np.cumsum(self.lens)
        self.start, self.n_windows, anchor = runs_of(np.frombuffer(self.raw, np.uint8), self.ends)
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        tag = (anchor & U(0xFFFFFFFF)) | ((anchor >> U(32)) % U(buckets) << U(32))  # buckets < 2**31
        self.tags, self.tag_of, self.times = np.unique(tag, return_inverse=True, return_counts=True)

    def in_buckets(self):
        """(bucket, first, last) of the buckets that the tags fall into."""
        bucket, first = np.unique(self.tags >> U(32), return_index=True)
        return zip(bucket.tolist(), first.tolist(), np.append(first[1:], len(self.tags)).tolist())

    def several(self) -> np.ndarray:
        """Tags that several documents of this batch have."""
        low, high = np.full(len(self.tags), len(self.ids)), np.full(len(self.tags), -1)
        np.minimum.at(low, self.tag_of, self.doc)
        np.maximum.at(high, self.tag_of, self.doc)
        return low < high

    def codes(self, replies) -> np.ndarray:
        code = np.zeros(len(self.tags), np.uint8)
        for r in replies or ():
            lo, hi = np.searchsorted(self.tags, np.array([r["bucket"], r["bucket"] + 1], U) << U(32)).tolist()
            two = np.unpackbits(np.frombuffer(r["bits"], np.uint8).reshape(2, -1), axis=1, count=hi - lo)
            code[lo:hi] = two[0] * 2 + two[1]
        return code

    def fragments(self, replies, frag_buckets: int) -> None:
        """Sets what is sent. Asked runs with equal bytes are one unit, whose least id is `least`; a
        unit is sent as one piece, or split as several. Pieces stand in the order of their buckets
        (`place`): unit, where it starts in the unit, windows, key (of the anchor), text."""
        code = self.codes(replies)
        self.asked = np.flatnonzero(code[self.tag_of] != ALONE)
        number: dict[bytes, int] = {}
        start, stop = self.start[self.asked], self.start[self.asked] + self.n_windows[self.asked] + LENGTH - 1
        self.unit = np.fromiter((number.setdefault(self.raw[s:e], len(number)) for s, e in zip(start.tolist(), stop.tolist())), np.int64, len(start))
        self.least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.unit, self.ids[self.doc[self.asked]])
        texts, tag = [*number], np.zeros(len(number), np.int64)
        tag[self.unit] = self.tag_of[self.asked]  # equal bytes have one anchor
        self.size = np.array([len(t) - LENGTH + 1 for t in texts], np.int64)
        whole, split = np.flatnonzero(code[tag] == ASK), np.flatnonzero(code[tag] == SPLIT)
        parts = [(whole, np.zeros(len(whole), np.int64), self.size[whole], self.tags[tag[whole]])]
        if len(split):
            ends = np.cumsum(self.size[split] + LENGTH - 1)
            s, n, anchor = runs_of(np.frombuffer(b"".join(texts[u] for u in split), np.uint8), ends, salt=1)
            owner = np.searchsorted(ends, s, side="right")
            parts.append((split[owner], s - (ends[owner] - self.size[split[owner]] - LENGTH + 1), n, anchor))
        unit, begin, windows, key = [np.concatenate(x) for x in zip(*parts)]
        place = (mix(key) % U(frag_buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        self.place, self.piece_unit, self.piece_begin, self.piece_windows = place[order], unit[order], begin[order], windows[order]
        self.piece_key = (key[order] & U(0xFFFFFFFF)).astype("<u4")
        self.texts = texts

    def piece_texts(self, lo: int, hi: int) -> list[bytes]:
        return [self.texts[u][b : b + n + LENGTH - 1] for u, b, n in zip(self.piece_unit[lo:hi].tolist(), self.piece_begin[lo:hi].tolist(), self.piece_windows[lo:hi].tolist())]

    def removed(self, masks) -> tuple[np.ndarray, np.ndarray]:
        """(document, start) of the windows that go. masks hold a bit for each window sent."""
        flat = np.concatenate([*[np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]) for m in masks or ()], np.zeros(0, np.uint8)]).astype(bool)
        at = np.cumsum(self.size) - self.size  # where a unit's windows begin
        windows, total = self.piece_windows, int(self.size.sum())
        gone = np.zeros(total, bool)
        gone[np.repeat(at[self.piece_unit] + self.piece_begin, windows) + np.arange(len(flat)) - np.repeat(np.cumsum(windows) - windows, windows)] = flat
        n = self.n_windows[self.asked]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        later = self.ids[self.doc[self.asked]] > self.least[self.unit]  # a smaller document of this batch has it
        hit = gone[np.repeat(at[self.unit], n) + offset] | np.repeat(later, n)
        return np.repeat(self.doc[self.asked], n)[hit], (np.repeat(self.start[self.asked], n) + offset)[hit]


def _batches(b: pa.RecordBatch, buckets: int):
    for i, (payload, ids, lens) in enumerate(zip(*[b.column(c).to_pylist() for c in ("payload", "ids", "lens")])):
        yield i, Batch(payload, ids, lens, buckets)


def verdicts(packs: DataFrame, buckets: int) -> DataFrame:
    """batch, bits: for each tag bucket, two bits for each tag of the batch."""

    def send(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            names = b.column("batch").to_pylist()
            for i, x in _batches(b, buckets):
                mark = (np.minimum(x.times, 127) << 1 | x.several()).astype(np.uint8)
                parts = [*x.in_buckets()]
                tags = [x.tags[lo:hi].astype("<u4").tobytes() for _, lo, hi in parts]
                marks = [press.compress(mark[lo:hi].tobytes()) for _, lo, hi in parts]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int32()), pa.array([names[i]] * len(parts), pa.int64()), pa.array(tags, pa.binary()), pa.array(marks, pa.binary())], ["bucket", "batch", "tags", "marks"])

    def meet(key, table):
        open_ = zstandard.ZstdDecompressor().decompress
        tags = [np.frombuffer(t, "<u4") for t in table["tags"].to_pylist()]
        mark = np.concatenate([np.frombuffer(open_(m), np.uint8) for m in table["marks"].to_pylist()])
        _, group, n = np.unique(np.concatenate(tags), return_inverse=True, return_counts=True)
        shared = (n > 1) | (np.bincount(group, mark & 1) > 0)
        hot = np.bincount(group, mark >> 1) > HOT
        code = np.where(shared, np.where(hot, SPLIT, ASK), ALONE).astype(np.uint8)[group]
        bits = [np.packbits(np.stack([c >> 1, c & 1]), axis=1).tobytes() for c in np.split(code, np.cumsum([*map(len, tags)])[:-1])]
        return pa.Table.from_pydict({"batch": table["batch"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    sent = packs.select("batch", "payload", "ids", "lens").mapInArrow(send, "bucket int, batch long, tags binary, marks binary")
    back = sent.groupBy("bucket").applyInArrow(meet, "batch long, bucket int, bits binary")
    return back.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("bits"))


def fragments(asked: DataFrame, buckets: int, frag_buckets: int) -> DataFrame:
    """bucket, batch, payload, lens, keys, ids: the pieces of a batch for each fragment bucket."""
    schema = "bucket int, batch long, payload binary, lens binary, keys binary, ids binary"

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            names, bits = b.column("batch").to_pylist(), b.column("bits").to_pylist()
            for i, x in _batches(b, buckets):
                x.fragments(bits[i], frag_buckets)
                place, first = np.unique(x.place, return_index=True)
                cuts = [*zip(first.tolist(), np.append(first[1:], len(x.place)).tolist())]
                for a in range(0, len(cuts), 1024):
                    texts = [x.piece_texts(lo, hi) for lo, hi in cuts[a : a + 1024]]
                    lens = [np.array([*map(len, t)], np.int32).tobytes() for t in texts]
                    ids = [x.least[x.piece_unit[lo:hi]].tobytes() for lo, hi in cuts[a : a + 1024]]
                    keys = [x.piece_key[lo:hi].tobytes() for lo, hi in cuts[a : a + 1024]]
                    columns = [pa.array(place[a : a + 1024], pa.int32()), pa.array([names[i]] * len(texts), pa.int64()), *[pa.array(c, pa.binary()) for c in ([press.compress(b"".join(t)) for t in texts], lens, keys, ids)]]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return asked.select("batch", "payload", "ids", "lens", "bits").mapInArrow(run, schema)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions by the `depth` bytes from them on: ranks of 8 bytes, then of two or three times as
    many, as long as three ranks fit a word."""
    key, width = words8(data, ">"), 8
    bits = len(data).bit_length()
    times = 3 if 3 * bits <= 64 else 2
    while True:
        order = np.argsort(key)  # equal prefixes may stand in any order
        if width >= depth:
            return order
        k = key[order]
        step = np.ones(len(data), bool)
        step[1:] = k[1:] != k[:-1]
        rank = np.empty(len(data), U)
        rank[order] = np.cumsum(step).astype(U)  # from 1: 0 stands for what lies beyond the end
        key = rank.copy()
        for j in range(1, times):
            key <<= U(bits)
            key[: max(0, len(data) - j * width)] |= rank[j * width :]
        width *= times


def intervals(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, first): first marks where an interval of suffixes that share `length`
    bytes begins. Suffixes that meet STOP before that mean nothing.

    Breadth-first backward extension on the transform. Rows r-1 and r with the same first
    byte come from rows a and b by one step back (the LF mapping's inverse), and share one
    byte more than all rows from a to b do. So the boundaries of length l+1 are those whose
    way back crosses a boundary of length l: values come by increasing length, each set
    once, and the search ends at `length`. Rows that share a STOP aren't extended beyond it:
    no other row stands between them."""
    order = suffix_order(data, length)
    n = len(order)
    bwt = data[order - 1]  # cyclic: the last byte is STOP
    back = np.argsort(bwt, kind="stable")  # row -> the row of its suffix without its first byte
    head = bwt[back]
    stops = np.flatnonzero(data == STOP)
    ahead = (np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(n))[order].astype(np.int32)  # bytes before STOP
    first = np.ones(n, bool)
    first[1:] = head[1:] != head[:-1]
    open_rows = np.flatnonzero(~first & (head != STOP))
    a, b, ahead = back[open_rows - 1], back[open_rows], ahead[open_rows]
    for l in range(1, length):
        seen = np.cumsum(first, dtype=np.int32)
        cross = seen[b] != seen[a]
        first[open_rows[cross]] = True
        stay = ~cross & (ahead > l)
        open_rows, a, b, ahead = open_rows[stay], a[stay], b[stay], ahead[stay]
        if not len(open_rows):
            break
    return order, first


def window_minima(texts: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each window of each text, the least number among the texts that have it."""
    data = np.frombuffer(bytes([STOP]).join(texts) + bytes([STOP]), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(lens + 1) - lens - 1
    owner = np.repeat(np.arange(len(texts)), lens + 1)
    order, first = intervals(data, LENGTH)
    low = np.minimum.reduceat(least[owner[order]], np.flatnonzero(first))
    at = np.empty(len(data), np.int64)
    at[order] = low[np.cumsum(first) - 1]
    return [at[s : s + n - LENGTH + 1] for s, n in zip(start.tolist(), lens.tolist())]


def may_share(texts: list[bytes]) -> np.ndarray:
    """Whether a window of each text has its hash a second time, in it or in another: the others
    share no window."""
    data = np.frombuffer(bytes([STOP]).join(texts) + bytes([STOP]), np.uint8)
    h = words8(data, "<")
    for step in (8, 16, 18):  # of 8, 16, 32, and at last LENGTH = 32 + 18 bytes
        h = mix(h[:-step] * U(0x9E3779B97F4A7C15) + h[step:])
    windows = np.array([len(t) for t in texts], np.int64) - LENGTH + 1
    at = np.cumsum(windows) - windows  # in data, texts begin LENGTH further apart
    h = h[np.arange(int(windows.sum())) + np.repeat(np.arange(len(texts)) * LENGTH, windows)]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    return np.logical_or.reduceat(twice, at)


def meet_in_bucket(key, table):
    """batch, bucket, n, mask of the pieces that meet in a bucket."""
    open_ = zstandard.ZstdDecompressor().decompress
    lens, keys, ids = [[np.frombuffer(x, kind) for x in table[c].to_pylist()] for c, kind in (("lens", np.int32), ("keys", "<u4"), ("ids", np.int64))]
    row = np.cumsum([0, *map(len, lens)])  # where the pieces of each row begin
    size, keys, ids = np.concatenate(lens).astype(np.int64), np.concatenate(keys), np.concatenate(ids)
    data, ends = b"".join(map(open_, table["payload"].to_pylist())), np.cumsum(size)
    number: dict[bytes, int] = {}
    no = np.fromiter((number.setdefault(data[s:e], len(number)) for s, e in zip((ends - size).tolist(), ends.tolist())), np.int64, len(size))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, no, ids)
    anchor = np.empty(len(number), keys.dtype)
    anchor[no] = keys  # equal bytes have one anchor
    _, group, times = np.unique(anchor, return_inverse=True, return_counts=True)
    mixed, texts = np.flatnonzero(times[group] > 1), [*number]
    if len(mixed):
        mixed = mixed[may_share([texts[t] for t in mixed.tolist()])]
    windows = size - LENGTH + 1
    gone = np.repeat(least[no] < ids, windows)  # one answer for all windows of a text
    if len(mixed):
        low = window_minima([texts[t] for t in mixed.tolist()], least[mixed])
        begin = np.full(len(number), -1)
        begin[mixed] = np.cumsum([0, *map(len, low[:-1])])
        piece = np.flatnonzero(begin[no] >= 0)
        n = windows[piece]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        gone[np.repeat((np.cumsum(windows) - windows)[piece], n) + offset] = np.concatenate(low)[np.repeat(begin[no[piece]], n) + offset] < np.repeat(ids[piece], n)
    cut = np.append(0, np.cumsum(windows))[row]
    masks = [np.packbits(gone[lo:hi]).tobytes() for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return pa.Table.from_pydict({"batch": table["batch"], "bucket": table["bucket"], "n": pa.array(np.diff(cut), pa.int64()), "mask": pa.array(masks, pa.binary())})


def removed_windows(frags: DataFrame) -> DataFrame:
    """batch, masks: for each fragment bucket, bitmaps of the windows that a smaller document has."""
    back = frags.groupBy("bucket").applyInArrow(meet_in_bucket, "batch long, bucket int, n long, mask binary")
    return back.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "mask"))).alias("masks"))


def covered_bytes(n: int, starts: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + LENGTH, n), -1)
    return np.cumsum(step)[:n] > 0


def dedup_passages(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary: the
    remaining bytes, or null if nothing was removed)."""
    packs = saved(packed(docs), "passage-packs", codec="uncompressed")
    total = packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets, frag_buckets = int(max(64, total // TAG_BUCKET)), int(max(64, total // FRAG_BUCKET))
    with shuffles_end_with_steps(docs.sparkSession):
        bits = saved(verdicts(packs, buckets), "passage-verdicts")
        frags = fragments(packs.join(bits, "batch"), buckets, frag_buckets)
        masks = saved(removed_windows(frags), "passage-masks")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
    types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text

    def run(batches):
        for b in batches:
            bits, masks, nulls = [b.column(c).to_pylist() for c in ("bits", "masks", "nulls")]
            for i, x in _batches(b, buckets):
                x.fragments(bits[i], frag_buckets)
                doc, start = x.removed(masks[i])
                cuts = np.searchsorted(doc, np.arange(len(x.ids) + 1)).tolist()  # runs stand in the order of documents
                null, rows = np.frombuffer(nulls[i], bool), []
                for d, (end, n) in enumerate(zip(x.ends.tolist(), x.lens.tolist())):
                    text, first, last = x.raw[end - n : end], cuts[d], cuts[d + 1]
                    removed = spans = 0
                    kept = text
                    if first < last:
                        cover = covered_bytes(n, start[first:last] - (end - n))
                        removed, spans = int(cover.sum()), int((cover[1:] & ~cover[:-1]).sum() + cover[0])
                        kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
                    rows.append((None if null[d] else int(x.ids[d]), n, removed, spans, hashlib.sha256(kept).hexdigest(), kept if removed else None))
                for a in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4096]), types)], names)

    whole = packs.join(bits, "batch", "left").join(masks, "batch", "left")
    return whole.select("payload", "ids", "nulls", "lens", "bits", "masks").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
