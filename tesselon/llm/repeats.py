"""Removal of repeated byte strings by suffix sorting, over documents of any number and length.

A byte goes if a string of ``window`` bytes that covers it also starts in a document with a smaller id. Sorting all
suffixes of a corpus in one place is out of question, and most of them have no equal, so the work is cut by content:

1. Documents are packed into blocks of about ``BLOCK_BYTES`` (one Parquet row each, so that later passes meet the same blocks).
2. Every window has an anchor, the smallest hash of its substrings of ``GRAM`` bytes. Windows that are equal have equal
   anchors. Anchors, each once a block, are counted in buckets; the answer to a block is a bit for each of its anchors: only
   windows whose anchor occurs elsewhere go on.
3. Neighbouring windows with one anchor form a string. Each block sends each distinct string once, with the smallest
   id that holds it, to the bucket of its anchor. Windows of very frequent anchors go one by one to the bucket of their own hash
   instead, so no passage and no context of one makes a large bucket.
4. A bucket sorts the suffixes of its strings by deep-shallow sorting (``suffixes``). Suffixes that share ``window`` bytes stand
   side by side; the smallest id among them tells which of them are repeats. Bytes are compared, so hashes decide nothing.
5. The repeated windows return to their blocks, which cut the covered bytes out.

Buckets grow in number, not in size; a block's share of a bucket does not depend on how often a string occurs in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm.suffixes import deep_shallow_sort
from tesselon.session import shared_dir

GRAM = 24
BLOCK_BYTES = 4 << 20
#: Text of the corpus for each bucket: anchors are 5 % of it, strings more.
ANCHOR_BUCKET_BYTES, STRING_BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 4 << 20, 64
#: Text of the corpus for each bucket of the table of blocks.
TABLE_BUCKET_BYTES = 16 << 20
#: Windows in a string at most; documents from which on an anchor is very frequent.
STRING_WINDOWS, FREQUENT = 128, 2000
_LAST = np.iinfo(np.int64).max
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[3]
    return h ^ (h >> np.uint64(29))


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on that has so many."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size < 8:
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = h * np.uint64(257) + data[i : i + n]
        return _mix(h)
    w = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    h = np.full(n, size, np.uint64)
    for i, off in enumerate([*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]):
        h ^= w[off : off + n] * _C[i % 3]
        h *= _C[(i + 1) % 3]
        h ^= h >> np.uint64(31)
    return _mix(h)


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The smallest of ``size`` values from each place on."""
    m, have = h.copy(), 1
    while have < size:
        step = min(have, size - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """A block's bytes and documents; pieces of at most ``BLOCK_BYTES`` windows, so a long document is several."""

    def __init__(self, row: dict, window: int):
        self.id, self.window = row["block"], window
        self.data = np.frombuffer(row["data"], np.uint8)
        self.ids, self.lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each piece: first window, number of windows, anchor and document of each run of windows with one anchor."""
        n, size = len(self.data) - self.window + 1, self.window
        gram = min(GRAM, size)
        for lo in range(0, max(n, 0), BLOCK_BYTES):
            hi = min(n, lo + BLOCK_BYTES)
            m = _least(_hashes(self.data[lo : hi + size - 1], gram), size - gram + 1)
            # the last size - 1 places of a document start no window
            edge = np.zeros(hi - lo + 1, np.int32)
            ends = self.starts + self.lens
            for places, sign in ((np.maximum(self.starts, ends - size + 1), 1), (ends, -1)):
                np.add.at(edge, np.clip(places - lo, 0, hi - lo), sign)
            inside = np.cumsum(edge[:-1]) == 0
            cut = np.flatnonzero((m[1:] != m[:-1]) | (inside[1:] != inside[:-1])) + 1
            first, last = np.r_[0, cut], np.r_[cut, hi - lo]
            keep = inside[first]
            first, lens = first[keep], (last - first)[keep]
            parts = -(-lens // STRING_WINDOWS)
            nth = _ranges(np.zeros(len(parts), np.int64), parts)
            begin = np.repeat(first, parts) + nth * STRING_WINDOWS
            length = np.minimum(STRING_WINDOWS, np.repeat(first + lens, parts) - begin)
            doc = np.searchsorted(self.starts, begin + lo, side="right") - 1
            yield begin + lo, length, _mix(m[begin]), doc


def _anchors(anchor: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors by bucket, in how many documents each is, and where each bucket begins."""
    by = np.lexsort((doc, anchor))
    a, d = anchor[by], doc[by]
    new = np.r_[True, a[1:] != a[:-1]][: len(a)]
    pair = new | np.r_[True, d[1:] != d[:-1]][: len(a)]
    u, n = a[new], np.add.reduceat(pair.astype(np.int64), np.flatnonzero(new)) if len(a) else np.zeros(0, np.int64)
    # the upper half of the hash rises within u, so buckets are runs of it
    of = ((u >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return u, n, np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one: a batch may hold many blocks."""
    for i in range(b.num_rows):
        yield {name: b.column(name)[i].as_py() for name in b.schema.names}


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: ``values`` cut at the places ``at``."""
    offsets = (at * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _deltas(values: np.ndarray) -> bytes:
    """Differences of whole numbers, compressed; their size stands in front."""
    raw = np.diff(values.astype(np.int64), prepend=0).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _undelta(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_expand(blob), np.int64))


def _compress(data: np.ndarray) -> bytes:
    return data.nbytes.to_bytes(4, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def _expand(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:4], "little")
    return pa.decompress(blob[4:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def pack(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Blocks of documents, in order of id within a block, as a table in the shared folder.

    The table is bucketed by block, so a join on it moves the answers to the blocks and not the texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, count = TaskContext.get().partitionId(), [], 0, 0

        def block():
            held.sort(key=lambda x: _LAST if x[0] is None else x[0])
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(part << 32) + count], pa.int64()),
                "ids": [np.array([_LAST if i is None else i for i, _ in held], np.int64).tobytes()],
                "nulls": [np.array([i is None for i, _ in held]).tobytes()],
                "lens": [np.array([len(t) for _, t in held], np.int64).tobytes()], "data": [b"".join(t for _, t in held)],
            })

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py()
                held.append((i, t))
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size, count = [], 0, count + 1
        if held:
            yield block()

    schema = "block long, ids binary, nulls binary, lens binary, data binary"
    name = f"tesselon_blocks_{uuid.uuid4().hex[:12]}"
    # rows of some megabytes: small row groups, looked at from the first row on
    small = {"compression": "zstd", "parquet.block.size": str(8 * BLOCK_BYTES), "parquet.page.size.row.check.min": "1"}
    written = rows.mapInArrow(run, schema).write.options(**small, path=f"{shared_dir(spark)}/{name}")
    written.bucketBy(buckets, "block").saveAsTable(name, format="parquet")
    return spark.table(name)


def forget_blocks(spark: SparkSession) -> int:
    """Drop this application's tables of blocks from the catalog, once results are saved; how many there were.

    Their files lie in the shared folder, which ``session.sweep`` deletes. A catalog in memory forgets them by itself.
    """
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("tesselon_blocks_")]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return len(names)


def _answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks beside the array of what ``answers`` holds for each, null if nothing; the blocks stay where they are."""
    fields = [c for c in answers.columns if c != "block"]
    grouped = answers.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("answers"))
    return blocks.join(grouped.hint("merge"), "block", "left")


def _shared_anchors(blocks: DataFrame, window: int, buckets: int) -> DataFrame:
    """(block, piece, bucket, shared, frequent): bits for the anchors of each block's share of a bucket, in its order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                block = Block(row, window)
                for piece, (_, _, anchor, doc) in enumerate(block.runs()):
                    u, n, at = _anchors(anchor, doc, buckets)
                    some = np.flatnonzero(np.diff(at))
                    if len(some):
                        at = np.r_[at[some], len(u)]
                        yield pa.RecordBatch.from_pydict({
                            "bucket": some.astype(np.int32), "block": np.full(len(some), block.id), "piece": np.full(len(some), piece, np.int32),
                            "low": _blobs(u.astype(np.uint32), at), "docs": _blobs(np.minimum(n, 65535).astype(np.uint16), at),
                        })

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        low = np.frombuffer(b"".join(rows["low"]), np.uint32)
        docs = np.frombuffer(b"".join(rows["docs"]), np.uint16)
        _, inverse = np.unique(low, return_inverse=True)
        total = np.bincount(inverse, weights=docs)[inverse]
        at = np.cumsum([0, *(len(x) // 4 for x in rows["low"])])
        bits = lambda flags: [np.packbits(flags[a:b]).tobytes() if flags[a:b].any() else b"" for a, b in zip(at, at[1:], strict=False)]
        return rows[["block", "piece", "bucket"]].assign(shared=bits(total >= 2), frequent=bits(total > FREQUENT))

    asked = blocks.select("block", "ids", "lens", "data").mapInArrow(ask, "bucket int, block long, piece int, low binary, docs binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "block long, piece int, bucket int, shared binary, frequent binary")
    return answers.filter(F.octet_length("shared") > 0)


def _repeated_windows(answered: DataFrame, window: int, anchor_buckets: int, buckets: int) -> DataFrame:
    """(block, starts, lens): ranges of first bytes of repeated windows, as places in the block, packed by ``_deltas``."""

    def strings(block: Block, piece: int, run: tuple, answers: list[dict]) -> pa.RecordBatch | None:
        begin, length, anchor, doc = run
        u, _, at = _anchors(anchor, doc, anchor_buckets)
        flags = np.zeros((2, len(u)), bool)
        for a in answers:
            if a["piece"] == piece:
                lo, hi = at[a["bucket"]], at[a["bucket"] + 1]
                for f, bits in zip(flags, (a["shared"], a["frequent"]), strict=True):
                    if bits:
                        f[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
        place = np.searchsorted(u, anchor)
        shared, frequent = flags[0][place], flags[1][place]
        if not shared.any():
            return None
        data, extra = block.data, window - 1
        # strings of anchors that are not frequent: distinct ones by their bytes
        rare = np.flatnonzero(shared & ~frequent)
        raw, found = data.tobytes() if len(rare) else b"", {}
        own = [found.setdefault(raw[s : s + n + extra], len(found)) for s, n in zip(begin[rare].tolist(), length[rare].tolist(), strict=True)]
        string = np.array(own, np.int64)
        first = rare[np.flatnonzero(np.r_[True, string[1:] > np.maximum.accumulate(string)[:-1]][: len(string)])] if len(rare) else rare
        o_start, o_len, o_string, o_doc = begin[rare], length[rare], string, doc[rare]
        s_start, s_len, s_doc, s_hash = begin[first], length[first], doc[first], _mix(anchor[first] + _C[0])
        # windows of frequent anchors, one by one; a hash finds the candidates for equality, bytes decide
        often = np.flatnonzero(shared & frequent)
        if len(often):
            at_w, of_w = _ranges(begin[often], length[often]), np.repeat(doc[often], length[often])
            lo = int(at_w[0])
            h = _hashes(data[lo : int(at_w[-1]) + window], window)[at_w - lo]
            _, one, back = np.unique(h, return_index=True, return_inverse=True)
            same = np.ones(len(at_w), bool)
            for off in range(window):
                same &= data[at_w + off] == data[at_w[one][back] + off]
            back[~same] = len(one) + np.arange((~same).sum())
            one = np.r_[one, np.flatnonzero(~same)]
            o_start, o_len, o_doc = np.r_[o_start, at_w], np.r_[o_len, np.ones(len(at_w), np.int64)], np.r_[o_doc, of_w]
            o_string = np.r_[o_string, back + len(s_start)]
            s_start, s_len, s_doc, s_hash = np.r_[s_start, at_w[one]], np.r_[s_len, np.ones(len(one), np.int64)], np.r_[s_doc, of_w[one]], np.r_[s_hash, h[one]]
        # an occurrence in a document with a larger id than the block's first one is a repeat whatever others hold
        later = block.ids[o_doc] > block.ids[s_doc[o_string]]
        sure = np.zeros(len(data) + 1, np.int8)
        np.add.at(sure, o_start[later], 1)
        np.add.at(sure, (o_start + o_len)[later], -1)
        turns = np.flatnonzero(sure)
        o_start, o_string = o_start[~later], o_string[~later]
        # strings in order of bucket, occurrences beside their strings
        bucket = ((s_hash >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        some, at_s = np.unique(bucket[by], return_index=True)
        at_s = np.r_[at_s, len(by)]
        to = rank[o_string]
        o_by = np.argsort(to, kind="stable")
        places, counts = o_start[o_by], np.bincount(to, minlength=len(by))
        at_o = np.r_[0, np.cumsum(counts)][at_s]
        lens = s_len[by] + extra
        at_b = np.r_[0, np.cumsum(lens)][at_s]
        raw, ids = data[_ranges(s_start[by], lens)], block.ids[s_doc[by]]
        cut = lambda values, at, how: [how(values[a:b]) for a, b in zip(at, at[1:], strict=False)]
        ups, downs = turns[sure[turns] > 0], turns[sure[turns] < 0]
        # the last row is what is sure already: ranges, no strings
        return pa.RecordBatch.from_pydict({
            "bucket": np.r_[some, block.id % buckets].astype(np.int32), "block": np.full(len(some) + 1, block.id),
            "data": [*cut(raw, at_b, _compress), None], "lens": [*cut(lens, at_s, _deltas), None], "ids": [*cut(ids, at_s, _deltas), None],
            "places": [*cut(places, at_o, _deltas), _deltas(ups)], "counts": [*cut(counts, at_s, _deltas), _deltas(downs - ups)],
        })

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                if row["answers"]:
                    block = Block(row, window)
                    for piece, run in enumerate(block.runs()):
                        out = strings(block, piece, run, row["answers"])
                        if out is not None:
                            yield out

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        asks, sure = rows[rows["data"].notna()], rows[rows["data"].isna()]
        out = list(zip(sure["block"], sure["places"], sure["counts"], strict=True))
        if not len(asks):
            return pd.DataFrame(out, columns=["block", "starts", "lens"])
        each = [_undelta(x) for x in asks["lens"]]
        lens, ids = np.concatenate(each), np.concatenate([_undelta(x) for x in asks["ids"]])
        # equal strings of several blocks are sorted once, for the smallest id
        raw, found = b"".join(map(_expand, asks["data"])), {}
        ends = np.cumsum(lens)
        own = np.array([found.setdefault(raw[e - n : e], len(found)) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)], np.int64)
        least = np.full(len(found), _LAST)
        np.minimum.at(least, own, ids)
        data, u_lens = np.frombuffer(b"".join(found), np.uint8), np.fromiter(map(len, found), np.int64, len(found))
        windows = u_lens - window + 1
        suffixes = _ranges(np.cumsum(u_lens) - u_lens, windows)
        of = np.repeat(least, windows)
        order, new = deep_shallow_sort(data, suffixes, window)
        smallest = np.empty(len(of), np.int64)
        smallest[order] = np.minimum.reduceat(of[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        # ranges of repeated windows within each string that was asked for
        n = lens - window + 1
        flat = smallest[_ranges((np.cumsum(windows) - windows)[own], n)] < np.repeat(ids, n)
        begins = np.cumsum(n) - n
        edge = np.r_[False, flat, False]
        up, down = edge[1:] & ~edge[:-1], edge[:-1] & ~edge[1:]
        # a range ends where its string ends
        starts_of = begins[1:]
        up[starts_of], down[starts_of] = edge[1:][starts_of], edge[:-1][starts_of]
        lo, hi = np.flatnonzero(up), np.flatnonzero(down)
        string = np.searchsorted(begins, lo, side="right") - 1
        lo, hi = lo - begins[string], hi - begins[string]
        first = np.searchsorted(string, np.arange(len(lens) + 1))
        base = 0
        for block, places, counts, m in zip(asks["block"], asks["places"], asks["counts"], each, strict=True):
            which = np.repeat(np.arange(base, base + len(m)), _undelta(counts))
            base += len(m)
            times = first[which + 1] - first[which]
            pick, place = _ranges(first[which], times), np.repeat(_undelta(places), times)
            if len(pick):
                start = place + lo[pick]
                by = np.argsort(start)
                out.append((block, _deltas(start[by]), _deltas((hi - lo)[pick][by])))
        return pd.DataFrame(out, columns=["block", "starts", "lens"])

    shape = "bucket int, block long, data binary, lens binary, ids binary, places binary, counts binary"
    sent = answered.select("block", "ids", "lens", "data", "answers").mapInArrow(send, shape)
    found = sent.groupBy("bucket").applyInPandas(sort, "block long, starts binary, lens binary")
    return found.filter(F.octet_length("starts") > 4)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): for every row of ``docs`` the maximal removed runs of bytes and what is left.

    A byte of the UTF-8 text is removed if a string of ``window`` bytes that covers it also starts in a document with a
    smaller doc_id; strings are those of the input, overlaps count, none reaches over the end of a document. spans holds
    structs (start, end), end excluded; kept (binary) is the rest, which may end within a character.

    Edge cases: a null text counts as empty; texts shorter than ``window`` stay whole; rows with one doc_id do not take
    from each other; null ids come after all others (as the largest long does) and do not take from each other; an
    empty table gives no rows; a document of any length is handled in pieces of ``BLOCK_BYTES`` windows; other columns
    are not read.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    few, many, tables = (max(LEAST_BUCKETS, total // n) for n in (ANCHOR_BUCKET_BYTES, STRING_BUCKET_BYTES, TABLE_BUCKET_BYTES))
    blocks = pack(docs, id_col, text_col, tables)
    anchors = _shared_anchors(blocks, window, few)
    windows = _repeated_windows(_answered(blocks, anchors), window, few, many)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                block = Block(row, window)
                n, starts, ends = len(block.data), block.starts, block.starts + block.lens
                edge = np.zeros(n + 1, np.int32)
                for a in row["answers"] or []:
                    at = _undelta(a["starts"])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + _undelta(a["lens"]) + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                new, last = gone.copy(), gone.copy()
                new[1:] &= ~gone[:-1]
                last[:-1] &= ~gone[1:]
                full = block.lens > 0
                new[starts[full]], last[ends[full] - 1] = gone[starts[full]], gone[ends[full] - 1]
                lo, hi = np.flatnonzero(new), np.flatnonzero(last) + 1
                of = np.searchsorted(lo, np.r_[starts, n])
                doc = np.repeat(np.arange(len(starts)), np.diff(of))
                spans = pa.StructArray.from_arrays([lo - starts[doc], hi - starts[doc]], ["start", "end"])
                left = np.r_[0, np.cumsum(~gone)]
                nulls = np.frombuffer(row["nulls"], bool)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(block.ids, mask=nulls), "n_bytes": block.lens,
                    "spans": pa.ListArray.from_arrays(pa.array(of, pa.int32()), spans),
                    "kept": _blobs(block.data[~gone], np.r_[left[starts], left[n]]),
                })

    out = _answered(blocks, windows).select("block", "ids", "nulls", "lens", "data", "answers")
    return out.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
