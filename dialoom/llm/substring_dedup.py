"""Substring dedup: words covered by a window of `k` words that also starts in a document with a smaller doc_id are removed.

Two forms. `remove_reference_spans` is the one for reference texts of bounded size: suffix automata over the words of reference
shards are broadcast, documents are streamed through them for matching statistics, and maximal spans of at least `k` words go.
`dedup` compares all documents with all earlier ones. There every document is a reference, so automata would have to be built
over the whole corpus and every document streamed through every shard: work grows with the square of the input (README). It
looks windows up by hash instead, which for a fixed length decides the same question:

1. Map: batches of documents become 80-bit window hashes (numpy, no step for each word). Windows that a smaller document of the
   batch has are settled there, so a passage that a third of all documents share leaves each batch once. The other windows go,
   10 bytes each, to partition hash % P, bundled by document; a document's settled windows travel as one bit mask. P is at least
   the number of shuffle partitions and grows with the text, so that a partition looks up about PART_BYTES of text at most.
2. Each partition sorts its hashes, one range of them after the other, takes the smallest doc_id of each and sends one bit for
   each window back, bundled.
3. Documents (compressed) and bits meet by document key; covered words are dropped. Bits stay packed until their document comes.

Two windows count as equal if their 80-bit hashes are (among 1e13 windows, some 40 false pairs are expected). Input should be a table
or another source that gives the same order when a task is run again. Defined cases: null text has no words; null doc_id is larger
than any other and equal to its like; documents with equal doc_id never remove from each other; texts shorter than k words stay;
an empty table gives no rows; the result has one row for each input row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import gathered, partitions, small_batches, texts
from dialoom.llm.kernel import Words, runs
from dialoom.llm.suffix_automaton import SuffixAutomaton

#: Bytes of text hashed together, bytes of text whose windows one partition looks up, and windows sorted at once; they bound a
#: task's memory.
BATCH_BYTES, PART_BYTES, SORTED = 6 << 20, 32 << 20, 500_000
_LAST = np.iinfo(np.int64).max
_ROWS = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _pack(tag: int, ids: np.ndarray, prints: np.ndarray, counts: np.ndarray, rest: bytes) -> bytes:
    """tag, number of documents, their ids (over the least, in as few bytes as fit), fingerprints and counts, then `rest`."""
    least = int(ids.min())
    span, top = int(ids.max()) - least, int(counts.max())
    width = next(b for b in (2, 4, 8) if span < 1 << 8 * b)
    size = next(b for b in (1, 2, 4) if top < 1 << 8 * b)
    own = (ids.astype(np.uint64) - np.uint64(least & (1 << 64) - 1)).astype(f"<u{width}")
    head = np.array([tag, len(ids), least, width << 8 | size], "<i8").tobytes()
    return head + own.tobytes() + prints.astype("<u4").tobytes() + counts.astype(f"<u{size}").tobytes() + rest


def _unpack(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, memoryview]:
    tag, n, least, sizes = np.frombuffer(data, "<i8", 4).tolist()
    width, size = sizes >> 8, sizes & 255
    ids = (np.frombuffer(data, f"<u{width}", n, 32).astype(np.uint64) + np.uint64(least & (1 << 64) - 1)).astype(np.int64)
    at = 32 + n * width
    return tag, ids, np.frombuffer(data, "<u4", n, at), np.frombuffer(data, f"<u{size}", n, at + 4 * n), memoryview(data)[at + (4 + size) * n :]


def _hashes(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 16 bits of hash of the windows that begin at each word, and whether there is one."""
    words = w.hashes()
    h, ok = w.windows(words, k)
    return h, (w.windows(words, k, salt=1)[0] >> np.uint64(48)).astype(np.uint16), ok


def _ordered(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, and where in it each run of equal windows begins."""
    order = np.argsort(h)
    same, other = h[order[1:]] == h[order[:-1]], g[order[1:]] != g[order[:-1]]
    if (same & other).any():  # rare: windows that share the first 64 bits alone
        order = np.lexsort((g, h))
        same, other = h[order[1:]] == h[order[:-1]], g[order[1:]] != g[order[:-1]]
    return order, np.concatenate([np.zeros(min(1, len(h)), np.int64), np.flatnonzero(~same | other) + 1])


def _sections(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        yield _unpack(data[at + 8 : at + 8 + n])
        at += 8 + n


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id, null as the largest, and the 32-bit fingerprint of the row."""
    ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, (batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF).astype(np.uint32)


def _groups(order: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The indices of each key, keys sorted by `order`."""
    at = runs(keys[order])
    for s, e in zip(at, [*at[1:], len(order)], strict=True):
        yield int(keys[order[s]]), order[s:e]


def _send(k: int, parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        tag = (context.partitionId() if context else 0) << 24
        for batch in gathered(batches, BATCH_BYTES):
            tag += 1
            ids, prints = _keys(batch)
            w = Words(texts(batch))
            h, g, ok = _hashes(w, k)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h, g, doc = h[at], g[at], w.of()[at].astype(np.int32)
            del at, ok, w
            order, first = _ordered(h, g)
            owner = np.repeat(np.minimum.reduceat(ids[doc[order]], first), np.diff(first, append=len(order)))
            settled = np.empty(len(h), bool)
            settled[order] = ids[doc[order]] > owner
            del order, owner
            rows = []
            # the documents' masks of settled windows; a document without any needs none
            n_windows = np.bincount(doc, minlength=len(ids))
            some = np.flatnonzero(np.bincount(doc[settled], minlength=len(ids)))
            if len(some):
                begin = np.concatenate([[0], np.cumsum(n_windows)])
                for q, own in _groups(*(lambda t: (np.argsort(t, kind="stable"), t))(prints[some] % np.uint32(parts))):
                    docs = some[own]
                    bits = b"".join([np.packbits(settled[begin[d] : begin[d + 1]]).tobytes() for d in docs])
                    mask = _pack(tag, ids[docs], prints[docs], n_windows[docs], bits)
                    rows.append((q, 1, len(mask).to_bytes(8, "little") + mask))
            left = np.flatnonzero(~settled)
            part = (h[left] % np.uint64(parts)).astype(np.int64)
            for p, own in _groups(np.argsort(part, kind="stable"), part):  # stable: by document, then position
                d = doc[left[own]]
                s = runs(d)
                docs = d[s]
                rows.append((p, 0, _pack(tag, ids[docs], prints[docs], np.diff(s, append=len(d)), h[left[own]].astype("<u8").tobytes() + g[left[own]].astype("<u2").tobytes())))
            for i in range(0, len(rows), 64):
                p, kind, data = zip(*rows[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], schema=_ROWS)

    return send


def _look_up(parts: int):
    def settle(p: int, held: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        heads, n = [], 0
        most = sum(map(len, held)) // 10
        h, g = np.empty(most, np.uint64), np.empty(most, np.uint16)
        held.reverse()
        while held:
            tag, own, marks, sizes, rest = _unpack(held.pop())
            m = len(rest) // 10
            h[n : n + m], g[n : n + m] = np.frombuffer(rest, "<u8", m), np.frombuffer(rest, "<u2", m, 8 * m)
            heads.append((np.full(len(own), tag), own.copy(), marks.copy(), sizes.astype(np.int64)))
            n += m
        h, g = h[:n], g[:n]
        tags, ids, prints, counts = (np.concatenate(x) for x in zip(*heads, strict=True))
        del heads
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        late = np.empty(n, bool)
        ranges = min(256, 1 << (n // SORTED).bit_length())
        band = (h >> np.uint64(56)).astype(np.uint8) & np.uint8(ranges - 1)
        for r in range(ranges):
            at = np.flatnonzero(band == r)
            if len(at):
                order, first = _ordered(h[at], g[at])
                own = ids[doc[at[order]]]
                late[at[order]] = own > np.repeat(np.minimum.reduceat(own, first), np.diff(first, append=len(order)))
        del h, g, doc, band
        begin = np.concatenate([[0], np.cumsum(counts)])
        some = np.flatnonzero(np.add.reduceat(late, begin[:-1], dtype=np.int64))
        if not len(some):
            return
        q = (prints[some] % np.uint32(parts)).astype(np.int64)
        for to, own in _groups(np.lexsort((tags[some], q)), q):  # one row for each partition to answer, its tags one after another
            packed = []
            for tag, at in _groups(np.arange(len(own)), tags[some][own]):
                docs = some[own[at]]
                bits = b"".join([np.packbits(late[begin[d] : begin[d + 1]]).tobytes() for d in docs])
                packed.append(_pack(tag, ids[docs], prints[docs], counts[docs], bits))
            yield to, 2 + p, b"".join([len(x).to_bytes(8, "little") + x for x in packed])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = -1

        def out(rows: list) -> pa.RecordBatch:
            p, kind, data = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], schema=_ROWS)

        for batch in batches:
            passed = []
            for p, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    passed.append((p, 1, data))
                    continue
                if p != now and held:
                    yield from (out([r]) for r in settle(now, held))
                now = p
                held.append(data)
            if passed:
                yield out(passed)
        if held:
            rows = []
            for r in settle(now, held):
                rows.append(r)
                if len(rows) == 64:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return look_up


class _Answers:
    """The bits that a partition's documents are sent, packed as they come, and found by fingerprint and doc_id."""

    def __init__(self):
        self.bits, self.parts = bytearray(), []

    def add(self, kind: int, data: bytes) -> None:
        for tag, ids, prints, counts, rest in _sections(data):
            n = counts.astype(np.int64)
            size = (n + 7) // 8
            self.parts.append((prints.copy(), ids.copy(), np.full(len(ids), tag), np.full(len(ids), kind), n, len(self.bits) + np.cumsum(size) - size))
            self.bits += rest

    def close(self) -> None:
        if self.parts:
            columns = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            self.print, self.id, self.tag, self.kind, self.n, self.at = (c[order] for c in columns)
        self.parts = None

    def of(self, id: int, mark: int) -> dict[int, dict[int, np.ndarray]]:
        """By tag, the mask of settled windows (kind 1) and the bits from partition p (kind 2 + p)."""
        found: dict[int, dict[int, np.ndarray]] = {}
        if self.bits:
            a, b = np.searchsorted(self.print, [mark, mark + 1])
            for i in (a + np.flatnonzero(self.id[a:b] == id)).tolist():
                n, at = int(self.n[i]), int(self.at[i])
                packed = np.frombuffer(self.bits, np.uint8, (n + 7) // 8, at)
                found.setdefault(int(self.tag[i]), {})[int(self.kind[i])] = np.unpackbits(packed, count=n).astype(bool)
        return found


def _flags(found: dict[int, dict[int, np.ndarray]], h: np.ndarray, parts: int) -> np.ndarray:
    """Which windows of a document are to go, from what _Answers.of() has, in the order in which the windows left for partitions."""
    out = np.zeros(len(h), bool)
    part = (h % np.uint64(parts)).astype(np.int64)
    for of in found.values():
        settled = of.get(1)
        settled = np.zeros(len(h), bool) if settled is None else settled
        out |= settled
        if len(of) > (1 in of):
            left = np.flatnonzero(~settled)
            order = left[np.argsort(part[left], kind="stable")]
            own = part[order]
            for kind, bits in of.items():
                if kind >= 2:
                    s = np.searchsorted(own, kind - 2)
                    out[order[s : s + len(bits)]] |= bits
    return out


def _compress(parts: int):
    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            prints = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF
            data = [None if x is None else c.compress(x.encode()) for x in batch.column(1).to_pylist()]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array((prints % parts).astype(np.int32)), pa.array(np.full(n, 1 << 30, np.int32)), pa.array(data, pa.binary()), batch.column(0), pa.array(prints)], schema=_MET)

    return compressed


_MET = pa.schema([*_ROWS, ("doc_id", pa.int64()), ("print", pa.int64())])


def _finish(k: int, parts: int, keep_text: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.string())] * keep_text)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        answers, before, words_left = _Answers(), None, []
        for batch in batches:
            out: list[tuple] = []
            for kind, data, doc_id, mark in zip(*(batch.column(c).to_pylist() for c in ("kind", "data", "doc_id", "print")), strict=True):
                if kind < 1 << 30:
                    answers.add(kind, data)
                    continue
                if answers.parts is not None:
                    answers.close()
                raw = b"" if data is None else z.decompress(data)
                if (doc_id, mark, raw) != before:  # equal rows come one after another
                    before = doc_id, mark, raw
                    words_left = words = raw.split()  # at space and tab..carriage return, as bytes
                    if own := answers.of(_LAST if doc_id is None else doc_id, mark):
                        w = Words(pa.array([raw], pa.large_binary()).view(pa.large_string()))
                        h, ok = w.windows(w.hashes(), k)
                        late = np.flatnonzero(_flags(own, h[ok], parts))
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, late, 1)
                        np.add.at(edge, late + k, -1)
                        words_left = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                removed = len(words) - len(words_left)
                left = b" ".join(words_left)
                out.append((doc_id, len(words), removed, hashlib.sha256(left).hexdigest(), *[left.decode()] * keep_text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return finish


def dedup(docs: DataFrame, k: int = 13, parts: int | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by single spaces) and, with keep_text, the kept words
    for each row of docs(doc_id, text)."""
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(8, partitions(docs.sparkSession), -(-size // PART_BYTES))
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("__row"))
    kinds = "p int, kind int, data binary"
    sent = own.mapInArrow(_send(k, parts), kinds).repartitionById(parts, F.col("p"))
    back = sent.mapInArrow(_look_up(parts), kinds)
    whole = own.mapInArrow(_compress(parts), kinds + ", doc_id long, print long")
    met = back.withColumn("doc_id", F.lit(None).cast("long")).withColumn("print", F.lit(None).cast("long")).unionByName(whole)
    met = met.repartitionById(parts, F.col("p")).sortWithinPartitions("kind", "print", "doc_id")
    return met.mapInArrow(_finish(k, parts, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


#: Words of one reference shard; its automaton has at most twice as many states. References beyond MAX_SHARDS shards are refused.
SHARD_WORDS, MAX_SHARDS = 200_000, 64


def remove_reference_spans(docs: DataFrame, reference: DataFrame, k: int = 13) -> DataFrame:
    """docs(doc_id, text) streamed through suffix automata of reference(text): every maximal span of at least k words that stands in
    a reference text is removed. doc_id, n_words, n_removed, kept. The reference is counted first: up to SHARD_WORDS *
    MAX_SHARDS words, shard by shard broadcast; for more, use dedup() on the union with smaller ids for the reference."""
    spark = docs.sparkSession
    small_batches(spark)
    size = F.coalesce(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")), F.lit(0))
    total = reference.select(F.sum(size)).first()[0] or 0
    if total > SHARD_WORDS * MAX_SHARDS:
        raise ValueError(f"{total} reference words; the bound is {SHARD_WORDS * MAX_SHARDS}")
    shards: list[list[list[bytes]]] = [[]]
    n = 0
    for row in reference.select("text").where("text is not null").toLocalIterator():
        words = row["text"].encode().split()
        if n + len(words) > SHARD_WORDS and n:
            shards.append([])
            n = 0
        shards[-1].append(words)
        n += len(words)
    sent = [spark.sparkContext.broadcast(SuffixAutomaton(x)) for x in shards]
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch).to_pylist(), strict=True):
                words = text.encode().split()
                keep = [True] * len(words)
                for s in sent:
                    for start, end in s.value.spans(words, k):
                        keep[start:end] = [False] * (end - start)
                left = list(compress(words, keep))
                out.append((doc_id, len(words), len(words) - len(left), b" ".join(left).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stream, "doc_id long, n_words long, n_removed long, kept string")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
s AS (SELECT rid, doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM p),
m AS (SELECT rid, p, doc_id > min(doc_id) OVER (PARTITION BY s) AS late FROM s),
c AS (SELECT rid, list(DISTINCT q) AS gone FROM (SELECT rid, unnest(range(p, p + 13)) AS q FROM m WHERE late) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN c USING (rid)
"""
