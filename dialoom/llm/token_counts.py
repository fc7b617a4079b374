"""Token counts: a prefix dynamic program gives the exact number of tokens of every prefix of a text, in code points.

For byte-pair encoding, the encoding of a prefix of a pre-token ends in exactly one token t such that t may follow the last
token of what is left when t is cut off. So last[i] and count[i] = count[i - len(t)] + 1 follow from shorter prefixes, and
whether t may follow u depends on the pair alone and is remembered. Pre-tokens repeat, so their counts are remembered too
(bounded), and a text's counts are those of its pre-tokens, each raised by the count before it. Three places where a prefix is
split otherwise than the text are corrected: the last character of a white-space run, contractions, and special strings.

With the counts stored, questions about truncation and budgets are answered by lookup, without encoding again; counts may fall
where a longer merge appears, so longest_prefix() takes the last prefix within the budget.

Defined cases: null text counts as empty: 0 bytes, 0 tokens, one prefix (the empty one). Special strings inside texts are one
token each, as is the library's default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import small_batches, texts, vocabulary

#: Chunks, prefixes and pairs that a worker remembers. Of chunks the last two generations stay, so that frequent ones are not lost with
#: the rare ones; the others are emptied. Prefixes over SHARED_LETTERS and chunks over CACHE_LETTERS are not remembered.
CACHE_CHUNKS, CACHE_LETTERS, CACHE_NODES, SHARED_LETTERS, CACHE_PAIRS = 500_000, 40, 250_000, 8, 500_000
#: A word and marks after it, on the line or at the beginning of the next.
_SIMPLE = regex.compile(r"(\n?)(\p{L}+)([.,;:!?]*)")
_CONTROLS = re.compile("[\x1c-\x1f]")
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUN = regex.compile(r"\s{2,}(?=\S)")
_ONE = [bytes([b]) for b in range(256)]
#: 1 for each byte that begins a code point.
_LEADS = bytes(0 if 0x80 <= b < 0xC0 else 1 for b in range(256))
_counters: dict[str, PrefixCounter] = {}


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.model = Tokenizer.from_file(path).model
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.word = {i: t for t, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.letters = byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._forget()
        self.pairs: dict[int, bool] = {}

    def _follows(self, u: int, t: int) -> bool:
        """Whether t stays apart from u when both are encoded together; u = -1: whether t stays whole alone."""
        known = self.pairs.get(u << 20 | t)
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            s = self.word[t] if u < 0 else self.word[u] + self.word[t]
            known = [x.id for x in self.model.tokenize(s)] == ([t] if u < 0 else [u, t])
            self.pairs[u << 20 | t] = known
        return known

    def _known(self, s: str) -> bytes:
        """Counts of the prefixes 1..n of a short pre-token. For short prefixes the last tokens and counts on the way and where the
        last token begins are remembered, so that pre-tokens which begin alike share the work."""
        nodes, n = self.nodes, len(s)
        m = min(n, SHARED_LETTERS)
        while (node := nodes.get(s[:m])) is None:
            m -= 1
        last, count, begin = node
        if m == n:
            return count[1:]
        last, count = [*last], [*count]
        get, pairs, follows = self.vocab.get, self.pairs.get, self._follows
        for i in range(m + 1, n + 1):
            # exactly one begin holds, so those that hold most often come first: the last token grown, a new one, a short one
            t = get(s[begin:i]) if i > 1 else None
            if t is None or not (follows(last[begin], t) if (known := pairs(last[begin] << 20 | t)) is None else known):
                begin = i - 1
                while (t := get(s[begin:i])) is None or not (follows(last[begin], t) if (known := pairs(last[begin] << 20 | t)) is None else known):
                    begin -= 1
            last.append(t)
            count.append(count[begin] + 1)
            if i <= SHARED_LETTERS:
                nodes[s[:i]] = (tuple(last), bytes(count), begin)
        return bytes(count[1:])

    def _long(self, s: str) -> list[int]:
        """Counts of the prefixes 1..n of any pre-token; nothing but pairs is remembered."""
        get, longest, follows = self.vocab.get, self.longest, self._follows
        last, count, begin = [-1], [0], [0]
        for i in range(1, len(s) + 1):
            for j in (begin[-1], *range(i - 1, max(0, i - longest) - 1, -1)):
                t = get(s[j:i])
                if t is not None and follows(last[j], t):
                    last.append(t)
                    count.append(count[j] + 1)
                    begin.append(j)
                    break
        return count[1:]

    def _piece(self, piece: str) -> list[int]:
        """Counts of the prefixes 1..n code points of one pre-token."""
        raw = piece.encode("utf-8", "surrogatepass")
        s = "".join([self.letters[b] for b in raw])
        found = list(self._known(s) if len(s) <= CACHE_LETTERS else self._long(s))
        if len(raw) > len(piece):
            found = list(compress(found, raw.translate(_LEADS)[1:] + b"\1"))
        if piece in ("'re", "'ve", "'ll"):
            found[1] = found[0] + self._piece(piece[1])[0]  # "'r" is no contraction: two pre-tokens
        return found

    def _forget(self) -> None:
        self.nodes: dict[str, tuple[tuple[int, ...], bytes, int]] = {"": ((-1,), b"\0", 0)}

    def _split(self, text: str) -> list[int]:
        """Counts of the prefixes 1..n code points, by pre-tokens."""
        out: list[int] = []
        base = 0
        for p in _SPLIT.findall(text):
            c = self._piece(p)
            out += [base + x for x in c] if base else c
            base = out[-1]
        for m in _RUN.finditer(text) if len(text) > 1 and text != "\n" else ():  # a prefix that ends with the run has it as one pre-token
            out[m.end() - 1] = (out[m.start() - 1] if m.start() else 0) + self._piece(m[0])[-1]
        return out

    def _remember(self, chunk: str) -> bytes | None:
        """The counts of a chunk that begins at white space and has no more of it; None: the text must be split as a whole."""
        if not chunk or chunk[-1].isspace() or chunk[0].isspace() and (chunk[0] != "\n" or chunk[1].isspace()):
            return None
        if (found := self.older.get(chunk)) is not None:
            self.chunks[chunk] = found
            return found
        m = _SIMPLE.fullmatch(chunk) if len(chunk) <= CACHE_LETTERS else None
        if m:  # a word and marks after it: at most three pre-tokens
            line, word, marks = m.groups()
            raw = word.encode() if line else b" " + word.encode()
            if word.isascii():
                c = self._known(word if line else "\u0120" + word)
            else:
                c = self._known("".join([self.letters[b] for b in raw]))
                c = bytes(compress(c, raw.translate(_LEADS)[1:] + b"\1"))
            if line:
                k = self._known("\u010a")[0]
                c = _ONE[k] + bytes([k + x for x in c])
            if marks:
                k = c[-1]
                c += bytes([k + x for x in self._known(marks)])
            self.chunks[chunk] = c
            return c
        c = self._split(chunk if chunk[0] == "\n" else " " + chunk)
        if max(c) > 255:
            return None
        found = bytes(c)
        if len(chunk) <= CACHE_LETTERS:
            self.chunks[chunk] = found
        return found

    def _plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes 0..n code points of a text without special strings. Between a letter and a single space or line
        feed that a letter follows, pre-tokens always part; such chunks are remembered."""
        if not text:
            return np.zeros(1, np.int32)
        if len(self.nodes) > CACHE_NODES:
            self._forget()
        head, *rest = text.replace("\n", " \n").split(" ")
        known = None
        if head and not head[-1].isspace() and not _CONTROLS.search(text):
            if len(self.chunks) > CACHE_CHUNKS:
                self.chunks, self.older = {}, self.chunks
            get = self.chunks.get
            known = [get(x) or self._remember(x) for x in rest]
            if None in known:
                known = None
        if known is None:
            return np.array([0, *self._split(text)], np.int32)
        first = self._split(head)
        counts = np.empty(len(text) + 1, np.int32)
        counts[0] = 0
        counts[1 : len(head) + 1] = first
        if known:
            local = np.frombuffer(b"".join(known), np.uint8)
            sizes = np.fromiter(map(len, known), np.int64, len(known))
            base = np.full(len(known), first[-1], np.int32)
            base[1:] += np.cumsum(local[np.cumsum(sizes)[:-1] - 1], dtype=np.int32)
            np.add(local, np.repeat(base, sizes), out=counts[len(head) + 1 :])
        return counts

    def counts(self, text: str) -> np.ndarray:
        """counts[p]: the exact number of tokens of text[:p], for p from 0 to len(text)."""
        for special in self.special:
            if special in text:
                out, base = [np.zeros(1, np.int32)], 0
                parts = text.split(special)
                for k, part in enumerate(parts):
                    more = k + 1 < len(parts)
                    c = self._plain(part + special[:-1] * more)
                    out.append(c[1:] + base)
                    base += int(c[len(part)]) + more
                    if more:
                        out.append(np.array([base], np.int32))
                return np.concatenate(out)
        return self._plain(text)


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def pack(counts: np.ndarray) -> bytes:
    return counts.astype("<i4").tobytes()


def tokens_at(packed: bytes, p: int) -> int:
    """The tokens of the first p code points, from the stored counts."""
    return int(np.frombuffer(packed, "<i4")[p])


def longest_prefix(packed: bytes, budget: int) -> int:
    """The most code points whose tokens are within the budget, from the stored counts; 0 if only the empty prefix is."""
    fits = np.flatnonzero(np.frombuffer(packed, "<i4") <= budget)
    return int(fits[-1]) if len(fits) else 0


def prefix_token_counts(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 512, keep_counts: bool = False) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit, fit_chars (the longest prefix within the limit)
    and, with keep_counts, prefix_counts: the stored counts (pack()) of every prefix. A map over partitions: no shuffle."""
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())]
    schema = pa.schema(fields + [("prefix_counts", pa.binary())] * keep_counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary(vocab))
        for batch in batches:
            col = texts(batch)
            total, fit, kept = [], [], []
            for text in col.to_pylist():
                c = of.counts(text)
                n = int(c[-1])
                total.append(n)
                fit.append(len(text) if n <= limit else int(np.flatnonzero(c <= limit)[-1]))
                if keep_counts:
                    kept.append(pack(c))
            size = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1])
            tokens = np.array(total, np.int64)
            data = [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens), pa.array(tokens > limit), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(data + [pa.array(kept, pa.binary())] * keep_counts, schema=schema)

    kinds = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_counts binary" * keep_counts
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, kinds)
