"""Benchmark decontamination by templates: numbers, units and names become typed placeholders, windows of `k` template tokens are
hash-joined with the benchmark's, and slots must agree for a match to count.

Template tokens are white-space separated words without marks around them, in lower case; <num> for numbers, <unit> for known
units right after a number, <name> for capitalised words, a run of them in a sentence being one. Words that begin a sentence are read twice: as they
stand, and as names unless they are usual openers (OPENERS). Windows with fewer than half literal tokens say little and count only
for items that have no others; an item shorter than k is one window of its own length.

A document holds an item if at least `share` of the item's windows, in one reading of the item, stand in readings of the document
whose slots are consistent: within an alignment, an item's value must always become the same document value (two may become the
same). All equal: `exact`; a change: `reparameterised`; else the match is dropped.

Scale: the benchmark is counted; up to MAX_TOKENS tokens it is one broadcast hash table, a larger one is cut into shards of that
size by item, with a pass over the documents for each. Documents are never shuffled.

Defined cases: null or empty texts match nothing and are kept; items without a word match nothing; equal rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import small_batches, texts
from dialoom.llm.kernel import Words

MAX_TOKENS = 5_000_000
CACHE_WORDS, CACHE_LETTERS = 500_000, 40
NUM, UNIT, NAME = 1, 2, 3
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th|[a-zA-Z]{1,3})?")
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs ms hz khz mhz ghz b kb mb gb tb w kw mw v a j kj cal kcal n pa bar c f k mph kph kmh usd eur gbp "
    "meter meters metre metres kilometer kilometers centimeter centimeters inch inches foot feet yard yards mile miles gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees degree watts volts".split()
)
#: Words that begin sentences and are not names.
OPENERS = frozenset(
    "a an the this that these those there here he she it they we you i his her its their our your my if when while after before then now how what which who whose where why "
    "and but or so because since as at in on of for from by to with without each every all both some many most one two three another other no not is are was were do does did has have had can could would should "
    "yesterday today tomorrow later finally first next also however suppose assume given let find calculate read "
    "el la los las un una en de y si cuando cuánto cuántos le les des du une et dans il elle der die das ein eine und wenn wie er sie es im".split()
)
_MARKS = "\"'`.,;:!?()[]{}<>«»“”‘’…*_"
_END = re.compile(r"[.!?][\"'”’)\]]*$")


def _code(word: str) -> int:
    """A 63-bit number: the template token, with the lowest bit for the end of a sentence, then one for a capital, one for an opener
    and one for a unit, which is one only after a number."""
    plain = word.strip(_MARKS)
    end = bool(_END.search(word))
    unit = plain.lower() in UNITS or plain == "%"
    if _NUMBER.fullmatch(plain):
        token, capital = NUM, False
    else:
        token = int.from_bytes(hashlib.blake2b(plain.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 5 | 16
        capital = plain[:1].isupper() and plain[1:2].islower()
    return token << 4 | unit << 3 | (plain.lower() in OPENERS) << 2 | capital << 1 | end


class Templates:
    """Template tokens of texts, with a bounded memory of words."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def _new(self, word: str) -> int:
        code = _code(word)
        if len(word) <= CACHE_LETTERS:
            self.codes[word] = code
        return code

    def of(self, many: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[list[str]]]:
        """The two readings of all texts, with words that begin a sentence as they stand and as names: tokens, where each text's
        begin (n + 1) and each token's word (in its text); and the words of each text."""
        if len(self.codes) > CACHE_WORDS:
            self.codes.clear()
        words = [x.split() for x in many]
        get, new = self.codes.get, self._new
        codes = np.array([get(w) or new(w) for ws in words for w in ws], np.int64)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]).astype(np.int64)
        opens = np.ones(len(codes), bool)
        opens[1:] = codes[:-1] & 1
        opens[first[:-1][first[:-1] < len(codes)]] = True
        unit = np.zeros(len(codes), bool)
        unit[1:] = (codes[1:] & 8 > 0) & (codes[:-1] >> 4 == NUM) & ~opens[1:]
        capital = (codes & 2 > 0) & ~unit
        base = np.repeat(first[:-1], np.diff(first))
        out = []
        for name in (capital & ~opens, capital & ~(opens & (codes & 4 > 0))):
            tokens = codes >> 4
            tokens[unit], tokens[name] = UNIT, NAME
            again = np.zeros(len(codes), bool)
            again[1:] = name[1:] & name[:-1] & ~opens[1:]
            keep = np.flatnonzero(~again)
            out.append((tokens[keep].astype(np.uint64), np.searchsorted(keep, first), keep - base[keep]))
        return out, words


def _windows(tokens: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the window at each token, whether it ends in its text, and whether half of it or more is literal."""
    shape = Words.__new__(Words)
    shape.first = first
    h, ok = shape.windows(tokens, k)
    literal = np.concatenate([[0], np.cumsum(tokens >= 16)])
    n = len(tokens)
    rich = literal[np.minimum(np.arange(n) + k, n)] - literal[:n] >= (k + 1) // 2
    return h, ok, rich


class Benchmark:
    """The items' windows: sorted hashes, and for each the items and positions."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k = k
        readings, words = Templates().of([t for _, t in items])
        self.ids = [i for i, _ in items]
        #: By reading and item, numbered through: a variant v is of item v % len(ids).
        self.sizes: list[int] = []
        self.slots: list[list[str]] = []
        self.windows = [0] * (len(readings) * len(items))
        self.posted: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for r, (tokens, first, at) in enumerate(readings):
            plain, starts = readings[0][:2]
            sizes = [min(k, int(n)) for n in np.diff(first)]
            bounds = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            self.sizes += sizes
            self.slots += [_values(words[n], at[a:b]) for n, (a, b) in enumerate(bounds)]
            for size in sorted(set(sizes) - {0}):
                h, ok, rich = _windows(tokens, first, size)
                for n, (a, b) in enumerate(bounds):
                    if sizes[n] != size or r and np.array_equal(tokens[a:b], plain[starts[n] : starts[n + 1]]):
                        continue
                    every = [j for j in range(a, b) if ok[j]]
                    own = [j for j in every if rich[j]]
                    if r and not own:  # names only: the other reading says more
                        continue
                    own = own or every
                    v = r * len(items) + n
                    # a reading with fewer windows must not be easier to reach
                    self.windows[v] = max(len(own), self.windows[n])
                    for j in own:
                        self.posted[size][int(h[j])].append((v, j - a))
        self.posted = {size: dict(p) for size, p in self.posted.items()}
        self.sorted = {size: np.sort(np.array(list(p), np.uint64)) for size, p in self.posted.items()}


def _values(words: list[str], at: np.ndarray) -> list[str]:
    """The value of each token: its words without marks, a run of names joined."""
    ends = [*at[1:].tolist(), len(words)] if len(at) else []
    return [" ".join(w.strip(_MARKS) for w in words[a:b]).lower() for a, b in zip(at.tolist(), ends, strict=True)]


def _aligned(pairs: list[tuple[int, int]], size: int, tokens: np.ndarray, values: list[str], item: list[str]) -> str | None:
    """exact or reparameterised if some alignment of the matched windows (document position, item position) has consistent slots."""
    by: dict[int, list[int]] = defaultdict(list)
    for p, q in pairs:
        by[p - q].append(q)
    verdict = None
    for shift, starts in by.items():
        there: dict[tuple[int, str], str] = {}
        same = ok = True
        for q in {q + j for q in starts for j in range(size)}:
            if (kind := int(tokens[q + shift])) < 16:
                a, b = item[q], values[q + shift]
                same &= a == b
                ok &= there.setdefault((kind, a), b) == b
        if same:
            return "exact"
        if ok:
            verdict = "reparameterised"
    return verdict


def matches(bench: Benchmark, templates: Templates, many: list[str], share: float) -> list[tuple[int, int, float, str]]:
    """(text, item, share of its windows, kind) of each item that a text holds."""
    readings, words = templates.of(many)
    found: dict[tuple[int, int], list[list[tuple[int, int]]]] = defaultdict(lambda: [[] for _ in readings])
    for r, (tokens, first, _) in enumerate(readings):
        for size, keys in bench.sorted.items():
            if len(tokens) < size:
                continue
            h, ok, _ = _windows(tokens, first, size)
            bits = np.zeros(1 << 18, bool)
            bits[(keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            maybe = np.flatnonzero(bits[(h & np.uint64((1 << 18) - 1)).astype(np.int64)] & ok)
            slot = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            hit = maybe[keys[slot] == h[maybe]]
            text = np.searchsorted(first, hit, "right") - 1
            posted = bench.posted[size]
            for j, t in zip(hit.tolist(), text.tolist(), strict=True):
                for v, q in posted[int(h[j])]:
                    found[t, v][r].append((j - int(first[t]), q))
    best: dict[tuple[int, int], tuple[float, bool, str]] = {}
    for (t, v), both in found.items():
        if len({q for pairs in both for _, q in pairs}) < share * bench.windows[v]:
            continue
        held: set[int] = set()
        most, kind = 0, None
        for pairs, (tokens, first, at) in zip(both, readings, strict=True):
            a, b = int(first[t]), int(first[t + 1])
            own = {q for _, q in pairs}
            verdict = _aligned(pairs, bench.sizes[v], tokens[a:b], _values(words[t], at[a:b]), bench.slots[v]) if pairs else None
            if verdict:
                held |= own
                if len(own) > most:
                    most, kind = len(own), verdict
        part = len(held) / bench.windows[v]
        if kind and part >= share:
            key = t, v % len(bench.ids)
            best[key] = max(best.get(key, (0.0, False, "")), (part, kind == "exact", kind))
    return [(t, n, part, kind) for (t, n), (part, _, kind) in best.items()]


def shards(benchmark: DataFrame, k: int) -> list[Broadcast]:
    """The benchmark(item_id, text) as broadcast tables of at most about MAX_TOKENS tokens each."""
    spark = benchmark.sparkSession
    own = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("t is not null")
    total = own.select(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    n = 2 * total // MAX_TOKENS + 1  # both readings
    out = []
    for s in range(n):
        part = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == s) if n > 1 else own
        out.append(spark.sparkContext.broadcast(Benchmark(sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), k)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 8, share: float = 0.5) -> DataFrame:
    """doc_id, item_id, contained (share of the item's windows) and kind for each row of docs(doc_id, text) and item that it holds."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("contained", pa.float64()), ("kind", pa.string())])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def finder(sent: Broadcast):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench, templates = sent.value, Templates()
            for batch in batches:
                found = matches(bench, templates, texts(batch).to_pylist(), share)
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, *_ in found], pa.int64()), pa.array([bench.ids[n] for _, n, *_ in found], pa.int64()), pa.array([c for *_, c, _ in found], pa.float64()), pa.array([x for *_, x in found], pa.string())], schema=schema)

        return find

    out = None
    for sent in shards(benchmark, k):
        part = own.mapInArrow(finder(sent), "doc_id long, item_id long, contained double, kind string")
        out = part if out is None else out.union(part)
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame, k: int = 8, share: float = 0.5) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; rows pass through, nothing is joined."""
    small_batches(docs.sparkSession)
    sent = shards(benchmark, k)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            many = texts(batch).to_pylist()
            keep = np.ones(len(many), bool)
            for s in sent:
                keep[[t for t, *_ in matches(s.value, templates, many, share)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(drop, docs.schema)
