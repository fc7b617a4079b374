"""Secret scans: three exact patterns, and a dictionary-primed compression test for strings that no pattern knows.

Novelty: a compressor primed with a dictionary of identifiers and the text around a candidate compresses the surroundings alone
and with the candidate. The difference, in bits for each character, is small for words, paths and repeated strings, and close to
the alphabet's entropy for random strings. Candidates begin near after a sensitive word, on its line or the following ones, or on
the line right after a novel one (bodies of keys); the sensitive word may be the beginning or a part of an identifier. Those at or
above `min_bits` are reported as kind `novel`. The patterns' spans always stay.

A map over partitions: no shuffle, nothing gathered. Whole texts are searched. Defined cases: null text counts as empty and has
no span; equal rows give equal results; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import small_batches, texts

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase|(?!(?-i:[a-z])))|secret|token|(?:api|private|access)[ _-]?key|credential|bearer|authorization|signature)", re.ASCII | re.IGNORECASE)
#: The rest of an identifier and its assignment.
_ASSIGNED = re.compile(r"""[A-Za-z0-9_.-]{0,64}["'\]]{0,2}\x20*(?::=|=>|[:=])""")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]+")
#: Only texts that match are looked at one by one.
_ANY = r"(?i:pass|secret|token|(?:api|private|access)[ _-]?key|credential|bearer|authorization|signature)|AKIA[A-Z0-9]|[0-9a-f]{16}"
#: Common identifiers, the dictionary's fixed part.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey private_key access_key client_id client_secret credential authorization bearer signature "
    "username user name email host hostname port server database connection config configuration settings environment production development staging "
    "example localhost default undefined null true false none return function class import from export const public private static void string integer "
    "http https www com org net io json yaml xml html index main test tests utils helper controller service manager handler factory provider request response "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ changeme placeholder your_token_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the three patterns' matches."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


class Novelty:
    """Bits for each character that a string adds to what the dictionary and the surroundings hold."""

    def __init__(self, around: int = 512, level: int = 3):
        import zstandard

        self.z, self.around, self.level = zstandard, around, level

    def bits(self, text: str, start: int, end: int) -> float:
        near = text[max(0, start - self.around) : start] + "\n" + text[end : end + self.around]
        primed = self.z.ZstdCompressionDict((IDENTIFIERS + "\n" + near).encode("utf-8", "replace"), dict_type=self.z.DICT_TYPE_RAWCONTENT)
        c = self.z.ZstdCompressor(level=self.level, dict_data=primed, write_checksum=False, write_content_size=False)
        lead = text[max(0, start - 32) : start].encode("utf-8", "replace")
        return 8 * (len(c.compress(lead + text[start:end].encode())) - len(c.compress(lead))) / (end - start)


class _Taken:
    """Spans that stand already, merged and sorted, so that a search is logarithmic."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e, _ in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, start: int, end: int) -> bool:
        """Adds a span unless it overlaps one; whether it was added."""
        i = bisect_right(self.ends, start)
        if i < len(self.starts) and self.starts[i] < end:
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True

    def free(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i == len(self.starts) or self.starts[i] >= end


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty, min_bits: float, reach: int, min_chars: int = 16, min_distinct: int = 8) -> list[tuple[int, int, str]]:
    """Incompressible strings of at least `min_chars` characters, `min_distinct` of them different, that begin within `reach`
    characters after a sensitive word, or on the line right after one found, and overlap no span yet."""
    out: set[tuple[int, int]] = set()
    tested: set[tuple[int, int]] = set()
    busy = _Taken(taken)
    for m in _SENSITIVE.finditer(text):
        value = _ASSIGNED.match(text, m.end())
        # the value without its identifier first, then all strings after the word
        for begin in [value.end(), m.end()] if value else [m.end()]:
            last = None
            for c in _CANDIDATE.finditer(text, begin):
                if c.start() > m.end() + reach and not (value and c.start() <= value.end() + reach) and (last is None or text[last : c.start()].strip("\r\n\t \\\"',+")):
                    break
                span = c.span()
                if span[1] - span[0] < min_chars:
                    continue
                if span not in tested:
                    tested.add(span)
                    if busy.free(*span) and len(set(c[0])) >= min_distinct and novelty.bits(text, *span) >= min_bits:
                        busy.add(*span)
                        out.add(span)
                if span in out:
                    last = span[1]
    return [(s, e, "novel") for s, e in out]


def scan_secrets(docs: DataFrame, min_bits: float = 5.0, reach: int = 80, min_chars: int = 16, min_distinct: int = 8, around: int = 512) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, n_novel, base (the patterns' spans) and spans (all
    of them), both kind:start:end by start and then kind, comma-joined. min_bits to min_distinct say what is novel (novel_spans),
    `around` how many characters on each side prime the compressor."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(around)
        show = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        for batch in batches:
            col = texts(batch)
            n = len(col)
            counts, base, both = [[0] * n for _ in KINDS], [""] * n, [""] * n
            for i in pc.indices_nonzero(pc.match_substring_regex(col, _ANY)).to_pylist():
                text = col[i].as_py()
                found = base_spans(text)
                every = sorted(found + novel_spans(text, found, novelty, min_bits, reach, min_chars, min_distinct), key=lambda x: (x[0], KINDS.index(x[2])))
                for _, _, kind in every:
                    counts[KINDS.index(kind)][i] += 1
                base[i], both[i] = show(found), show(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(both, pa.string())], schema=schema)

    kinds = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, kinds)


