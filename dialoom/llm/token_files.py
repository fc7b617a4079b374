"""Token-ID / binary output: flat files of unsigned integers with 64-bit document offsets, read back by memory mapping.

A dataset is a folder with, for each part p: p.bin (ids of all its documents, little-endian, 16 bits where the vocabulary fits,
else 32), p.off (n + 1 signed 64-bit offsets, in ids, within the part), p.ids (n signed 64-bit document ids), and one
manifest.json with each part's file stem, counts and base. A part's base is the prefix sum of the ids of all parts before it,
so a document's global offset is base + local offset. Parts follow ascending doc_id.

Recovery: a task writes under a name of its own attempt and renames when complete; only the names that come back from
successful tasks enter the manifest, so a lost executor costs a rewrite of its parts and never a wrong file.

Defined cases: null text counts as empty (only the end id); null doc_id sorts first and comes back null; rows with equal
doc_id are ordered by text; an empty table gives a manifest without parts and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.common import partitions, passing_shuffles, scratch, small_batches, texts, vocabulary
from dialoom.llm.token_counts import byte_letters

#: Words of a worker's memory; beyond it the memory is emptied. Longer words are encoded anew each time.
CACHE_WORDS, CACHE_LETTERS = 500_000, 40
_CONTROLS = re.compile("[\x1c-\x1f]")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes by white-space separated words with a bounded memory of their ids. For vocabularies whose pre-tokenizer drops
    white space, no token spans it, so the words' ids in order are exactly the library's ids for the text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.cache: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, core: str) -> bytes:
        """The packed ids of normalised letters: one pre-token, so the model is asked at once."""
        found = self.cores.get(core)
        if found is None:
            found = self.pack([x.id for x in self.model.tokenize("".join([self.letters[b] for b in core.encode()]))])
            if len(core) <= CACHE_LETTERS:
                self.cores[core] = found
        return found

    def _miss(self, word: str) -> bytes:
        """Marks after letters are a pre-token of their own, so both parts are remembered apart."""
        core = word.rstrip(".,;:!?")
        plain = core.lower() if core.isascii() else self.tokenizer.normalizer.normalize_str(core) if core.isalpha() else ""
        if plain.isalpha() and max(plain) < "\u0250":
            found = self._word(plain) + (self._marks(word[len(core) :]) if len(core) < len(word) else b"")
        else:
            found = self.pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHE_LETTERS:
            self.cache[word] = found
        return found

    def _marks(self, marks: str) -> bytes:
        return self.cache.get(marks) or self._miss(marks)

    def encode_many(self, batch: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        get, miss, out = self.cache.get, self._miss, []
        for x in batch:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            if len(self.cores) > CACHE_WORDS:
                self.cores.clear()
            out.append(b"".join([get(w) or miss(w) for w in (x.split() if not _CONTROLS.search(x) else [x])]))
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _put(fs: pafs.FileSystem, path: str, chunks: list[bytes]) -> None:
    with fs.open_output_stream(f"{path}.part") as f:
        for x in chunks:
            f.write(x)
    fs.move(f"{path}.part", path)


def write_tokens(docs: DataFrame, folder: str, vocab: str, end_id: int = 1, parts: int | None = None) -> dict:
    """Encodes the whole texts of docs(doc_id, text) into a dataset in `folder` (a URI all executors reach) and returns its
    manifest. vocab: the name of a vocabulary file that drops white space; end_id closes each document."""
    spark = docs.sparkSession
    small_batches(spark)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary(vocab))
        end = enc.pack([end_id])
        fs, root = pafs.FileSystem.from_uri(folder)
        stem = f"part-{uuid.uuid4().hex}"
        ids, sizes, first, last, nulls = [], [], None, None, 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{root}/{stem}.bin.part")
            col = batch.column(0)
            nulls += col.null_count
            keys = col.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            packed = [x + end for x in enc.encode_many(texts(batch).to_pylist())]
            out.write(b"".join(packed))
            sizes.append(np.fromiter(map(len, packed), np.int64, len(packed)) // enc.dtype.itemsize)
            ids.append(keys)
            known = col.drop_null()
            if len(known):
                first, last = known[0].as_py() if first is None else first, known[-1].as_py()
        if out is None:
            return
        out.close()
        fs.move(f"{root}/{stem}.bin.part", f"{root}/{stem}.bin")
        n = np.concatenate(sizes)
        off = np.zeros(len(n) + 1, "<i8")
        np.cumsum(n, out=off[1:])
        _put(fs, f"{root}/{stem}.off", [off.tobytes()])
        _put(fs, f"{root}/{stem}.ids", [x.tobytes() for x in ids])
        row = {"stem": stem, "width": enc.dtype.itemsize, "docs": len(n), "nulls": nulls, "tokens": int(off[-1]), "first": first, "last": last}
        yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("stem", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    kinds = "stem string, width int, docs long, nulls long, tokens long, first long, last long"
    # One row for each part, so the manifest is bounded by the number of partitions; parts hold disjoint ranges of doc_id.
    with passing_shuffles(spark):
        dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts or partitions(spark), "doc_id")
        found = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(encode, kinds).collect()
    kept = {r["stem"] for r in found}
    for info in fs.get_file_info(pafs.FileSelector(root)):  # what failed attempts have left
        if info.base_name.startswith("part-") and info.base_name.split(".")[0] not in kept:
            fs.delete_file(info.path)
    found.sort(key=lambda r: (r["first"] is not None, r["first"] or 0))
    manifest = {"vocabulary": vocab, "end_id": end_id, "parts": []}
    base = base_doc = 0
    for r in found:
        manifest["parts"].append(r.asDict() | {"base": base, "base_doc": base_doc})
        base, base_doc = base + r["tokens"], base_doc + r["docs"]
    manifest |= {"tokens": base, "docs": base_doc}
    _put(fs, f"{root}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def _mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_document(folder: str, k: int) -> np.ndarray:
    """The ids of the k-th document of the dataset, counted from 0 in ascending doc_id."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    p = next(p for p in parts if p["base_doc"] <= k < p["base_doc"] + p["docs"])
    off = _mapped(fs, f"{root}/{p['stem']}.off", "<i8")
    k -= p["base_doc"]
    return _mapped(fs, f"{root}/{p['stem']}.bin", f"<u{p['width']}")[off[k] : off[k + 1]].astype(np.uint32)


def read_tokens(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """A row for each document as the files have it: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32 bits)."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for p in batch.to_pylist():
                off = _mapped(fs, f"{root}/{p['stem']}.off", "<i8")
                ids = _mapped(fs, f"{root}/{p['stem']}.ids", "<i8")
                data = _mapped(fs, f"{root}/{p['stem']}.bin", f"<u{p['width']}")
                for i in range(0, len(ids), 5000):
                    o = np.asarray(off[i : i + 5001])
                    block = data[o[0] : o[-1]].astype("<u4").view(np.uint8).data
                    o4 = ((o - o[0]) * 4).tolist()
                    crc = [zlib.crc32(block[a:b]) for a, b in zip(o4, o4[1:], strict=False)]
                    null = np.arange(i, i + len(crc)) < p["nulls"]  # nulls sort first
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 5000], mask=null), pa.array(o[:-1] + p["base"]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], schema=out)

    rows = [(p["stem"], p["width"], p["nulls"], p["base"]) for p in manifest["parts"]]
    return spark.createDataFrame(rows, "stem string, width int, nulls long, base long").repartition(max(1, len(rows))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the dataset (in the shared folder unless a place is given) and returns read_tokens() of it."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, vocab, end_id))
