"""MinHash near-dedup with fast similarity sketching: banding finds candidates, full shingle sets confirm them, linked documents
form components.

Sketch: `bands * rows` bins. In round i each shingle falls into a hashed bin with a hashed value, rounds rank before values, and
each bin keeps its least. Rounds go on until every bin is filled; after `ROUNDS` of them all shingles go to each bin left. So every
coordinate fills, and two sketches agree in each coordinate with probability equal to the similarity, with the concentration of
independent draws. With 40 bands of 5 rows, documents as similar as 0.8 share a bucket with probability 1 - 1.3e-7.

Pairs: documents with the same shingle set are one class (64-bit set hash), so copies are never compared. In each bucket, classes of
other components are compared with one member of the bucket's largest component (`star_rounds` times: first with the member whose
buckets are fullest, which of an original and its edited copies is the original, then with another each time); labels join those
found linked. What is left in a bucket after that, classes outside its largest component, is paired with all members of other
components, once for each pair (in the first band that they share) and only if sketches say that it may be a link: `CHECKS` more
coordinates serve this, drawn for these classes alone, 4 bits of each, and a pair is passed over if its agreement is `sigmas`
standard deviations under that of the least link (5: a chance of 3e-7 for one exactly at the threshold; None: none is passed
over). Whatever is not passed over is compared in full.

Classes are named by 64 bits of a 128-bit set hash; where two classes share the 64 bits, they get other names.

Scale: sketches, buckets and candidate texts are tables in the shared folder, each removed once the last table made from it is
written; hot buckets and hot classes are reduced by partial aggregation and joined with skew handling or broadcast after their
bytes are measured; components are found by alternating large-star and small-star steps on tables. Nothing of documents, links or
components goes to the driver.

Defined cases: without words or text a document has no shingles and is linked with nothing; with fewer than k words the whole
sequence is one shingle; null doc_id counts as larger than all others; equal rows are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import drop, gathered, scratch, sized_join, small_batches, stored, texts
from dialoom.llm.kernel import Words, mix

ROUNDS = 120
#: Coordinates beside those of the bands in the estimate that a pair must pass.
CHECKS = 400
_U = np.uint64


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    w = Words(col)
    h = w.hashes(lower=True)
    full, _ = w.windows(h, k)
    out = []
    short = {n: w.windows(h, n)[0] for n in range(1, k)} if (np.diff(w.first) < k).any() else {}
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(full[a : b - k + 1]) if n >= k else short[n][a : a + 1] if n else full[:0])
    return out


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The least (round, value) of each bin."""
    out = np.full(bins, ~_U(0))
    n = len(shingles)
    i = 0
    while i < ROUNDS:
        more = min(ROUNDS - i, max(1, int(bins * 1.5 / n)) if i else max(1, int(bins * 6 / n)))
        rounds = np.arange(i, i + more, dtype=_U)
        x = mix(shingles[None, :] ^ (rounds[:, None] + _U(1)) * _U(0x9E3779B97F4A7C15))
        np.minimum.at(out, (x % _U(bins)).astype(np.int64).ravel(), (rounds[:, None] << _U(57) | x >> _U(7)).ravel())
        i += more
        if out.max() < ~_U(0):
            return out
    for b in np.flatnonzero(out == ~_U(0)).tolist():
        out[b] = _U(ROUNDS) << _U(57) | mix(shingles ^ _U((b + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)).min() >> _U(7)
    return out


def band_hashes(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = coordinates.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)
    for j in range(rows):
        out = mix(out ^ x[:, j])
    return out.view(np.int64)


def nibbles(coordinates: np.ndarray) -> np.ndarray:
    """4 bits of each coordinate, 16 coordinates in a number; the last is filled up with zeros."""
    x = np.zeros(-(-len(coordinates) // 16) * 16, _U)
    x[: len(coordinates)] = mix(coordinates) & _U(15)
    return np.bitwise_or.reduce(x.reshape(-1, 16) << (_U(4) * np.arange(16, dtype=_U)), axis=1).view(np.int64)


def may_link(a: str, b: str, percent: int, coordinates: int, sigmas: float | None):
    """Whether the 4-bit sketches in columns a and b differ in no more coordinates than those of a link can."""
    if sigmas is None:
        return F.lit(True)
    p = percent / 100 + (1 - percent / 100) / 16
    most = int(coordinates * (1 - p + sigmas * (p * (1 - p) / coordinates) ** 0.5)) + 1
    ones = F.lit(0x1111111111111111)

    def differ(x):
        half = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(half.bitwiseOR(F.shiftrightunsigned(half, 2)).bitwiseAND(ones))

    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda s, x: s + differ(x)) <= most


def _set_hash(shingles: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits of a hash of the set, None for the empty one."""
    if not len(shingles):
        return None, None
    return tuple(int(mix(shingles ^ _U(salt)).sum().view(np.int64)) for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, __row (a hash of the row), __n (set size), __class and __check (a hash of the set, null for the empty one), __bands."""
    small_batches(docs.sparkSession)
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "__row", "__n", "__class", "__check")), ("__bands", pa.list_(pa.int64()))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 4 << 20):
            sets = shingle_sets(texts(batch), k)
            named = [_set_hash(s) for s in sets]
            found = [band_hashes(sketch(s, bands * rows), bands, rows) if len(s) else [] for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*named, strict=True)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], schema=schema)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("__row"))
    return own.mapInArrow(make, "doc_id long, __row long, __n long, __class long, __check long, __bands array<long>")


def _drawn(data: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """__class, __bands and __bits (4 bits of each coordinate, those of the bands and CHECKS more) of data(__class, __data)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in gathered(batches, 1 << 20):
            raw = pa.array([z.decompress(x.as_py()) for x in batch.column(1)], pa.large_binary()).view(pa.large_string())
            sets = shingle_sets(raw, k)
            found = [band_hashes(sketch(s, bands * rows), bands, rows) for s in sets]
            bits = [nibbles(sketch(s, bands * rows + CHECKS)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["__class", "__bands", "__bits"])

    return data.select("__class", "__data").mapInArrow(draw, "__class long, __bands array<long>, __bits array<long>")


def _candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """__class and compressed text for wanted(__row, __class)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [c.compress(x.encode()) for x in texts(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["__class", "__data"])

    own = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("__row"), "text")
    rows = sized_join(own, wanted, ["__row"], "inner", salts=1).select("__class", "text")
    return rows.mapInArrow(pack, "__class long, __data binary")


def confirmed(pairs: DataFrame, data: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets are as similar as `percent` of 100."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        for batch in gathered(batches, 2 << 20):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw: dict[int, bytes] = {}
            for ids, col in ((a, 2), (b, 3)):
                for i, x in zip(ids, batch.column(col), strict=True):
                    if i not in raw:
                        raw[i] = z.decompress(x.as_py())
            at = {i: n for n, i in enumerate(raw)}
            sets = shingle_sets(pa.array(list(raw.values()), pa.large_binary()).view(pa.large_string()), k)
            keep = []
            for x, y in zip(a, b, strict=True):
                s, t = sets[at[x]], sets[at[y]]
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(data.select(F.col("__class").alias("a"), F.col("__data").alias("__x")), "a")
    two = one.join(data.select(F.col("__class").alias("b"), F.col("__data").alias("__y")), "b")
    return two.select("a", "b", "__x", "__y").mapInArrow(check, "a long, b long")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node, root (the least node reachable) for edges(a, b), by alternating large-star and small-star steps until nothing changes.
    Each step is a table; the one before goes when the next is written."""
    spark = edges.sparkSession
    step = 0
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), folder, f"{name}-0")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        following = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        e = stored(following.union(small.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{step}")
        drop(spark, f"{folder}/{name}-{step - 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def _ratio(percent: int):
    """Sets can only be so similar if their sizes are."""
    return 100 * F.least("__n", "__m") >= percent * F.greatest("__n", "__m")


def links(buckets: DataFrame, data: DataFrame, folder: str, k: int, percent: int, bands: int, rows: int, star_rounds: int, sigmas: float | None) -> DataFrame:
    """Confirmed edges(a, b) that connect every component, for buckets(__bucket, __band, __class, __n, __full) and
    data(__class, __data)."""
    spark = buckets.sparkSession
    label = None
    edges = None
    tested = None
    for r in range(star_rounds + 1):
        now = buckets if label is None else sized_join(buckets, label, ["__class"], "left", salts=8)
        now = now.withColumn("__c", F.coalesce("__c", "__class") if label is not None else F.col("__class"))
        # the member of each component that serves as its centre in this round
        order = F.col("__full") if r == 0 else F.xxhash64("__class", F.lit(r))
        centre = F.max(F.struct(order.alias("h"), F.col("__class").alias("i"), F.col("__n").alias("n")))
        by = now.groupBy("__bucket", "__c").agg(F.count("*").alias("__k"), centre.alias("__at"))
        main = by.groupBy("__bucket").agg(F.max(F.struct("__k", F.col("__at.h").alias("h"), F.col("__c").alias("c"), "__at")).alias("__top"), F.count("*").alias("__cs")).where("__cs > 1")
        main = main.select("__bucket", F.col("__top.c").alias("__main"), F.col("__top.__at.i").alias("__i"), F.col("__top.__at.n").alias("__m"))
        rest = now.join(main, "__bucket").where("__c <> __main")
        if r < star_rounds:
            pairs = rest.where(_ratio(percent)).select(F.col("__class").alias("a"), F.col("__i").alias("b")).distinct()
        else:  # what the stars have left
            rest = stored(rest.select("__bucket", "__band", "__class", "__c", "__main", "__n"), folder, "rest")
            other = now.select("__bucket", F.col("__class").alias("__j"), F.col("__c").alias("__d"), F.col("__n").alias("__m"))
            other = stored(other.join(rest.select("__bucket").distinct(), "__bucket", "left_semi"), folder, "other")
            needed = rest.select("__class").union(other.select("__j")).distinct()
            drawn = stored(_drawn(data.join(needed, "__class", "left_semi"), k, bands, rows), folder, "drawn")
            other = other.join(drawn.select(F.col("__class").alias("__j"), F.col("__bands").alias("__bands2"), F.col("__bits").alias("__bits2")), "__j")
            first = ~F.arrays_overlap(F.slice("__bands", F.lit(1), F.col("__band")), F.slice("__bands2", F.lit(1), F.col("__band")))
            wanted = (F.col("__c") != F.col("__d")) & ((F.col("__d") == F.col("__main")) | (F.col("__class") < F.col("__j"))) & _ratio(percent)
            wanted = wanted & may_link("__bits", "__bits2", percent, bands * rows + CHECKS, sigmas) & first
            left = rest.join(drawn, "__class").alias("x").join(other.alias("y"), (F.col("x.__bucket") == F.col("y.__bucket")) & wanted)
            pairs = left.select(F.col("__class").alias("a"), F.col("__j").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, folder, f"pairs-{r}")
        good = stored(confirmed(pairs, data, k, percent), folder, f"links-{r}")
        tested = pairs if tested is None else tested.union(pairs)
        edges = good if edges is None else edges.union(good)
        if r < star_rounds:
            label = stored(components(edges, folder, f"step-{r}").select(F.col("node").alias("__class"), F.col("root").alias("__c")), folder, f"label-{r}")
    for name in ("rest", "other", "drawn", *(f"pairs-{r}" for r in range(star_rounds + 1)), *(f"label-{r}" for r in range(star_rounds))):
        drop(spark, f"{folder}/{name}")
    return edges


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, star_rounds: int = 2, sigmas: float | None = 5.0) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept (doc_id = component_id) and __row (xxhash64 of doc_id and
    text) for each row of docs(doc_id, text)."""
    return _labelled(docs, scratch(docs.sparkSession, "near"), k, percent, bands, rows, star_rounds, sigmas).drop("__root")


def _classes(rows: DataFrame) -> DataFrame:
    own = rows.where("__class is not null").groupBy("__class")
    return own.agg(F.min("doc_id").alias("__min"), F.min("__row").alias("__row"), F.max("__n").alias("__n"), F.count("*").alias("__docs"), F.min("__check").alias("__low"), F.max("__check").alias("__high"))


def _labelled(docs: DataFrame, folder: str, k: int, percent: int, bands: int = 40, rows: int = 5, star_rounds: int = 2, sigmas: float | None = 5.0) -> DataFrame:
    """near_duplicates with __root, the component of the row's text (its least class; null where there are no shingles)."""
    spark = docs.sparkSession
    base = stored(sketches(docs, k, bands, rows), folder, "sketches")
    classes = stored(_classes(base), folder, "classes")
    clash = classes.where("__low <> __high").select("__class", F.lit(True).alias("__clash"))
    if not clash.isEmpty():  # different sets share 64 bits: name them by all 128
        named = sized_join(base, clash, ["__class"], "left", salts=1)
        named = named.withColumn("__class", F.when(F.col("__clash"), F.xxhash64("__class", "__check")).otherwise(F.col("__class")))
        base = stored(named.select(*base.columns), folder, "named")
        classes = stored(_classes(base), folder, "classes-named")
    spread = base.where("__class is not null").groupBy("__class").agg(F.max("__n").alias("__n"), F.first("__bands").alias("__bands"))
    spread = stored(spread, folder, "bands").select("__class", "__n", F.posexplode("__bands").alias("__band", "__bucket"))
    own = stored(base.select("doc_id", "__row", "__n", "__class"), folder, "rows")
    for name in ("sketches", "named"):
        drop(spark, f"{folder}/{name}")
    shared = stored(spread.groupBy("__bucket").agg(F.count("*").alias("__size")).where("__size > 1"), folder, "shared")
    buckets = stored(sized_join(spread, shared, ["__bucket"], "inner", salts=1).select("__bucket", "__band", "__class", "__n", "__size"), folder, "crowded")
    for name in ("bands", "shared"):
        drop(spark, f"{folder}/{name}")
    full = stored(buckets.groupBy("__class").agg(F.sum("__size").alias("__full")), folder, "full")
    buckets = stored(sized_join(buckets.drop("__size"), full, ["__class"], "inner", salts=1), folder, "buckets")
    wanted = stored(classes.join(full.select("__class"), "__class", "left_semi").select("__row", "__class"), folder, "wanted")
    data = stored(_candidate_texts(docs, wanted).dropDuplicates(["__class"]), folder, "texts")
    for name in ("crowded", "full"):
        drop(spark, f"{folder}/{name}")
    edges = links(buckets, data, folder, k, percent, bands, rows, star_rounds, sigmas)
    found = stored(components(edges, folder, "step").withColumnRenamed("node", "__class"), folder, "found")
    for name in ("buckets", "texts", "wanted", *(f"links-{r}" for r in range(star_rounds + 1))):
        drop(spark, f"{folder}/{name}")
    # Only classes with copies or links differ from their document itself.
    few = classes.select("__class", "__min", "__docs").join(found, "__class", "left").where("root is not null or __docs > 1")
    few = stored(few.withColumn("root", F.coalesce("root", "__class")), folder, "few")
    least = stored(few.groupBy("root").agg(F.min("__min").alias("__id")), folder, "least")
    side = stored(sized_join(few.select("__class", "root"), least, ["root"], "inner", salts=8).select("__class", "root", "__id"), folder, "side")
    for name in ("classes", "classes-named", "found", "few", "least"):
        drop(spark, f"{folder}/{name}")
    out = sized_join(own.withColumnRenamed("__n", "n_shingles"), side, ["__class"], "left", salts=8)
    component = F.coalesce("__id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "__row", F.coalesce("root", "__class").alias("__root"))


def kept_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of texts, the one with the least doc_id (null is largest), with the columns of docs; rows without
    shingles are linked with nothing and all stay."""
    folder = scratch(docs.sparkSession, "near")
    found = _labelled(docs, folder, k, percent)
    own = found.where("__root is not null").groupBy("__root", "__row", "doc_id").agg(F.count("*").alias("__times"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row", "__times"))
    keep = own.groupBy("__root").agg(first.alias("__first")).select(F.col("__first.__row").alias("__dl_row"), (F.col("__first.__times") > 1).alias("__dl_more"))
    alone = found.where("__root is null").select(F.col("__row").alias("__dl_row"), F.lit(False).alias("__dl_more")).distinct()
    keep = stored(keep.union(alone), folder, "keep")
    for name in ("rows", "side"):
        drop(docs.sparkSession, f"{folder}/{name}")
    keyed = docs.withColumn("__dl_row", F.xxhash64(docs["doc_id"].cast("long"), docs["text"]))
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = sized_join(keyed, keep.where("not __dl_more").select("__dl_row"), ["__dl_row"], "inner", salts=1).select(*names)
    more = keep.where("__dl_more").select("__dl_row")
    if more.isEmpty():
        return once
    # of equal rows one stays
    return once.union(sized_join(keyed, more, ["__dl_row"], "inner", salts=1).dropDuplicates(["__dl_row"]).select(*names))
