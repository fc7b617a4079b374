"""Quality rules (DataFrame functions only): whole-text measures, and lines that stand in too many documents of a host.

Lines with a word are normalised (lower case, digits as 0, white space as one space) and hashed; the documents (rows) that hold a
line are counted host by host. A line in more than `max_docs` documents of a host is removed wherever that host has it; a document
that loses over `max_removed` of its words is depleted and rejected. The limit is a count, the same at every size of the host.

Scale: texts are read once; measures and line hashes are a table in the shared folder, some 4 % of the text. Counting is one hash
aggregation with partial sums, so a line that a third of all documents share arrives as one row from each task; the table of removed
lines is measured and broadcast, or else dealt with salt (sized_join). Only line hashes and row numbers are shuffled; texts are only
where the table of documents to change is too large to broadcast.

Defined cases: null text has no words and fails the base rules; a null source is a host of its own; repeated rows are documents of
their own and get equal verdicts; no word, no line: nothing to count; an empty table gives no rows. Input columns other than doc_id,
text and source are never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import WORD, WS, scratch, sized_join, stored

_HIGH = -(1 << 32)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def measures(docs: DataFrame, text: str, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds the whole-text measures and __lines (place, hash and words of each line with a word). Repeated windows: 3-word windows
    are hashed and sorted with their position in the low bits; equal neighbours are candidates, which are then compared by their full
    64-bit hashes. Linear but for sorting."""
    get = lambda a, i: F.get(F.col(a), i)
    out = docs.withColumn("__w", words(F.col(text))).withColumn("__l", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    out = out.withColumn("__n", F.size("__w").cast("long"))
    marked = F.transform("__l", lambda x, i: F.struct(i.cast("int").alias("at"), F.when(x.rlike(WORD), _line_hash(x)).alias("hash"), F.size(words(x)).alias("words")))
    out = out.withColumn("__lines", F.filter(marked, lambda x: x["words"] > 0)).withColumn("__l", F.filter("__l", lambda x: x.rlike(WORD)))
    hashed = F.transform(F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, get("__w", i + 1), get("__w", i + 2)))
    out = out.withColumn("__t", hashed)
    out = out.withColumn("__s", F.sort_array(F.transform("__t", lambda h, i: h.bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("long")))))
    top = lambda x: F.shiftright(x, 32)
    near = F.filter("__s", lambda x, i: F.coalesce(top(x) == top(get("__s", i - 1)), F.lit(False)) | F.coalesce(top(x) == top(get("__s", i + 1)), F.lit(False)))
    out = out.withColumn("__c", near)
    place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    out = out.withColumn("__e", F.sort_array(F.transform("__c", lambda x: F.struct(get("__t", place(x)).alias("h"), place(x).alias("p")))))
    same = F.filter("__e", lambda x, i: F.coalesce(x["h"] == get("__e", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == get("__e", i + 1)["h"], F.lit(False)))
    out = out.withColumn("__p", F.transform(same, lambda x: x["p"]))
    covered = F.size(F.array_union(F.array_union("__p", F.transform("__p", lambda p: p + 1)), F.transform("__p", lambda p: p + 2)))
    failed = (F.col("__n") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("__n"))
    return (
        out.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_repeat_words", covered.cast("long"))
        .withColumn("base_failed", failed)
        .drop("__w", "__t", "__s", "__c", "__e", "__p", "__l")
    )


def _line_hash(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), f"{WS}+", " ")
    return F.xxhash64(F.btrim(plain))


def _lost(measured: DataFrame, folder: str, max_docs: int) -> DataFrame:
    """__id, __lost (words on removed lines) and __gone (places of these lines) for each row of measured(__id, __host, __lines) that
    has some, as a table."""
    each = measured.select("__host", F.explode(F.array_distinct(F.transform("__lines", lambda x: x["hash"]))).alias("__hash"))
    over = each.groupBy("__host", "__hash").agg(F.count("*").alias("__docs")).where(F.col("__docs") > max_docs)
    over = stored(over.select("__host", "__hash"), folder, "over")
    lines = measured.select("__id", "__host", F.explode("__lines").alias("__x")).select("__id", "__host", "__x.at", F.col("__x.hash").alias("__hash"), "__x.words")
    hit = sized_join(lines, over, ["__host", "__hash"], "inner")
    return stored(hit.groupBy("__id").agg(F.sum("words").alias("__lost"), F.collect_list("at").alias("__gone")), folder, "lost")


def _measured(docs: DataFrame, folder: str, keep: list[Column], min_words: int, max_repeat_percent: int) -> DataFrame:
    """A table with __id (the row's number), __host, the columns `keep` and the measures of docs(text, source)."""
    host = F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n"))
    own = docs.select(F.monotonically_increasing_id().alias("__id"), host.alias("__host"), docs["text"].alias("__text"), *keep)
    return stored(measures(own, "__text", min_words, max_repeat_percent).drop("__text"), folder, "measured")


def quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_docs: int = 100, max_removed: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words for each row."""
    folder = scratch(docs.sparkSession, "quality")
    base = _measured(docs, folder, [docs["doc_id"]], min_words, max_repeat_percent)
    lost = _lost(base, folder, max_docs)
    out = sized_join(base.drop("__lines", "__host"), lost.drop("__gone"), ["__id"], "left", salts=1).withColumnRenamed("__n", "n_words")
    removed = F.coalesce("__lost", F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (removed <= F.col("n_words") * max_removed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), removed.alias("removed_words"))


def clean(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_docs: int = 100, max_removed: float = 0.5) -> DataFrame:
    """The kept rows with the columns of docs; text without the removed lines, and n_chars, where there is one, to match. Rows and
    measures are a table first: a filter over the measures would be planned with copies of all of them."""
    names = docs.columns
    folder = scratch(docs.sparkSession, "quality")
    whole = _measured(docs, folder, [F.struct(*[docs[f"`{c}`"] for c in names]).alias("__doc")], min_words, max_repeat_percent)
    lost = _lost(whole, folder, max_docs)
    out = sized_join(whole.where("not base_failed").select("__id", "__doc", "__n"), lost, ["__id"], "left", salts=1)
    out = out.where(F.coalesce("__lost", F.lit(0)) <= F.col("__n") * max_removed)
    text = F.col("__doc")["text"]
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    changed = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    out = out.withColumn("__text", F.when(F.col("__gone").isNull(), text).otherwise(changed))
    n_chars = lambda: F.when(F.col("__gone").isNull(), F.col("__doc")["n_chars"]).otherwise(F.length("__text").cast("long"))
    return out.select(*[(F.col("__text") if c == "text" else n_chars() if c == "n_chars" else F.col("__doc")[c]).alias(c) for c in names])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, text AS raw, source FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
t AS (SELECT rid, unnest(range(1, len(w) - 1)) AS p, w FROM w),
g AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS n FROM t),
r AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, source, l FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS l FROM d WHERE raw IS NOT NULL) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
u AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM l GROUP BY rid),
m AS (SELECT rid, source, trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l),
o AS (SELECT source, l FROM m GROUP BY source, l HAVING count(DISTINCT rid) > 100),
x AS (SELECT m.rid, sum(m.n) AS removed FROM m JOIN o ON m.source IS NOT DISTINCT FROM o.source AND m.l = o.l GROUP BY m.rid),
b AS (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN u USING (rid) LEFT JOIN x USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_words <= n_words * 0.5 AS kept, removed_words FROM v
"""
