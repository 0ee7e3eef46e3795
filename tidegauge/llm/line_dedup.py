"""Line dedup in DataFrame expressions only: over content-defined chunks of lines, and over all repeated runs of lines.

`deduplicated` is the chunk form. It removes whole chunks only, so it leaves most repeated passages of a few lines: all
chunks of one line, and the first and last chunk of a passage, which hold lines from outside it. `without_repeats` has no such
gap: it looks at every pair of neighbouring lines with words.

A hash over the hashes of the last two lines, rolling down the text, decides whether a chunk ends after a line. So borders
depend on the lines near them alone, and a passage is cut the same way wherever it stands and whatever was put in before
it. A chunk counts if at least two of its lines have a word. Chunks whose hash occurs more than once are candidates; their
texts are then grouped byte by byte, the first copy (smallest id, then position) stays, and all others are removed.

Only hashes travel in the first pass; texts travel for candidates. Counts are combined before every shuffle, and joins deal the
rows of a hot chunk or pair over many tasks (common.spread_join), so one that a third of the documents share goes to no one task.

A repeated run is made of pairs: a line with words, the next line with words and the blank lines between them. A pair that
occurs more than once (equal SHA-256) is repeated; its first copy (smallest id, then place) stays. A line goes if a repeated
pair covers it and each repeated pair that covers it has an earlier copy. So every run of two or more lines with words that
stands elsewhere is found, wherever it stands and whatever is around it, and the first copy of every pair stays whole.

Defined results: a null text stays null; an empty text has one empty line and stays as it is; a text of which every chunk
goes becomes empty, the document stays; rows that share an id are told apart by nothing, so ids must be unique for their
removals to be right: rows with a repeated or a null id are left unchanged; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A line ends a chunk if the first hexadecimal digit of the rolling hash is below this: 5 of 16, a border in about three lines.
BORDER = "5"


def line_hashes(lines: Column | str) -> Column:
    return F.transform(lines, lambda t: F.md5(t.cast("binary")))


def chunk_ends(hashes: Column | str, border: str) -> Column:
    """Array of the indices of the last lines of the chunks."""
    h = F.col(hashes) if isinstance(hashes, str) else hashes

    def ends(k: Column) -> Column:
        rolling = F.md5(F.concat(F.get(h, k - 1), F.get(h, k)).cast("binary"))
        return (k == F.size(h) - 1) | ((k > 0) & (F.substring(rolling, 1, 1) < border))

    return F.filter(F.sequence(F.lit(0), F.size(h) - 1), ends)


def chunks(docs: DataFrame, border: str = BORDER) -> DataFrame:
    """_id and _chunks: array of (k, text, multi); joined by line feeds they are the text again."""
    x = docs.where("_text IS NOT NULL").select("_id", F.split("_text", "\n", -1).alias("_lines"))
    x = x.select("_id", "_lines", line_hashes("_lines").alias("_h"))
    x = x.select("_id", "_lines", chunk_ends("_h", border).alias("_ends"))

    def one(end: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get("_ends", k - 1) + 1)
        part = F.slice("_lines", start + 1, end - start + 1)
        return F.struct(k.alias("k"), F.array_join(part, "\n").alias("text"), (F.size(F.filter(part, lambda t: t.rlike(r"[^\x20\x09-\x0D]"))) > 1).alias("multi"))

    return x.select("_id", F.transform("_ends", one).alias("_chunks"))


def removals(docs: DataFrame, border: str = BORDER) -> DataFrame:
    """_id and _drop: the sorted indices of the chunks that go, for documents (_id, _text) that lose any."""
    ids = docs.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1 AND _id IS NOT NULL").select("_id")
    twice = C.written(ids, "twice").hint("shuffle_hash")
    multi = lambda d: chunks(d, border).select("_id", F.explode(F.filter("_chunks", lambda c: c["multi"])).alias("c")).select("_id", "c.k", "c.text")
    light = C.written(multi(docs.where("_id IS NOT NULL")).select("_id", "k", F.xxhash64("text").alias("h")), "hashes")
    often = C.written(light.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    hot, often = C.hot_keys(often, "h"), often.select("h")
    candidates = C.written(C.spread_join(light, often, "h", hot).join(twice, "_id", "left_anti").groupBy("_id").agg(F.collect_set("k").alias("ks")), "candidates")
    texts = multi(docs.join(candidates.select("_id").hint("shuffle_hash"), "_id", "left_semi")).withColumn("h", F.xxhash64("text"))
    texts = C.written(C.spread_join(texts, often.hint("shuffle_hash"), "h", hot, "left_semi").select("_id", "k", "text", F.sha2("text", 256).alias("d")), "texts")
    # Grouping by the text itself compares bytes; a digest shared by different texts is not trusted.
    same = texts.groupBy("text", "d").agg(F.min(F.struct("_id", "k")).alias("first"), F.count("*").alias("n"))
    same = C.written(same.groupBy("d").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.sum("n").alias("n")).where("texts = 1 AND n > 1").select("d", "first", "n"), "same")
    drop = C.spread_join(texts.select("_id", "k", "d"), same.drop("n"), "d", C.hot_keys(same, "d")).where("first._id <> _id OR first.k <> k")
    return C.written(drop.groupBy("_id").agg(F.sort_array(F.collect_list("k")).alias("_drop")), "drop")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", border: str = BORDER, removed_col: str | None = None) -> DataFrame:
    """docs with repeated chunks taken out of the text; with removed_col also the number of chunks taken out (long)."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    drop = removals(own, border).hint("shuffle_hash")
    # The text travels once more, to its removals; what is not touched keeps its very text.
    names = docs.columns
    all_ = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    x = all_.join(drop, "_id", "left")
    lines = F.split("_text", "\n", -1)
    x = x.select("_row", "_text", "_drop", F.when(F.col("_drop").isNotNull(), lines).alias("_lines"))
    x = x.select("_row", "_text", "_drop", "_lines", line_hashes("_lines").alias("_h"))
    x = x.select("_row", "_text", "_drop", "_lines", F.when(F.col("_drop").isNotNull(), chunk_ends("_h", border)).alias("_ends"))

    def part(end: Column, k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get("_ends", k - 1) + 1)
        return F.when(~F.array_contains("_drop", k), F.array_join(F.slice("_lines", start + 1, end - start + 1), "\n"))

    kept = F.array_join(F.filter(F.transform("_ends", part), lambda t: t.isNotNull()), "\n")
    x = x.select("_row", F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(kept).alias("_text"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("_n"))
    out = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names]
    return x.select(*out, *([F.col("_n").alias(removed_col)] if removed_col else []))


def line_pairs(docs: DataFrame) -> DataFrame:
    """_id, a, b (first and last line) and text of every pair of neighbouring lines with words of (_id, _text)."""
    x = docs.where("_text IS NOT NULL").select("_id", F.split("_text", "\n", -1).alias("_lines"))
    marks = F.transform("_lines", lambda t, k: F.when(t.rlike(r"[^\x20\x09-\x0D]"), k))
    x = x.select("_id", "_lines", F.filter(marks, lambda k: k.isNotNull()).alias("_w")).where("size(_w) > 1")
    x = x.select("_id", "_lines", F.arrays_zip(F.slice("_w", F.lit(1), F.size("_w") - 1).alias("a"), F.slice("_w", F.lit(2), F.size("_w") - 1).alias("b")).alias("_ab"))
    pair = lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.array_join(F.slice("_lines", p["a"] + 1, p["b"] - p["a"] + 1), "\n").alias("text"))
    return x.select("_id", F.explode(F.transform("_ab", pair)).alias("p")).select("_id", "p.a", "p.b", "p.text")


def repeats(docs: DataFrame) -> DataFrame:
    """_id, _later and _first: arrays of (a, b), the repeated pairs with an earlier copy and the first copies, for documents
    (_id, _text) that have any with an earlier copy."""
    ids = docs.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1 AND _id IS NOT NULL").select("_id")
    twice = C.written(ids, "twice").hint("shuffle_hash")
    light = C.written(line_pairs(docs.where("_id IS NOT NULL")).select("_id", F.xxhash64("text").alias("h")), "hashes")
    often = C.written(light.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    hot, often = C.hot_keys(often, "h"), often.select("h")
    candidates = C.written(C.spread_join(light, often, "h", hot).join(twice, "_id", "left_anti").select("_id").distinct(), "candidates")
    pairs = line_pairs(docs.join(candidates.hint("shuffle_hash"), "_id", "left_semi")).withColumn("h", F.xxhash64("text"))
    pairs = C.written(C.spread_join(pairs, often.hint("shuffle_hash"), "h", hot, "left_semi").select("_id", "a", "b", F.unhex(F.sha2("text", 256)).alias("d")), "pairs")
    same = pairs.groupBy("d").agg(F.count("*").alias("n"), F.min(F.struct("_id", "a")).alias("first"))
    same = C.written(same.where("n > 1"), "same")
    found = C.spread_join(pairs, same.drop("n"), "d", C.hot_keys(same, "d")).select("_id", F.struct("a", "b").alias("p"), (F.col("first") == F.struct("_id", "a")).alias("is_first"))
    found = found.groupBy("_id").agg(F.collect_list(F.when(~F.col("is_first"), F.col("p"))).alias("_later"), F.collect_list(F.when(F.col("is_first"), F.col("p"))).alias("_first"))
    return C.written(found.where("size(_later) > 0"), "repeats")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """docs without the later copies of repeated runs of lines; with removed_col also the number of lines taken out (long)."""
    names = docs.columns
    found = repeats(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))).hint("shuffle_hash")
    x = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(found, "_id", "left")
    x = x.select("_row", "_text", "_later", "_first", F.when(F.col("_later").isNotNull(), F.split("_text", "\n", -1)).alias("_lines"))
    covered = lambda c: F.flatten(F.transform(c, lambda p: F.sequence(p["a"], p["b"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.array_except(covered("_later"), covered("_first")))
    x = x.select("_row", "_text", "_lines", F.when(F.col("_lines").isNotNull(), stay).alias("_stay"))
    kept = F.array_join(F.transform("_stay", lambda k: F.get("_lines", k)), "\n")
    x = x.select("_row", F.when(F.col("_lines").isNull(), F.col("_text")).otherwise(kept).alias("_text"), F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines") - F.size("_stay")).cast("long").alias("_n"))
    out = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names]
    return x.select(*out, *([F.col("_n").alias(removed_col)] if removed_col else []))
