"""Line dedup by content-defined chunks of lines.

A window rolls over the lines with content: every ``MIN_LINES`` of them in a row, with the blank lines
between, are a chunk, wherever they stand. A chunk that occurs again anywhere is removed, except at its
first place (smallest id, then position), after its bytes were compared with those of all its copies.
Chunks overlap, so a repeated passage is covered from its first line to its last, whatever stands around it.

Boundaries picked by a rolling hash, as the method has it, lose short passages: a passage's first and last chunk reach
into what stands around it, and passages of 5 lines were missed wholly in 90 % of cases. So every window position is a
boundary here, the densest choice, at which a repeated passage of two lines and more is found whatever its place.

Only DataFrame functions: lines stay in arrays inside their row, chunks leave the row as 16-byte digests,
and texts are shuffled twice, to compare bytes and to write the rest.

Defined results: a line of blanks, tabs and carriage returns has no content; a null text stays null, an empty one empty; a text whose lines all go becomes empty;
rows equal in id and text are one document read twice and get the same result (they do not remove each
other's chunks); a class whose bytes differ (a digest collision) is left alone; null ids come first;
a line goes where it stands in a later place of any chunk; a copy that overlaps the chunk's first place
(a line that follows itself) leaves that place's lines; the other columns of a document are passed through
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablevault.llm.common import cut, row_key

MIN_LINES = 2
#: White space within a line; a line of nothing else has no content (texts with CR LF ends have such lines too).
BLANKS = " \t\r\x0b\x0c"


def _part(start: Column, end: Column) -> Column:
    """The text of a row's lines from ``start`` to ``end``."""
    return F.array_join(F.slice("lines", start + 1, end - start + 1), "\n")


def chunks(docs: DataFrame, id_col: str, text_col: str, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per ``min_lines`` lines with content in a row: key, id, first and last line, digest."""
    df = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"),
                     F.split(F.col(text_col).cast("string"), "\n", -1).alias("lines")).filter(F.size("lines") >= min_lines)
    df = df.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("lines") - 1),
                                      lambda i: F.length(F.btrim(F.col("lines")[i], F.lit(BLANKS))) > 0))
    ends = F.slice("at", min_lines, F.greatest(F.size("at") - min_lines + 1, F.lit(0)))
    df = df.withColumn("found", F.transform(ends, lambda e, k: F.struct(
        F.col("at")[k].alias("start"), e.alias("end"),
        F.unhex(F.md5(_part(F.col("at")[k], e).cast("binary"))).alias("digest"))))
    # an outer explode: for a plain one Spark infers a filter on the array and evaluates all of the above in it
    df = df.select("key", "id", F.explode_outer("found").alias("c")).filter(F.col("c").isNotNull())
    return df.select("key", "id", "c.start", "c.end", "c.digest")


def _by_document(places: DataFrame) -> DataFrame:
    """Per document key its places in page order; equal rows' places merge before the shuffle."""
    return places.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end", "digest"))).alias("places"))


def repeated(docs: DataFrame, id_col: str, text_col: str, min_lines: int = MIN_LINES) -> DataFrame:
    """Places (key, start, end, digest) of every chunk that stands elsewhere too, but for its first place."""
    found = cut(chunks(docs, id_col, text_col, min_lines))
    # sums are cut before joins: with plain exchanges on both sides Spark splits a hot class or document
    classes = cut(found.groupBy("digest")
                  .agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "start", "end")).alias("first"))
                  .filter("n > 1"))
    places = cut(found.join(classes, "digest"))
    texts = docs.select(row_key(id_col, text_col).alias("key"),
                        F.split(F.col(text_col).cast("string"), "\n", -1).alias("lines"))
    parts = F.transform("places", lambda p: F.struct(p["digest"].alias("digest"), _part(p["start"], p["end"]).alias("bytes")))
    # one plan at every size: texts always meet the places in a merge join
    copies = (texts.join(cut(_by_document(places)).hint("merge"), "key").select(F.explode_outer(parts).alias("p"))
              .filter(F.col("p").isNotNull()).select("p.digest", "p.bytes"))
    same = cut(copies.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
               .filter(F.col("low") == F.col("high")).select("digest"))
    later = places.filter(~(F.struct("id", "key", "start", "end").eqNullSafe(F.col("first"))))
    overlaps = (F.col("key") == F.col("first.key")) & (F.col("start") <= F.col("first.end"))
    later = later.withColumn("start", F.when(overlaps, F.col("first.end") + 1).otherwise(F.col("start")))
    return later.join(same, "digest", "left_semi").select("key", "start", "end", "digest")


STATS = ("n_lines", "n_removed", "n_chunks")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES,
                    stats: bool = False) -> DataFrame:
    """``docs`` with the rest of each text; with ``stats`` also the columns of ``STATS``."""
    places = _by_document(repeated(docs, id_col, text_col, min_lines))
    every = F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["end"])))
    gone = cut(places.select("key", F.array_distinct(every).alias("gone")))
    df = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    df = df.join(gone.hint("merge"), "key", "left")
    text = F.col(f"row.`{text_col}`")
    df = df.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split(text.cast("string"), "\n", -1)))

    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    rest = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    # a stretch of removed lines for each whose line before stays
    n_stretches = F.size(F.array_except("gone", F.transform("gone", lambda i: i + 1)))
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    counts = [n_lines, n_removed, F.when(F.col("gone").isNull(), 0).otherwise(n_stretches)]
    out = df.select(F.col("row").withField(f"`{text_col}`", rest).alias("row"),
                    *[c.cast("long").alias(n) for c, n in zip(counts, STATS, strict=True) if stats])
    return out.select("row.*", *(STATS if stats else ()))
