"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, bucketed, join_spread, row_key, same, spool

#: The rolling hash is a polynomial in BASE over the line hashes, by the prime MODULUS.
BASE, MODULUS = 31, 65_537


def line_hash(line: Column) -> Column:
    """28 bits of a line's content, for the rolling hash."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def with_chunks(df: DataFrame, text: Column, mean: int, window: int) -> DataFrame:
    """Adds chunks: the text's lines as an array of chunks, arrays themselves; null for a null text.

    A chunk begins at the first line and after each line at which the rolling hash of the last ``window`` lines is 0
    by ``mean``; missing lines count as 0. Boundaries depend on near lines only, so they move with the text. Each
    step is a column of its own: what a lambda names is then computed once a row.
    """

    def begins(i: Column) -> Column:
        rolling = F.lit(0).cast("long")
        for k in range(window, 0, -1):  # lines i - window .. i - 1, counted from 1
            rolling = rolling * BASE + F.coalesce(F.get("hashes", i - 1 - k), F.lit(0))
        return (i == 1) | (rolling % MODULUS % mean == 0)

    def piece(start: Column, i: Column) -> Column:
        return F.slice("lines_", start, F.coalesce(F.get("starts", i + 1), F.size("lines_") + 1) - start)

    return (
        df.withColumn("lines_", F.split(text, "\n", -1))
        .withColumn("hashes", F.transform("lines_", line_hash))
        .withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("lines_")), begins))
        .withColumn("chunks", F.transform("starts", piece))
    )


def dedup_lines(
    docs: DataFrame, mean: int = 2, window: int = 2, least: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the text without repeated chunks, and ``lines_removed``; a column of that name is replaced.

    Texts are cut at line feeds into lines, and these into chunks of about ``mean`` lines where the content of
    ``window`` lines says so. A chunk of ``least`` lines or more with a word in it that stands at several places
    stays at the first, by id (null first), row key and place, and goes at the others. Null and empty texts stay; a
    text that loses every chunk becomes empty. Rows with equal id and text are one place and are all treated alike.
    Other columns come back as they are, whatever their names. An empty table gives an empty one. What a repeated
    block loses are the whole chunks inside it: the lines before its first boundary and after its last one stay.

    The documents are written once, dealt by the row, so each later join moves lists of places and no texts. Chunks are
    compared by 64-bit hash first; only texts that hold a repeated hash are read again, and their chunks are grouped
    by their bytes, so unlike chunks of one hash stay. Counts and first places are aggregated before they move, and a
    chunk that many documents hold is dealt over many tasks where marks or chunks meet them. The lists of places grow
    with the documents, so they are never broadcast.
    """
    base = docs.drop("lines_removed")
    whole = base.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("doc"))
    whole = bucketed(whole, "line_texts", "row")
    text = F.col("doc").getField(text_col)

    def exploded(df: DataFrame, *keep: str) -> DataFrame:
        """Rows of at, lines, chunk and hash for the chunks that may count, with the columns ``keep``."""
        return (
            with_chunks(df.where(text.isNotNull()), text, mean, window)
            .select(*keep, F.posexplode_outer("chunks").alias("at", "part"))  # outer: no filter is inferred and pushed below
            .where(F.size("part") >= least)
            .select(*keep, "at", F.size("part").alias("lines"), F.array_join("part", "\n").alias("chunk"))
            .where(F.col("chunk").rlike(WORD))
            .withColumn("hash", F.xxhash64("chunk"))
        )

    marks = spool(exploded(whole, "row").select("row", "at", "hash"), "chunk-marks")
    repeated = spool(marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated-hashes")
    suspects = join_spread(marks, repeated, ["hash"], "n", ["row", "at"]).groupBy("row").agg(F.collect_set("at").alias("places"))

    again = whole.withColumn("id", F.col("doc").getField(id_col)).join(suspects.hint("merge"), "row")
    chunks = exploded(again, "row", "id", "places").where(F.array_contains("places", F.col("at")))
    chunks = spool(chunks.drop("places").dropDuplicates(["row", "at"]), "chunk-texts")
    firsts = chunks.groupBy("hash", "chunk").agg(F.min(F.struct("id", "row", "at")).alias("first"), F.count("*").alias("n"))
    firsts = spool(firsts.where("n > 1"), "first-chunks")
    removed = (
        join_spread(chunks, firsts, ["hash", "chunk"], "n", ["row", "at"])
        .where(~same([F.col("row"), F.col("at")], [F.col("first.row"), F.col("first.at")]))
        .groupBy("row")
        .agg(F.collect_set("at").alias("gone"), F.sum("lines").alias("n_gone"))
    )
    removed = spool(removed, "chunks-removed")

    found = whole.join(removed.hint("merge"), "row", "left")
    cut = with_chunks(found, F.when(F.col("gone").isNotNull(), text), mean, window)
    stays = F.filter("chunks", lambda chunk, i: ~F.array_contains("gone", i))
    left = F.coalesce(F.array_join(F.flatten(stays), "\n"), text)
    return cut.select(
        *((left if c == text_col else F.col("doc").getField(c)).alias(c) for c in base.columns),
        F.coalesce("n_gone", F.lit(0)).cast("long").alias("lines_removed"),
    )
