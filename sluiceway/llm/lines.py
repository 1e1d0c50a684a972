"""Line dedup by winnowing over line hashes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import apart, stage

#: Columns that `line_dedup` adds.
ADDED = ("line_dedup_lines", "line_dedup_removed", "line_dedup_runs")
MIN_LINES = 3
LONG_WORDS = 50


#: What stands between the white space of the ASCII range.
WORD = r"[^\x20\x09-\x0D]+"


def _windows(lines: Column, width: int, words: int = 0) -> Column:
    """Every stretch of `width` lines with `words` words or more, and its smallest line hash."""

    def enough(i: Column) -> Column:
        return sum((F.get(lines, i + j)["w"] for j in range(1, width)), F.get(lines, i)["w"]) >= words

    def at(i: Column) -> Column:
        part = F.slice(lines, i + 1, F.lit(width))
        hashes = F.transform(part, lambda x: x["h"])
        low = F.array_min(hashes)
        return F.struct(
            i.alias("start"),
            F.lit(width).alias("width"),
            low.alias("mark"),
            (i + F.array_position(hashes, low).cast("int") - 1).alias("mark_at"),
            F.xxhash64(hashes).alias("k1"),
            F.xxhash64(F.transform(part, lambda x: x["g"])).alias("k2"),
        )

    last = F.size(lines) - width
    starts = F.sequence(F.lit(0), last)
    return F.when(last >= 0, F.transform(F.filter(starts, enough) if words else starts, at))


def repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = MIN_LINES,
    long_words: int = LONG_WORDS,
) -> DataFrame:
    """(i, t, line): numbers, among the non-blank lines, of lines in later repeated runs.

    `i` is the id and `t` a hash of the text, so repeated ids with other texts stay apart.
    A run is `min_lines` non-blank lines or more in a row, or fewer that have `long_words`
    words or more together; words are parted by white space. Windows of `min_lines` lines,
    and shorter ones with so many words, each select their smallest line hash: two equal
    runs always select a fingerprint in common. Windows whose fingerprint
    lies at one place only are dropped; the others are extended around their fingerprint
    to both ends and compared whole, and all but the first by (id, line) are later ones.
    Stretches of such windows make up maximal runs.
    """
    text = F.col(text_col)
    line = F.transform(
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x)) > 0),
        lambda x: F.struct(
            F.xxhash64(x).alias("h"),
            F.xxhash64(F.lit(1), x).alias("g"),
            F.regexp_count(x, F.lit(WORD)).alias("w"),
        ),
    )
    held = docs.where(text.isNotNull()).select(
        F.col(id_col).alias("i"), F.xxhash64(text).alias("t"), line.alias("lines")
    )
    none = F.array().cast("array<struct<start:int,width:int,mark:bigint,mark_at:int,k1:bigint,k2:bigint>>")
    lines = F.col("lines")
    every = F.concat(
        F.coalesce(_windows(lines, min_lines), none),
        *(F.coalesce(_windows(lines, n, long_words), none) for n in range(1, min_lines)),
    )
    windows = held.select("i", "t", F.inline(every))
    place = F.xxhash64("i", "t", "mark_at")
    marks = windows.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    marks = stage(marks.where("a <> z").select("mark"), "marks")
    near = stage(windows.join(marks, "mark", "left_semi").drop("mark", "mark_at"), "near")
    whole = F.struct("i", "t", "start")
    keys = ["k1", "k2", "width"]
    first = near.groupBy(*keys).agg(F.min(whole).alias("a"), F.max(whole).alias("z"))
    first = stage(first.where("a <> z").select(*keys, "a"), "first")
    later = near.join(first, keys).where(whole > F.col("a"))
    # rows that repeat an id and its text are one place
    return later.select("i", "t", F.explode(F.sequence("start", F.expr("start + width - 1"))).alias("line"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = MIN_LINES,
    long_words: int = LONG_WORDS,
) -> DataFrame:
    """`docs` without later repeated runs, and three columns more.

    `line_dedup_lines`, `line_dedup_removed`: numbers of non-blank lines before, and
    removed; `line_dedup_runs`: maximal removed runs. Blank lines neither count nor part
    a run; inside a removed run they go with it. The first copy by (id, line) stays whole, a null id before others.
    Rows of one id and text count as one place: none of them is a copy of another. A
    null text stays null; an empty one has no lines. Texts without runs are unchanged.
    Other columns may have any names; those of the three added ones are replaced.
    """
    own = {n: apart(docs) + n for n in ("i", "t", "h", "gone", "lines", "at", "from", "to")}
    gone = (
        repeated_runs(docs, id_col, text_col, min_lines, long_words)
        .groupBy(F.col("i").alias(own["i"]), F.col("t").alias(own["t"]))
        .agg(F.sort_array(F.collect_set("line")).alias(own["gone"]))
    )
    text = F.col(text_col)
    joined = docs.withColumn(own["h"], F.xxhash64(text)).join(
        gone, (F.col(own["h"]) == F.col(own["t"])) & F.col(id_col).eqNullSafe(F.col(own["i"])), "left"
    )
    hit = F.col(own["gone"]).isNotNull()
    lines = F.split(text, "\n", -1)
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    at = F.transform(F.filter(numbered, lambda x: F.length(F.trim(x["x"])) > 0), lambda x: x["i"])
    edge = lambda step: F.filter(
        own["gone"], lambda x, i: F.coalesce(F.get(own["gone"], i + step) != x + step, F.lit(True))
    )
    told = joined.withColumns(
        {own["lines"]: F.when(hit, lines), own["at"]: at, own["from"]: edge(-1), own["to"]: edge(1)}
    )
    n_runs = F.size(own["from"])
    kept = F.flatten(
        F.transform(F.sequence(F.lit(0), n_runs), lambda r: _between(own["lines"], own["at"], own["from"], own["to"], r))
    )
    number = lambda c: F.when(hit, F.size(c)).otherwise(0).cast("bigint")
    return told.select(
        *(
            F.when(hit, F.array_join(kept, "\n")).otherwise(text).alias(c) if c == text_col else F.col(c)
            for c in docs.columns
            if c not in ADDED
        ),
        F.when(text.isNull(), 0).otherwise(F.size(own["at"])).cast("bigint").alias(ADDED[0]),
        number(own["gone"]).alias(ADDED[1]),
        number(own["from"]).alias(ADDED[2]),
    )


def _between(lines: str, at: str, start: str, end: str, r: Column) -> Column:
    """The lines after run r - 1 and before run r."""
    low = F.when(r == 0, 0).otherwise(F.get(at, F.get(end, r - 1)) + 1)
    high = F.coalesce(F.get(at, F.get(start, r)), F.size(lines))
    return F.slice(lines, low + 1, high - low)
