"""Line dedup: repeated runs of lines, by a suffix array over line ids; later copies go. Native operations only.

A document is its sequence of non-blank lines; a line's id is its MD5. A suffix of the sequence starts at each line.

1. Prefix doubling. The first lines of all suffixes are ranked in the order of their ids; the first 2, 4, 8 ... lines by the
   ranks of the two halves (``min_lines`` is met from the last power of two by overlapping halves, and doubled from there). Ranks
   come from a range sort of the distinct keys, so they grow in suffix order and are never numbered in one task. Suffixes with
   one rank are an interval of the suffix array whose longest common prefix has at least that many lines. Intervals of one
   suffix end there, so only repeated lines take part, and the doubling ends with the longest common run.
2. Common prefixes. A suffix that is not the first of its interval, by (id, row, line), is a later copy; the first of its
   deepest interval is its source. Suffixes one line on from one with the source one line on lie inside the same run.
   For the others, the starts of maximal runs, the length in common with the source is found from the ranks of all
   depths, the deepest first: equal ranks ahead of both add that depth.
3. The lines of the runs go: of ``min_lines`` lines or more, and single lines of ``long_line`` characters or ``long_words`` words.

Counts are combined before the shuffle; joins back to frequent ranks are plain joins that Spark splits.

Defined cases: a null text has no lines and stays null; blank lines (spaces only) are no part of runs and stay where
they are, unless the whole document goes (its text is then empty); null ids come last; repeated rows are copies, of
which the first by row number stays; empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.common import fresh, identified, q, scanned, stored

MIN_LINES = 2
LONG_LINE = 250
LONG_WORDS = 20
#: Depths whose ranks one job compares; its plan holds two joins for each.
DEPTHS_AT_ONCE = 5


def sequences(docs: DataFrame, id_col: str, text_col: str, long_line: int = LONG_LINE, long_words: int = LONG_WORDS) -> DataFrame:
    """__row, id, and the non-blank lines of each document: their ids, and whether they are runs by themselves."""
    lines = F.filter(F.split(q(text_col), "\n"), lambda x: F.trim(x) != "")
    lines = F.coalesce(lines, F.array().cast("array<string>"))

    def line(x: Column) -> Column:
        words = F.size(F.filter(F.split(x, " "), lambda w: w != ""))
        return F.struct(F.md5(x).alias("h"), ((F.length(x) >= long_line) | (words >= long_words)).alias("long"))

    return docs.select("__row", q(id_col).alias("id"), F.transform(lines, line).alias("lines"))


def intervals(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one suffix, with a rank in their order and the first of these suffixes."""
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row", "pos")
    found = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    found = found.select(*keys, F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos")).orderBy(*keys)
    return stored(found.withColumn("new", F.monotonically_increasing_id()), "line-intervals")


def members(suffixes: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The suffixes of the intervals with their rank and the first suffix of their interval."""
    joined = suffixes.join(found, keys)
    later = ~((F.col("row") == F.col("first_row")) & (F.col("pos") == F.col("first_pos")))
    return stored(joined.select("id", "row", "pos", "long", F.col("new").alias("rank"), later.alias("later"), "first_row", "first_pos"), "line-suffixes")


def doubled(single: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """The suffix array at each depth up to the longest common run: depth, and the suffixes whose first lines recur."""
    levels, length, keys, suffixes = [], 1, ["h"], single
    while True:
        found = intervals(suffixes, keys)
        if found.isEmpty():
            return levels
        levels.append((length, members(suffixes, found, keys)))
        step = min(length, min_lines - length) if length < min_lines else length
        here = levels[-1][1].select("id", "row", "pos", "long", "rank")
        ahead = here.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
        suffixes, keys, length = stored(here.join(ahead, ["row", "pos"]), "line-pairs"), ["rank", "next"], length + step


def copied_runs(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame | None:
    """Maximal runs that came before: row, pos, length, and the row and line of their source; None where no line recurs.

    ``lines`` comes from ``sequences``. A source is the first suffix that shares the deepest doubled prefix. Lines that
    are runs by themselves have length 1 where no longer run starts at them.
    """
    single = lines.select(F.col("__row").alias("row"), "id", F.posexplode("lines").alias("pos", "line"))
    levels = doubled(single.select("id", "row", "pos", "line.h", "line.long"), min_lines)
    copies = None
    for length, held in levels:
        if length < min_lines and length > 1:
            continue
        of = held.filter("later" if length >= min_lines else "later AND long")
        of = of.select("row", "pos", F.struct(F.lit(length).alias("length"), "first_row", "first_pos").alias("deepest"))
        copies = of if copies is None else copies.unionByName(of)
    if copies is None:
        return None
    copies = copies.repartition("row").groupBy("row", "pos").agg(F.max("deepest").alias("deepest")).select("row", "pos", "deepest.*")
    before = F.lag(F.struct("pos", "length", "first_row", "first_pos")).over(Window.partitionBy("row").orderBy("pos"))
    inside = (
        (F.col("before.length") >= min_lines) & (F.col("length") >= min_lines)
        & (F.col("before.pos") == F.col("pos") - 1)
        & (F.col("before.first_row") == F.col("first_row")) & (F.col("before.first_pos") == F.col("first_pos") - 1)
    )
    starts = copies.withColumn("before", before).filter(~F.coalesce(inside, F.lit(False))).drop("before")
    runs = stored(starts, "line-runs")
    for k, (depth, held) in enumerate(reversed(levels[:-1]), 1):
        own = held.select("row", F.col("pos").alias("at"), F.col("rank").alias("own"))
        other = held.select(F.col("row").alias("first_row"), F.col("pos").alias("first_at"), F.col("rank").alias("other"))
        ahead = (F.col("length") >= min_lines) & (F.col("length") > depth)
        reach = runs.withColumn("at", F.when(ahead, F.col("pos") + F.col("length"))).withColumn("first_at", F.when(ahead, F.col("first_pos") + F.col("length")))
        reach = reach.join(own, ["row", "at"], "left").join(other, ["first_row", "first_at"], "left")
        more = F.when(F.col("own") == F.col("other"), depth).otherwise(0)
        runs = reach.select("row", "pos", (F.col("length") + more).alias("length"), "first_row", "first_pos")
        if k % DEPTHS_AT_ONCE == 0:
            runs = stored(runs, "line-runs")
    return runs


def removals(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per row, the ascending places of all lines that belong to a later copy of a repeated run."""
    runs = copied_runs(lines, min_lines)
    if runs is None:
        return lines.select(F.col("__row").alias("row"), F.array().cast("array<int>").alias("gone")).filter("false")
    # Runs that overlap are joined first, so that no line is listed more than once.
    by_place = Window.partitionBy("row").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("length")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    joined = runs.withColumn("reach", reach).withColumn("block", F.sum(F.when(F.col("pos") <= F.col("reach"), 0).otherwise(1)).over(by_place))
    blocks = joined.groupBy("row", "block").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("length")).alias("end"))
    held = F.array_sort(F.collect_list(F.struct("pos", "end")))
    return blocks.groupBy("row").agg(F.flatten(F.transform(held, lambda b: F.sequence(b["pos"], b["end"] - 1))).alias("gone"))


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, also where ``fn`` uses it inside other functions."""
    return F.transform(F.array(value), fn)[0]


def _kept(items: Column, gone: Column) -> Column:
    """``items`` without those at the ascending places ``gone``: the slices between these places, so linear in the items."""

    def cut(held: Column) -> Column:
        ends = F.concat(held["gone"], F.array(F.size(held["items"])))
        starts = F.concat(F.array(F.lit(0)), F.transform(held["gone"], lambda p: p + 1))
        bounds = F.zip_with(starts, ends, lambda start, end: F.struct(start.alias("start"), end.alias("end")))
        return F.flatten(F.transform(bounds, lambda b: F.slice(held["items"], b["start"] + 1, F.greatest(b["end"] - b["start"], F.lit(0)))))

    return _let(F.struct(items.alias("items"), gone.alias("gone")), cut)


def _runs(gone: Column) -> Column:
    """Lengths of the runs of consecutive places."""

    def starts(g: Column) -> Column:
        places = F.transform(g, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        first = F.filter(F.zip_with(places, F.concat(F.array(F.lit(-2)), g), lambda x, before: F.when(x["p"] != before + 1, x["i"])), lambda i: i.isNotNull())
        return _let(first, lambda f: F.zip_with(f, F.concat(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), F.array(F.size(g))), lambda a, b: b - a))

    return _let(gone, lambda g: F.when(F.size(g) == 0, F.array().cast("array<int>")).otherwise(starts(g)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_line: int = LONG_LINE, long_words: int = LONG_WORDS) -> DataFrame:
    """Per document: id, n_lines, n_removed, n_runs (maximal removed runs), longest_run (lines of the longest), kept_md5 (MD5 of the kept lines' ids)."""
    lines = stored(sequences(identified(docs.select(q(id_col), q(text_col)), "__row"), id_col, text_col, long_line, long_words), "line-sequences")
    gone = removals(lines, min_lines)
    joined = lines.join(gone.withColumnRenamed("row", "__row"), "__row", "left")
    none = F.array().cast("array<int>")
    joined = joined.select("id", "lines", F.coalesce("gone", none).alias("gone"))
    cut = F.col("gone")
    return joined.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(cut).cast("long").alias("n_removed"),
        F.size(_runs(cut)).cast("long").alias("n_runs"),
        F.coalesce(F.array_max(_runs(cut)), F.lit(0)).cast("long").alias("longest_run"),
        F.md5(F.array_join(_kept(F.transform("lines", lambda x: x["h"]), cut), "")).alias("kept_md5"),
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_line: int = LONG_LINE,
    long_words: int = LONG_WORDS, scan: bool = False,
) -> DataFrame:
    """``docs`` without the later copies of repeated runs of lines; documents of which nothing is left have an empty text.

    Row numbers must not change between passes. They are the file and the row in it where ``docs`` is a plain scan of
    Parquet (``scan=True``); otherwise the table is written first.
    """
    row = fresh(docs, "__row")
    own = scanned(docs, row) if scan else stored(identified(docs, row), "line-documents")
    lines = stored(sequences(own.select(q(row).alias("__row"), q(id_col), q(text_col)), id_col, text_col, long_line, long_words), "line-sequences")
    gone = removals(lines, min_lines).select(F.col("row").alias(row), F.col("gone").alias(fresh(docs, "__gone")))
    cut = q(fresh(docs, "__gone"))
    # Places of the non-blank lines in the text, and from them those of the lines that go.
    joined = own.join(gone, row, "left")

    def cleaned(parts: Column) -> Column:
        places = F.filter(F.transform(parts, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
        return _kept(parts, _let(places, lambda held: F.transform(cut, lambda p: F.get(held, p))))

    rest = F.array_join(_let(F.split(q(text_col), "\n"), cleaned), "\n")
    rest = _let(rest, lambda r: F.when(F.trim(F.translate(r, "\n", " ")) == "", F.lit("")).otherwise(r))
    text = F.when(cut.isNull(), q(text_col)).otherwise(rest)
    return joined.select(*[text.alias(c) if c == text_col else q(c) for c in docs.columns])


SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM cut),
l AS (SELECT doc_id, md5(line) AS h, length(line) >= {LONG_LINE} OR len(list_filter(string_split(line, ' '), lambda w: w <> '')) >= {LONG_WORDS} AS long,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
      FROM raw WHERE trim(line) <> ''),
pairs AS (SELECT doc_id, pos, h, lead(h) OVER (PARTITION BY doc_id ORDER BY pos) AS h2 FROM l),
later AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h, h2 ORDER BY doc_id, pos) AS k FROM pairs WHERE h2 IS NOT NULL),
singles AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k, long FROM l),
gone AS (SELECT doc_id, pos FROM later WHERE k > 1 UNION SELECT doc_id, pos + 1 FROM later WHERE k > 1
         UNION SELECT doc_id, pos FROM singles WHERE k > 1 AND long),
marked AS (SELECT l.*, gone.pos IS NOT NULL AS out FROM l LEFT JOIN gone USING (doc_id, pos)),
runs AS (SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM marked),
numbered AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM runs),
longest AS (SELECT doc_id, max(k) AS longest_run FROM (SELECT doc_id, run, count(*) AS k FROM numbered WHERE out GROUP BY ALL) GROUP BY doc_id),
cuts AS (SELECT d.doc_id, count(r.pos) AS n_lines, count(r.pos) FILTER (r.out) AS n_removed, count(r.pos) FILTER (r.starts) AS n_runs,
         md5(coalesce(string_agg(r.h, '' ORDER BY r.pos) FILTER (NOT r.out), '')) AS kept_md5
         FROM documents d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT cuts.*, coalesce(longest_run, 0) AS longest_run FROM cuts LEFT JOIN longest USING (doc_id)
"""
