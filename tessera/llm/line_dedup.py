"""Line dedup by winnowing over line hashes, in DataFrame functions only.

The lines of a document that hold a word form a sequence. A window starts at each of them and takes lines until it has
`min_words` words; the smallest line hash of a window is its fingerprint. Two runs of equal lines with at least that
many words hold an equal whole window and so share a fingerprint, whatever stands around them: the guarantee.
Fingerprints that occur at two positions or more are kept, the windows at those positions are joined on the hash of all
their lines, and each is matched with the first place, by (doc_id, row hash, line), that has it. Windows start at every
line, so overlapping ones extend a match back to its first line; forward, the last window of a run is followed along
with its first place, line by line, until the lines differ. Runs of later places are deleted whole.

No group is expanded into pairs: each window meets one first place, each run is followed once.

Defined results: a word is a run of characters other than [\\x20\\x09-\\x0D]; lines split at \\n; lines without a word
take no part but go when they lie inside a deleted run. Null text stays null, empty text stays empty. Rows equal in id
and text are one document and get the same cuts. Runs repeated inside one document are cut too. Very long texts are
read whole. A run of fewer than `min_words` words stays, however often it is repeated. Other columns pass through
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

ID, ROW, CUTS = "__tessera_id", "__tessera_row", "__tessera_cuts"


def _row_hash(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col])


def _windows(min_words: int) -> str:
    """SQL over `lines` (pos, n, h): per line the whole window that starts there, or null."""
    return f"""
      filter(transform(lines, (x, i) -> aggregate(
          slice(lines, i + 1, {min_words}),
          named_struct('n', 0, 'fp', 9223372036854775807L, 'at', -1, 'key', 0L, 'last', x.pos),
          (a, y) -> if(a.n >= {min_words}, a, named_struct('n', a.n + y.n, 'fp', least(a.fp, y.h), 'at', if(y.h < a.fp, y.pos, a.at), 'key', xxhash64(a.key, y.h), 'last', y.pos)),
          a -> if(a.n >= {min_words}, named_struct('first', x.pos, 'last', a.last, 'fp', a.fp, 'at', a.at, 'key', a.key), null))),
        w -> w is not null)"""


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, row hash, runs): merged line ranges (first, last; inclusive, from 0) of later places, per document that has some."""
    scratch = scratch or Scratch(docs.sparkSession)
    src = docs.filter(docs[text_col].isNotNull()).select(docs[id_col].alias(ID), _row_hash(docs, id_col, text_col).alias(ROW), F.split(docs[text_col].cast("string"), "\n").alias("split"))
    counted = F.expr(r"filter(transform(split, (x, i) -> named_struct('pos', i, 'n', size(regexp_extract_all(x, r'[^\x20\x09-\x0D]+', 0)), 'h', xxhash64(x))), l -> l.n > 0)")
    lines = scratch.table(src.select(ID, ROW, counted.alias("lines")), "lines")
    windows = lines.select(ID, ROW, F.explode(F.expr(_windows(min_words))).alias("w")).select(ID, ROW, "w.*")
    windows = scratch.table(windows, "windows")
    place = F.struct(ID, ROW, "at")
    shared = windows.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("fp")
    shared = scratch.table(shared, "fingerprints")
    here = F.struct(ID, ROW, "first")
    keys = windows.join(shared, "fp").groupBy("key").agg(F.min(F.struct(ID, ROW, "first", "last")).alias("origin"), F.max(here).alias("final")).filter(f"struct(origin.{ID}, origin.{ROW}, origin.first) != final").select("key", "origin")
    keys = scratch.table(keys, "keys")
    later = windows.join(keys, "key").filter(here != F.struct(F.col(f"origin.{ID}"), F.col(f"origin.{ROW}"), F.col("origin.first")))
    origin = F.struct(F.col(f"origin.{ID}").alias("id"), F.col(f"origin.{ROW}").alias("row"), F.col("origin.last").alias("last"))
    run = scratch.table(_merged(later.select(ID, ROW, "first", "last", origin.alias("origin"))), "matches")
    # Both documents of a run by their line hashes, never by their texts; a merge join at every size.
    wanted = run.select(ID, ROW).union(run.select("origin.id", "origin.row")).distinct().select(F.col(ID).alias("id_o"), F.col(ROW).alias("row_o"))
    same = F.col(ID).eqNullSafe(F.col("id_o")) & (F.col(ROW) == F.col("row_o"))
    held = scratch.table(lines.join(wanted.hint("merge"), same, "left_semi").dropDuplicates([ID, ROW]).select(F.col(ID).alias("id_o"), F.col(ROW).alias("row_o"), "lines"), "held")
    ours = run.join(held.hint("merge"), same).select(ID, ROW, "first", "last", "origin", F.expr("filter(lines, l -> l.pos > last)").alias("tail"))
    both = ours.join(held.hint("merge"), F.expr("origin.id <=> id_o and origin.row = row_o"))
    differ = "array_position(zip_with(tail, filter(lines, l -> l.pos > origin.last), (x, y) -> coalesce(x.h = y.h, false)), false)"
    both = both.withColumn("agreed", F.expr(f"if({differ} = 0, size(tail), cast({differ} as int) - 1)"))
    followed = both.select(ID, ROW, "first", F.expr("coalesce(try_element_at(tail, nullif(agreed, 0)).pos, last)").alias("last"), "origin")
    cuts = _merged(followed).groupBy(ID, ROW).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(CUTS))
    return scratch.table(cuts, "runs")


def _merged(runs: DataFrame) -> DataFrame:
    """(id, row hash, first, last, origin): runs of a document that overlap or touch made one, with the origin of the one that ends last."""
    inside = Window.partitionBy(ID, ROW).orderBy("first", "last")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    marked = runs.withColumn("begins", F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True)).cast("int"))
    marked = marked.withColumn("run", F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(ID, ROW, "run").agg(F.min("first").alias("f"), F.max("last").alias("l"), F.max_by("origin", F.struct("last", "first")).alias("origin"))
    return merged.select(ID, ROW, F.col("f").alias("first"), F.col("l").alias("last"), "origin")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", report: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """docs with later repeated runs cut from the text; with `report`, also n_removed and removed ('first:last,...')."""
    runs = repeated_runs(docs, min_words, id_col, text_col, scratch)
    keyed = docs.withColumn(ROW, _row_hash(docs, id_col, text_col))
    # The runs grow with the corpus: texts meet them by a merge join at every size, never by a broadcast.
    runs = runs.withColumnRenamed(ROW, ROW + "_r").hint("merge")
    out = keyed.join(runs, (F.col(ROW) == F.col(ROW + "_r")) & keyed[id_col].eqNullSafe(F.col(ID)), "left")
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> not exists({CUTS}, c -> i between c.first and c.last)), '\\n')")
    extra = {}
    if report:
        extra = {"n_removed": F.expr(f"coalesce(aggregate({CUTS}, 0L, (a, c) -> a + c.last - c.first + 1), 0L)"), "removed": F.expr(f"coalesce(array_join(transform({CUTS}, c -> concat(c.first, ':', c.last)), ','), '')")}
    out = out.withColumns(extra | {text_col: F.when(F.col(CUTS).isNull(), F.col(text_col)).otherwise(kept)})
    return out.select(*docs.columns, *extra)
