"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for the base kinds (assign, access, hex) and for generic candidates: runs of 20 or more
characters of [A-Za-z0-9_-] with a letter, a digit and `min_distinct` different characters. A candidate's hash is
counted by distinct owners and repositories over the whole corpus. One seen under few owners and in few repositories
looks live and is added as a span of kind `live`; one that many owners, or many repositories of few owners, copied is an
example and is not. Base spans always stay.

Positions come from splitting a text at its matches: a match starts where the pieces and matches before it end. Spark's
length() counts code points.

Defined results: null text counts as empty and has no spans; no span gives the SHA-256 of the empty string and an empty
`spans`; repeated rows each get their own result row, and count once per owner and repository; an empty table gives an
empty result; null owners and repositories count as the empty name; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

# Fixed patterns of the contract: kind, order among spans that start together, pattern, group measured, least length.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", 0, ASSIGN, 1, 8), ("access", 1, "AKIA[A-Z0-9]+", 0, 16), ("hex", 2, "[0-9a-f]{32,}", 0, 32))
GENERIC = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern + '"' if '"' not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _located(found: DataFrame, kind: str, order: int, pattern: str, group: int, measure: str, least: int) -> DataFrame:
    """Adds an array of SPAN for a pattern; starts come from the lengths of the pieces between matches."""
    p = _quoted(pattern)
    found = found.withColumn("m", F.expr(f"regexp_extract_all(t, {p}, 0)"))
    found = found.withColumn("gap", F.expr(f"if(size(m) > 0, split(t, {p}, -1), cast(array() as array<string>))"))
    found = found.withColumn("v", F.expr(f"if(size(m) > 0, regexp_extract_all(t, {p}, {group}), cast(array() as array<string>))") if group else F.col("m"))
    spans = f"""
      transform(filter(aggregate(
          transform(m, (x, i) -> named_struct('m', x, 'gap', gap[i], 'v', v[i])),
          named_struct('pos', 0, 'out', cast(array() as array<struct<start:int,ord:int,kind:string,end:int,value:bigint,n:int>>)),
          (a, z) -> named_struct('pos', a.pos + length(z.gap) + length(z.m), 'out', concat(a.out, array(named_struct(
              'start', a.pos + length(z.gap), 'ord', {order}, 'kind', '{kind}', 'end', a.pos + length(z.gap) + length(z.m), 'value', xxhash64(z.v), 'n', {measure})))),
          a -> a.out), s -> s.n >= {least}),
        s -> named_struct('start', s.start, 'ord', s.ord, 'kind', s.kind, 'end', s.end, 'value', s.value))"""
    return found.withColumn(kind, F.expr(spans)).drop("m", "gap", "v")


def _joined(spans: str) -> str:
    return f"array_join(transform(array_sort({spans}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 2, max_repos: int = 4, min_distinct: int = 10, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans; n_live and n_example count candidates by ownership."""
    scratch = scratch or Scratch(docs.sparkSession)
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"), F.xxhash64(name(owner_col)).alias("owner"), F.xxhash64(*[name(c) for c in repo_cols]).alias("repo"))
    found = src
    for kind, order, pattern, group, least in BASE:
        found = _located(found, kind, order, pattern, group, "length(z.v)", least)
    found = _located(found, "live", 9, GENERIC, 0, "size(array_distinct(split(z.m, '')))", min_distinct)
    rows = found.select("id", "owner", "repo", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.concat("assign", "access", "hex").alias("base"), F.col("live").alias("generic"))
    rows = rows.withColumn("generic", F.expr("filter(generic, g -> not exists(base, b -> b.start < g.end and g.start < b.end))"))
    rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "found")
    candidates = scratch.table(rows.filter("size(base) + size(generic) > 0").select("row", "owner", "repo", F.explode(F.concat("base", "generic")).alias("s")).select("row", "owner", "repo", "s", F.col("s.value").alias("value")), "candidates")
    owned = candidates.select("value", "owner", "repo").distinct().groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repos"))
    owned = scratch.table(owned, "owned")
    few = f"owners <= {max_owners} and repos <= {max_repos}"
    judged = candidates.join(owned, "value").groupBy("row").agg(
        F.expr(f"collect_list(if(s.ord = 9 and {few}, s, null))").alias("live"),
        F.expr(f"count_if({few})").alias("n_live"),
        F.expr(f"count_if(not ({few}))").alias("n_example"),
    )
    out = rows.join(judged, "row", "left").withColumn("all", F.expr("concat(base, coalesce(live, array()))"))
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("all")).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example")
    )

