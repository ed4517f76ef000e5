"""Secret scans with DataFrame functions alone.

The base kinds are patterns; spans come from splitting a text by a pattern and adding up the lengths of what lies
between and of the matches. Beside them, weak candidates (identifiers, key material, endpoints) are linked: all parts of
a document become intervals, and a candidate is reported only if the parts that complete it lie within its scope, which
is its block of lines and a distance in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, free_names, quoted

#: The base kinds, in their order, with what a match must have at least.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Weak candidates: whose value alone proves nothing.
IDENTIFIER = r"""(?i:\b(?:user(?:name)?|login|account|client_?id|access_?(?:key_?)?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
MATERIAL = r"""(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=])"""
ENDPOINT = r"""(?i:\b(?:https?|ftp|jdbc:[a-z]{2,20}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://)[^\s"'<>]{3,}"""

#: Code points that may lie between a candidate and its complements, in a block of lines that no blank line cuts.
SCOPE = 200
BLANK = r"\n[\x20\t\r]*\n"
#: Order of kinds in the span lists; the first three are the base's.
KINDS = ["assign", "access", "hex", "identifier", "material", "endpoint"]

_NONE = "CAST(array() AS array<struct<start:int,end:int>>)"


def _running(lengths: Column) -> Column:
    """Sums of all elements up to each one, by blocks, so that no array is copied once per element."""
    zero = F.lit(0)
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths).cast("double"))).cast("int"))

    def inner(part: Column, base: Column) -> Column:
        return F.aggregate(part, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out")))["out"]

    parts = F.transform(F.sequence(zero, F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    summed = F.transform(parts, lambda p: F.struct(p.alias("part"), F.aggregate(p, zero, lambda a, x: a + x).alias("sum")))
    with_base = F.transform(summed, lambda s, i: F.struct(s["part"].alias("part"), F.aggregate(F.slice(summed, 1, i), zero, lambda a, x: a + x["sum"]).alias("base")))
    return F.flatten(F.transform(with_base, lambda s: inner(s["part"], s["base"])))


def _spans(df: DataFrame, text: str, name: str, pattern: str, least: int, group: int = 0, hint: Column | None = None) -> DataFrame:
    """Add the column `name`: start and end (code points, end exclusive) of the leftmost non-overlapping matches whose
    group has at least `least` characters. hint: rows that can hold a match at all."""
    t, p = F.col(quoted(text)), F.lit(pattern)
    some = F.coalesce(hint, F.lit(False)) if hint is not None else t.isNotNull()
    m, g, gaps = f"_{name}_m", f"_{name}_g", f"_{name}_gaps"
    df = df.withColumn(m, F.when(some, F.regexp_extract_all(t, p, F.lit(0)))).withColumn(gaps, F.when(F.size(m) > 0, F.split(t, pattern, -1)))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.regexp_extract_all(t, p, F.lit(group)))) if group else df.withColumn(g, F.col(m))
    ends = _running(F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b)))
    every = F.zip_with(ends, F.zip_with(m, g, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("k"))), lambda e, x: F.struct((e - x["n"]).alias("start"), e.alias("end"), x["k"].alias("k")))
    kept = F.transform(F.filter(every, lambda x: x["k"] >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return df.withColumn(name, F.when(F.size(m) > 0, kept).otherwise(F.expr(_NONE))).drop(m, g, gaps)


def _tagged(kinds: list[str]) -> Column:
    """All spans of the kinds as (start, order of kind, end), sorted."""

    def of(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end")))

    return F.array_sort(F.concat(*[of(KINDS.index(k)) for k in kinds]))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def found_spans(df: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of df: key, hash (of the text) and spans: array of (start, kind, end), kind an index in KINDS."""
    t = F.col(quoted(text))
    rows = df.select(F.col(quoted(key)).alias("key"), F.xxhash64(t).alias("hash"), t.alias("text"))
    rows = _spans(rows, "text", "assign", ASSIGN, ASSIGN_LEAST, 2, F.col("text").rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    rows = _spans(rows, "text", "access", ACCESS, ACCESS_LEAST, 0, F.contains("text", F.lit("AKIA")))
    # runs that are too short fail whole, so the pattern may ask for the length at once
    rows = _spans(rows, "text", "hex", r"[0-9a-f]{%d,}" % HEX_LEAST, HEX_LEAST, 0, F.col("text").rlike(r"[0-9a-f]{%d}" % HEX_LEAST))
    rows = _spans(rows, "text", "identifier", IDENTIFIER, 1, 0, F.col("text").rlike(IDENTIFIER))
    rows = _spans(rows, "text", "material", MATERIAL, 1, 0, F.col("text").rlike(r"[A-Za-z0-9+/]{32}"))
    rows = _spans(rows, "text", "endpoint", ENDPOINT, 1, 0, F.contains("text", F.lit("://")))
    rows = _spans(rows, "text", "blank", BLANK, 1, 0, (F.size("identifier") + F.size("material") + F.size("endpoint") > 0) & F.contains("text", F.lit("\n")))
    blank = F.transform("blank", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end")))
    rows = cut_lineage(rows.select("key", "hash", _tagged(KINDS).alias("parts"), _tagged(KINDS[:3]).alias("base"), blank.alias("blank")))
    weak = F.exists("parts", lambda x: x["kind"] >= 3)
    # a document's parts, only where some weak one and another part stand
    parts = rows.where(weak & (F.size("parts") > 1)).select("key", "hash", F.explode(F.concat("parts", "blank")).alias("p")).distinct().select("key", "hash", "p", F.col("p.start").alias("start"), F.col("p.kind").alias("kind"), F.col("p.end").alias("end"))
    # a block's number is that of the blank lines before it
    whole = Window.partitionBy("key", "hash").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("block", F.count_if(F.col("kind") == len(KINDS)).over(whole)).where(F.col("kind") < len(KINDS))
    # intervals join by what lies between them: back to the farthest end of those that start no later, and on to the
    # next start; the latter by a window in falling order, as its sums run on
    own = Window.partitionBy("key", "hash", "block")
    back, on = (own.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))

    def close(*kinds: int) -> Column:
        of = F.col("kind").isin(*kinds)
        gap = F.least(F.col("start") - F.max(F.when(of, F.col("end"))).over(back), F.min(F.when(of, F.col("start"))).over(on) - F.col("end"))
        return (gap <= scope).cast("int")

    linked = parts.withColumn("_s", close(0, 2, 4)).withColumn("_n", close(1, 3))
    told = F.when(F.col("kind") == 3, F.col("_s") == 1).when(F.col("kind") == 4, F.col("_n") == 1).when(F.col("kind") == 5, (F.col("_s") == 1) & (F.col("_n") == 1))
    more = linked.where(told).groupBy("key", "hash").agg(F.collect_list("p").alias("more")).select(F.col("key").alias("_k"), F.col("hash").alias("_h"), "more")
    both = rows.join(more, rows["key"].eqNullSafe(F.col("_k")) & (rows["hash"] == F.col("_h")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int>>)"))))
    return both.select("key", "hash", "base", every.alias("spans"))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of df: the key, n_assign, n_access, n_hex, base_sha256, spans (as a string) and found (array).

    Whole texts are read; null counts as empty: no spans, the digest of the empty string. Spans are kind:start:end in
    code points, end exclusive, by start and then kind. Weak kinds stand only where they are linked: an identifier near
    a secret, key material near an identifier or access key, an endpoint near both; near is at most `scope` code points
    apart, with no blank line between. Repeated rows give equal results;
    null keys are allowed; further columns are left out. An empty table gives an empty one.
    """
    found = found_spans(df, key, text, scope)
    n = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("bigint")
    names = F.array(*map(F.lit, KINDS))
    out = F.transform("spans", lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select(F.col("key").alias(key), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), out.alias("found"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """df with each found span of the text replaced by the mark; overlapping spans become one. Columns stay, and so do
    null texts and repeated rows."""
    holder, k, h = free_names(df, "spans", "key", "hash")
    found = found_spans(df, key, text, scope).where(F.size("spans") > 0).select(F.col("key").alias(k), F.col("hash").alias(h), F.col("spans").alias(holder)).dropDuplicates([k, h])
    t = F.col(quoted(text))
    joined = df.join(found, F.col(quoted(key)).eqNullSafe(F.col(k)) & (F.xxhash64(t) == F.col(h)), "left")
    # one pass over sorted spans: what lies between is kept, and `at` is the end of all spans so far
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        piece = F.concat(F.substring(t, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], F.array(piece))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(holder, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, s["at"] + 1, F.length(t))))
    clean = F.when(F.col(holder).isNotNull(), done).otherwise(t).alias(text)
    return joined.select(*[clean if c.lower() == text.lower() else F.col(quoted(c)) for c in df.columns])
