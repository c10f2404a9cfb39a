"""Operator 9: quality rules with thresholds from mergeable quantile sketches, in DataFrame operations only.

A sketch of one measure in one group is a table of counts by bucket. Buckets are exact below 128 and under 1 % wide above, so
sketches of parts of a group, of groups of a language, or of all languages merge by adding counts, in any order, to the same
sketch. Fences come from its quartiles, for each language and source; they replace fixed cutoffs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm import common

SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Groups of fewer rows take the sketch of their language; languages of fewer, that of all rows.
LEAST_ROWS = 200
#: Fences lie so many quartile ranges beyond the quartiles.
REACH = 3
#: Measure: (expression, least quartile range, has a lower fence). All are whole numbers.
MEASURES = {
    "word_length": ("100 * word_chars div n_words", 40, True),
    "symbols": ("1000 * n_symbols div word_chars", 15, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 100, False),
    "repeats": ("1000 * n_repeat_words div n_words", 75, False),
}
#: Sketches of more groups than this aren't broadcast by hint.
BROADCAST_GROUPS = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more. Windows are held by 64-bit hashes within one text."""

    def covered(marks: Column) -> Column:
        at = lambda i: F.get(marks, i).getField("h")
        twice = F.filter(marks, lambda m, i: F.coalesce(m["h"] == at(i - 1), F.lit(False)) | F.coalesce(m["h"] == at(i + 1), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda m: m["i"]))
        new = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(let(starts, new), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        once_more = let(F.sort_array(hashes), lambda s: F.exists(F.transform(s, lambda x, i: x == F.get(s, i + 1)), lambda same: F.coalesce(same, F.lit(False))))
        marks = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(once_more, let(marks, covered)).otherwise(F.lit(0).cast("long"))

    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.lit(0), F.size(words) - 2))
    return let(windows, count)


def measured(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    shape = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    rows = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    got = df.select(
        F.col(key).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        shape.alias("shape"), rows.alias("rows"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return got.select("doc_id", "lang", "source", "shape.*", "rows.*", "word_chars", "n_symbols")


def bucket(v: Column) -> Column:
    """Exact below 128; above, the leading 8 bits and the number of bits that follow."""
    e = F.length(F.bin(v)) - 8
    return F.when(v < 128, v).otherwise(F.lit(128) + e * 128 + F.call_function("shiftright", v, e) - 128).cast("long")


def least_of(b: Column) -> Column:
    """The least value of a bucket."""
    e = F.floor((b - 128) / 128).cast("int")
    return F.when(b < 128, b).otherwise(F.call_function("shiftleft", F.pmod(b - 128, F.lit(128)) + 128, e)).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one row for each bucket that occurs."""
    each = [F.struct(F.lit(m).alias("measure"), bucket(F.expr(f"IF(n_words > 0 AND n_lines > 0, {e}, NULL)")).alias("bucket")) for m, (e, _, _) in MEASURES.items()]
    return rows.select("lang", "source", F.explode(F.array(*each)).alias("x")).select("lang", "source", "x.*").where("bucket is not null").groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Quartile fences of each group and measure; sketches of parts merge first."""
    merged = sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "measure")
    ranked = merged.withColumn("rows", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
    value = least_of(F.col("bucket"))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, value))
    found = ranked.groupBy(*group, "measure").agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    floor = F.lit(None).cast("long")
    for m, (_, least, _) in MEASURES.items():
        floor = F.when(F.col("measure") == m, F.lit(least)).otherwise(floor)
    span = F.greatest(F.col("q3") - F.col("q1"), floor) * REACH
    wide = found.select(*group, "measure", "rows", (F.col("q1") - span).alias("low"), (F.col("q3") + span).alias("high"))
    made = [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m, (_, _, two) in MEASURES.items() for c in (["low", "high"] if two else ["high"])]
    return wide.groupBy(*group).agg(F.max("rows").alias("rows"), *made)


def adaptive_rules(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. Other rows are kept if all measures lie
    within the fences of their language and source; a group of fewer than least_rows rows takes its language's, and a language of
    fewer those of all rows. Null languages and sources are groups of their own; a null or empty text
    has no words and fails; equal values make equal fences, which nothing lies beyond; repeated rows are judged alike; an
    empty table gives an empty one; further columns aren't read.
    """
    rows = common.written(measured(df, text, key, lang, source), "quality")
    sketch = common.written(sketches(rows), "sketches")
    own, by_lang, over_all = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    small = sketch.select("lang", "source").distinct().count() <= BROADCAST_GROUPS
    near = lambda x: F.broadcast(x) if small else x
    names = [c for c in own.columns if c not in ("lang", "source", "rows")]
    renamed = lambda x, tag, keys: x.select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], *[F.when(F.col("rows") >= least_rows, F.col(c)).alias(f"{tag}_{c}") for c in names])
    out = rows.join(near(renamed(own, "s", ["lang", "source"])), F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")), "left")
    out = out.join(near(renamed(by_lang, "l", ["lang"])), F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    total = over_all.first()
    limit = lambda c: F.coalesce(F.col(f"s_{c}"), F.col(f"l_{c}"), F.lit(total[c] if total else None).cast("long"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    good = F.lit(True)
    for m, (e, _, two) in MEASURES.items():
        v = F.expr(f"IF(n_words > 0 AND n_lines > 0, {e}, NULL)")
        good = good & (v <= limit(f"{m}_high")) & ((v >= limit(f"{m}_low")) if two else F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(good, F.lit(False))).alias("kept"))


def op9_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules(common.documents(spark, sf_dir))


_CASES = {m: re.sub(r" div (\w+)", r" // nullif(\1, 0)", e) for m, (e, _, _) in MEASURES.items()}
_LEAST = " ".join(f"WHEN '{m}' THEN {least}" for m, (_, least, _) in MEASURES.items())


def _fence_sql(tag: str, group: str) -> str:
    keys = f"{group}, " if group else ""
    by = f"PARTITION BY {keys}measure"
    wide = ", ".join(f"max(CASE WHEN measure = '{m}' AND total >= {LEAST_ROWS} THEN {q} {sign} {REACH} * greatest(q3 - q1, CASE measure {_LEAST} END) END) AS {m}_{c}" for m in MEASURES for c, q, sign in (("low", "q1", "-"), ("high", "q3", "+")))
    if not group:
        wide = wide.replace(f" AND total >= {LEAST_ROWS}", "")
    return f"""{tag}_m AS (SELECT {keys}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL),
{tag}_r AS (SELECT *, sum(n) OVER ({by}) AS total, sum(n) OVER ({by} ORDER BY bucket) AS upto FROM {tag}_m),
{tag}_q AS (SELECT {keys}measure, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN least_value END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN least_value END) AS q3
  FROM (SELECT *, CASE WHEN bucket < 128 THEN bucket ELSE (((bucket - 128) % 128) + 128) << ((bucket - 128) // 128) END AS least_value FROM {tag}_r) GROUP BY ALL),
{tag} AS (SELECT {keys}{wide} FROM {tag}_q {"GROUP BY ALL" if group else ""})"""


def _limit_sql(c: str) -> str:
    return f"coalesce(own.{c}, by_lang.{c}, over_all.{c})"


OP9_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs),
tri AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
wins AS (SELECT rid, i, [ws[i], ws[i+1], ws[i+2]] AS g FROM tri),
many AS (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM wins),
cov AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM many WHERE k >= 2) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
feat AS (SELECT d.rid, d.doc_id, d.lang, d.source, len(w.ws)::BIGINT AS n_words, coalesce(cov.c, 0)::BIGINT AS n_repeat_words,
  len(ln.ls)::BIGINT AS n_lines, (len(ln.ls) - len(list_distinct(ln.ls)))::BIGINT AS n_dup_lines,
  coalesce(length(regexp_replace(d.t, '[\\x20\\x09-\\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
  (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols
  FROM docs d JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
vals AS (SELECT rid, lang, source, m.measure, m.v FROM (SELECT *, unnest([{", ".join(f"{{'measure': '{m}', 'v': {e}}}" for m, e in _CASES.items())}]) AS m FROM feat WHERE n_words > 0)),
sketch AS (SELECT lang, source, measure, CASE WHEN v < 128 THEN v ELSE 128 + (length(bin(v)) - 8) * 128 + (v >> (length(bin(v)) - 8)) - 128 END::BIGINT AS bucket, count(*) AS n FROM vals GROUP BY ALL),
{_fence_sql("own", "lang, source")},
{_fence_sql("by_lang", "lang")},
{_fence_sql("over_all", "")},
judged AS (SELECT feat.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  coalesce({" AND ".join(f"{e} <= {_limit_sql(m + '_high')}" for m, e in _CASES.items())} AND {_CASES["word_length"]} >= {_limit_sql("word_length_low")}, false) AS good
  FROM feat LEFT JOIN own ON feat.lang IS NOT DISTINCT FROM own.lang AND feat.source IS NOT DISTINCT FROM own.source
  LEFT JOIN by_lang ON feat.lang IS NOT DISTINCT FROM by_lang.lang CROSS JOIN over_all)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND good) AS kept FROM judged
"""
