"""Cross-site boilerplate lines, found by the number of distinct sites that carry them. DataFrame functions only.

Lines that occur `min_sites` times or more get a HyperLogLog sketch of their sites, merged by aggregation on the line's hash. A line whose
estimate is well above the threshold is boilerplate; one near the threshold gets an exact distinct count. Boilerplate lines are
taken out of every document, whatever their share of it, unless nothing but blanks would be left: such a document stays whole (copies of
whole documents are for near-duplicate removal) and is marked by n_boilerplate = n_lines less its blank lines, with n_removed 0.
Joins on a line's hash are salted, so that the rows of a very common line go to `SALTS` tasks, and sums are made before the exchange.

Contracts: lines of fewer than `min_chars` characters, which recur on any site by chance, are no boilerplate; null and empty texts stay as
they are; null sites count as no site; repeated doc_ids and rows are treated alike; extra columns are carried, and where one is called
n_lines, n_boilerplate or n_removed it stays as it is and the new column's name ends in an underscore; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

OWN = "_line_dedup"
SALTS = 32
#: What is left of a text counts as blank without any other character than these.
BLANK = r"[^ \t\n\x0B\f\r]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    """64 bits of one hash and 32 of another, by which a line is known."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def _doc(id_col: str, text_col: str) -> Column:
    """By which a document finds its boilerplate lines again. Documents of one id, or without any, are spread by their texts."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def line_table(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row (doc, site, a, b) for each line of `min_chars` characters or more."""
    lines = docs.select(_doc(id_col, text_col).alias("doc"), F.xxhash64(F.col(site_col)).alias("site"), F.col(site_col).isNull().alias("nowhere"), F.explode(_lines(F.col(text_col))).alias("line"))
    line = F.trim(F.col("line"))
    return lines.where(F.length(line) >= min_chars).select("doc", F.when(~F.col("nowhere"), F.col("site")).alias("site"), _hash(line).alias("h")).select("doc", "site", "h.a", "h.b")


def _of(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of `lines` whose hash is in `chosen` (distinct a, b). A common line's rows are dealt to many tasks."""
    salted = lines.withColumn("salt", F.pmod(F.col("doc"), F.lit(SALTS)).cast("int"))
    every = chosen.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    every = every.hint("merge")  # a broadcast would be chosen by the size before the salts multiply it
    return salted.join(every, ["a", "b", "salt"], "left_semi").drop("salt")


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 11, band: float = 0.25) -> DataFrame:
    """Hashes (a, b) of the lines that `min_sites` distinct sites or more carry."""
    often = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("a", "b")
    sketched = _of(lines.select("doc", "site", "a", "b"), often).groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    spread = stored(sketched.select("a", "b", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band)), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("a", "b")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("a", "b")
    exact = _of(lines.select("doc", "site", "a", "b"), near).groupBy("a", "b", "site").agg(F.count(F.lit(1)).alias("n"))
    exact = exact.groupBy("a", "b").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites).select("a", "b")
    return sure.unionByName(exact)


def drop_boilerplate(docs: DataFrame, min_sites: int = 5, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """`docs` with boilerplate lines taken out of the text, and the columns n_lines, n_boilerplate (its boilerplate lines) and n_removed."""
    lines = stored(line_table(docs, min_chars, id_col, text_col, site_col), "lines")
    bad_lines = stored(boilerplate(lines, min_sites), "line-boilerplate")
    hit = _of(lines.select("doc", "a", "b"), bad_lines)
    hit = hit.groupBy("doc").agg(F.collect_set(F.struct("a", "b")).alias(OWN)).withColumnRenamed("doc", f"{OWN}_doc")
    both = docs.withColumn(f"{OWN}_key", _doc(id_col, text_col)).join(hit, F.col(f"{OWN}_key") == F.col(f"{OWN}_doc"), "left").drop(f"{OWN}_doc", f"{OWN}_key")
    arr = _lines(F.col(text_col))
    bad = lambda x: (F.length(F.trim(x)) >= min_chars) & F.array_contains(F.col(OWN), _hash(F.trim(x)))
    out = both.withColumn(f"{OWN}_kept", F.when(F.col(OWN).isNotNull(), F.filter(arr, lambda x: ~bad(x))))
    kept = F.array_join(F.col(f"{OWN}_kept"), "\n")
    out = out.withColumn(f"{OWN}_text", F.when(F.regexp_like(kept, F.lit(BLANK)), kept))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(arr)).cast("long")
    n_bad = F.when(F.col(OWN).isNull(), 0).otherwise(n_lines - F.size(f"{OWN}_kept")).cast("long")
    new = {"n_lines": n_lines, "n_boilerplate": n_bad, "n_removed": F.when(F.col(f"{OWN}_text").isNotNull(), n_bad).otherwise(0).cast("long")}
    text = {text_col: F.coalesce(F.col(f"{OWN}_text"), F.col(text_col))}
    plain = out.withColumns({f"{OWN}_{c}": v for c, v in (new | text).items()}).withColumn(text_col, F.col(f"{OWN}_{text_col}"))
    return plain.select(*docs.columns, *[F.col(f"{OWN}_{c}").alias(f"{c}_" if c in docs.columns else c) for c in new])
