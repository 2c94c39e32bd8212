"""Cross-site boilerplate lines by distinct-site spread.

For every line hash a HyperLogLog sketch gathers the sites the line stands on; sketches merge by aggregation. Lines
whose estimate lies clearly over or under the threshold are decided by it, lines near the threshold get an exact
distinct count. Lines on enough sites are boilerplate and are cut from all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratafold.llm.shared import staged, text_of, unused_names

_LINE = ["hash_1", "hash_2"]  # two hashes with different seeds: 128 bits name a line
LOG_REGISTERS = 10
_SIGMAS = 5  # standard errors of the sketch that count as near


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """Position and hashes of every line that is not blank; what surrounds it does not count."""
    lines = docs.select(F.struct("doc_id", F.xxhash64(text_of()).alias("text_hash")).alias("key"), F.xxhash64(F.col(site).cast("string")).alias("site"), F.posexplode(F.split(text_of(), "\n")).alias("position", "line"))
    trimmed = lines.withColumn("line", F.trim("line")).where(F.length("line") > 0)
    return trimmed.select("key", "site", "position", F.xxhash64("line").alias("hash_1"), F.xxhash64(F.lit(1), "line").alias("hash_2"))


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """hash_1, hash_2 and sites of the lines that stand on at least ``min_sites`` different sites.

    ``sites`` is exact near the threshold and the sketch's rounded estimate beyond. Copies on one site count once;
    a null site is a site. Nothing is gathered per line but a sketch, which combines before the shuffle, or, near
    the threshold, the pairs of line and site.
    """
    lines = _lines(docs, site)
    spread = lines.groupBy(*_LINE).agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"))
    spread = spread.select(*_LINE, F.hll_sketch_estimate("sketch").alias("estimate"))
    slack = max(1.0, _SIGMAS * 1.04 / 2 ** (LOG_REGISTERS / 2) * min_sites)
    decided = staged(spread.where(F.col("estimate") >= min_sites - slack), "line-spread")
    over = decided.where(F.col("estimate") > min_sites + slack).select(*_LINE, F.col("estimate").alias("sites"))
    near = decided.where(F.col("estimate") <= min_sites + slack).select(*_LINE)
    exact = lines.select(*_LINE, "site").join(near, _LINE, "left_semi").distinct().groupBy(*_LINE).agg(F.count("*").alias("sites"))
    return over.union(exact.where(F.col("sites") >= min_sites))


def strip_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """Each row of the input with its boilerplate lines cut from the text, and ``n_lines`` and ``n_cut``.

    Lines are what newlines separate; ``n_lines`` counts those that are not blank, ``n_cut`` the ones cut. Blank
    lines stay. Lines are compared without the spaces around them. A null text stays null and has no lines; a null
    site counts as a site of its own. Rows that repeat doc_id and text give the same result each. Columns named
    n_lines or n_cut are replaced; the others stay, whatever their names. Ids may have any type. Lines meet the boilerplate by hash only; texts are shuffled
    once, to the positions that are cut from them.
    """
    bad = staged(boilerplate_lines(docs, site, min_sites), "boilerplate")
    key, cut = unused_names(docs, "key", "cut")
    cuts = _lines(docs, site).join(bad, _LINE, "left_semi").groupBy(F.col("key").alias(key)).agg(F.collect_set("position").alias(cut))
    marked = docs.withColumn(key, F.struct("doc_id", F.xxhash64(text_of()).alias("text_hash"))).join(cuts, key, "left")
    lines = F.split(F.col("text"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.size(F.filter(F.split(text_of(), "\n"), lambda line: F.length(F.trim(line)) > 0)).cast("long")
    n_cut = F.coalesce(F.size(cut), F.lit(0)).cast("long")
    return marked.withColumns({"n_lines": n_lines, "n_cut": n_cut, "text": text}).select(*[c for c in docs.columns if c not in ("n_lines", "n_cut")], "n_lines", "n_cut")
