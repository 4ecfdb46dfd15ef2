"""Drift between declared and found labels, dependencies and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimand_drift(declared: DataFrame, used: DataFrame) -> DataFrame:
    """label, finding: orphaned (declared, never used), unknown (used, never declared), scale_drift, hard_coded.

    Both have label and scale; `used` also has is_literal.
    """
    d, u = declared.select("label", F.col("scale").alias("_want")), used.select("label", F.col("scale").alias("_got"), "is_literal")
    both = d.join(u, "label", "full")
    found = F.array_compact(
        F.array(
            F.when(F.col("_got").isNull() & F.col("is_literal").isNull(), "orphaned"),
            F.when(F.col("_want").isNull(), "unknown"),
            F.when(F.col("_want") != F.col("_got"), "scale_drift"),
            F.when(F.col("is_literal"), "hard_coded"),
        )
    )
    return both.select("label", F.explode(found).alias("finding")).distinct()


def lock_drift(lock: DataFrame, found: DataFrame, key: str = "package", version: str = "version") -> DataFrame:
    """package, finding: missing from the lock, unused, or another version."""
    both = lock.select(key, F.col(version).alias("_want")).join(found.select(key, F.col(version).alias("_got")), key, "full")
    finding = F.when(F.col("_want").isNull(), "missing").when(F.col("_got").isNull(), "unused").when(F.col("_want") != F.col("_got"), "version")
    return both.select(key, finding.alias("finding")).where("finding is not null")


def loaded_packages(lines: DataFrame, bundled: Sequence[str] = ()) -> DataFrame:
    """Packages that script lines load by `library()`, `require()`, `requireNamespace()` or `::`; comments don't count."""
    code = F.regexp_replace("value", r"#.*$", "")
    calls = F.regexp_extract_all(code, F.lit(r"\b(?:library|require|requireNamespace)\(\s*[\"']?([A-Za-z][\w.]*)"), F.lit(1))
    scoped = F.regexp_extract_all(code, F.lit(r"\b([A-Za-z][\w.]*):::?[A-Za-z.]"), F.lit(1))
    rows = lines.select(F.explode(F.concat(calls, scoped)).alias("package")).distinct()
    return rows.where(~F.col("package").isin(*bundled)) if bundled else rows


def overlapping_names(names: DataFrame, owner: str = "package", name: str = "name") -> DataFrame:
    """Names that more than one owner defines."""
    return names.groupBy(name).agg(F.count_distinct(owner).alias("n_owners"), F.array_join(F.array_sort(F.collect_set(owner)), " | ").alias("owners")).where("n_owners > 1")


def ci_contract(steps: DataFrame, most_minutes: int = 15) -> DataFrame:
    """Blocking steps without a timeout, over it, or allowed to fail."""
    finding = F.when(F.col("timeout_minutes").isNull(), "no_timeout").when(F.col("timeout_minutes") > most_minutes, "timeout_too_long").when(F.col("continue_on_error"), "may_fail")
    return steps.where("is_blocking").select("step", finding.alias("finding")).where("finding is not null")


def located_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each claim's match string occurs in its artifact."""
    joined = claims.join(sources, "artifact", "left")
    return joined.groupBy("claim_id").agg(F.coalesce(F.bool_or(F.contains("text", "match_string")), F.lit(False)).alias("is_found"))


def deidentified(texts: DataFrame, hashes: DataFrame, id_col: str, text_col: str, salt: str) -> DataFrame:
    """Rows with a word whose salted sha-256 is on the list, and how many."""
    words = F.array_distinct(F.filter(F.split(F.lower(text_col), r"[^a-z]+"), lambda w: F.length(w) > 1))
    hashed = texts.select(id_col, F.explode(words).alias("w")).select(id_col, F.sha2(F.concat(F.lit(salt), "w"), 256).alias("digest"))
    return hashed.join(hashes, "digest", "left_semi").groupBy(id_col).agg(F.count("*").alias("n_hits"))
