"""Incremental secret scans by a blob ledger, in DataFrame functions alone.

Every version of every path is content-addressed: its blob is the SHA-256 of the
text. The ledger holds the pairs of blob and rule version that have been scanned,
with the spans found. A scan takes only pairs that the ledger lacks, each blob
once however many paths have it, and findings are joined back to all paths.
Changing a rule changes the rule version, and so every blob is scanned anew.

Defined cases: a null text is the empty blob; repeated rows are versions with one
blob, and each gets the findings; null ids pass through, ids may have any type; of the
paths that have a blob the least reads it; spans of several kinds may overlap; very long
texts and texts with very many matches take time near proportional to them; other
columns are ignored; an empty table gives no rows and leaves the ledger as it is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .storage import write_table

# Fixed values. The first three are the base kinds, in order.
RULES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{24,}+",
    "private_key": r"-----BEGIN (?:[A-Z]{1,16} )?PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "google": r"AIza[A-Za-z0-9_-]{35}",
}
KINDS = tuple(RULES)
BASE = 3
FINDING = "array<struct<kind:int,start:int,end:int>>"


def rule_version(rules: dict = RULES) -> str:
    return hashlib.sha256("\n".join(f"{k} {v}" for k, v in rules.items()).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _holding(test):
    return lambda s: test(s["match"])


def _numbered(number: int):
    return lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def find_secrets(text: Column) -> Column:
    """All spans [kind, start, end] of a text."""
    lower = F.lower(text)
    # Cheap tests that every text with a match passes; only those are searched.
    may = {
        "assign": F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("api")),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{24}"),
        "private_key": F.contains(text, F.lit("PRIVATE KEY-----")),
        "github": text.rlike("gh[pousr]_"),
        "slack": F.contains(text, F.lit("xox")),
        "web_token": F.contains(text, F.lit("eyJ")),
        "google": F.contains(text, F.lit("AIza")),
    }
    holds = {
        "assign": lambda m: F.length(F.regexp_extract(m, RULES["assign"], 1)) >= 6,
        "access": lambda m: F.length(m) >= 20,
    }
    every = []
    for number, (kind, pattern) in enumerate(RULES.items()):
        found = spans.matches(text, pattern, may[kind])
        if kind in holds:
            found = F.filter(found, _holding(holds[kind]))
        every.append(F.transform(found, _numbered(number)))
    return F.concat(*every).cast(FINDING)


def scan(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows: blob, rule_version, found. versions: doc_id, text;
    ledger: what earlier calls returned."""
    named = versions.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), blob_of(F.col("text")).alias("blob"))
    blobs = named.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("owner"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version()).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    # A blob is read through one path that has it.
    owners = blobs.select("blob", F.col("owner.doc_id").alias("doc_id"))
    owned = named.join(
        owners.withColumnsRenamed({"doc_id": "o", "blob": "b"}),
        F.col("doc_id").eqNullSafe(F.col("o")) & (F.col("blob") == F.col("b")),
        "left_semi",
    )
    found = owned.select("blob", find_secrets(F.col("text")).alias("found"))
    return found.dropDuplicates(["blob"]).select("blob", F.lit(rule_version()).alias("rule_version"), "found")


def join_back(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id, blob and the spans found, for each row of versions."""
    named = versions.select("doc_id", blob_of(F.col("text")).alias("blob"))
    own = ledger.where((F.col("rule_version") == rule_version()) & (F.size("found") > 0)).select("blob", "found")
    return named.join(own, "blob", "left").select("doc_id", "blob", F.coalesce("found", F.array().cast(FINDING)).alias("found"))


def scan_and_report(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """join_back() after a scan of what the ledger lacks."""
    new = write_table(scan(versions, ledger), "ledger")
    return join_back(versions, new if ledger is None else ledger.unionByName(new))
