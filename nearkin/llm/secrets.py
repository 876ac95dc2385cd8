"""Secret scans with an incremental blob ledger.

Every text version is content-addressed (SHA-256). The ledger holds the (blob, rule version) pairs
that have been scanned, and their findings. A scan addresses all rows, takes the pairs that the
ledger lacks, scans one copy of each such blob whole, appends to the ledger and joins the findings
back to every path (row) that has the blob. A ledger that is named also keeps which blobs each path
has had, so ``history`` joins findings back to all paths and versions that any scan has seen.

Texts are reduced to one copy per blob before and after the shuffle (partial aggregation), so a
text with very many copies costs a row per task; findings are joined back by digest, a thin join
whose skew adaptive execution splits.

Scans that run at once, or a repeated task, may append a blob twice; the findings of a blob under a
rule version are a function of both, so readers take one row per blob. Every rule is read in time linear
in the text, however it is made up.

Defined results: a null text is the empty blob; texts are scanned whole, however long; repeated rows
each get their row; a null identifier is kept; an empty table gives an empty result. Only the
identifier and text columns are read, so others may have any name. Spans are in code points, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.runtime import new_folder

#: The base kinds, their patterns and least lengths (of the value, for assign).
BASE = {
    "assign": r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Kinds that the method adds. A pattern with a group means its span, else the whole match.
MORE = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    # from the start of a run of these letters only, so that no run is read again from each of its places
    "jwt": r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
    # a header line has no two dashes in a row, so that none holds the start of a key and no line is read twice
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[ \t\r]*\n(?:[A-Za-z](?:[A-Za-z]|-[A-Za-z])*: (?:[^-\n]|-[^-\n])*-?\n)*[A-Za-z0-9+/= \t\r\n]+-----END [A-Z ]*PRIVATE KEY-----",
    "url": r"[a-z][a-z0-9+.-]+://[^ \t\r\n\f\x0b/:@]+:[^ \t\r\n\f\x0b/:@]{4,}@",
}
#: Letters of a scheme; it starts with one of the first 26.
SCHEME = "abcdefghijklmnopqrstuvwxyz0123456789+.-"
#: What each kind needs to be in a text at all; kinds without an entry are always looked for.
HINT = {"access": ("AKIA",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack": ("xox",), "jwt": ("eyJ",), "pem": ("-----BEGIN",), "url": ("://",)}
KINDS = (*BASE, *MORE)
COMPILED = {k: re.compile(v) for k, v in (BASE | MORE).items()}
# a run of hex letters is either long enough or not: the same matches
COMPILED["hex"] = re.compile(rf"[0-9a-f]{{{LEAST['hex']},}}")


def rule_version(*rules: object) -> str:
    """Changes with anything that decides on findings."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


RULES = rule_version(list(BASE.items()), list(LEAST.items()), list(MORE.items()), list(HINT.items()), KINDS)

FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _matches(kind: str, text: str) -> Iterator[re.Match]:
    """The leftmost matches of a kind, which do not overlap."""
    if kind != "url":
        yield from COMPILED[kind].finditer(text)
        return
    # from each "://" back to the start of its scheme, so that a long run of letters is read once
    at = 0
    while (colon := text.find("://", at)) >= 0:
        before = text[at:colon]
        scheme = before[len(before.rstrip(SCHEME)) :].lstrip(SCHEME[26:])
        found = COMPILED[kind].match(text, colon - len(scheme)) if len(scheme) > 1 else None
        if found:
            yield found
        at = found.end() if found else colon + 3


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base spans and of all spans, in order."""
    base, more = [], []
    for k, kind in enumerate(KINDS):
        if any(h in text for h in HINT.get(kind, ("",))):
            group = 1 if kind == "jwt" else 0
            value = 1 if kind == "assign" else 0
            # a match is consumed whether or not it is long enough
            found = [(m.start(group), k, m.end(group)) for m in _matches(kind, text) if m.end(value) - m.start(value) >= LEAST.get(kind, 0)]
            (base if kind in BASE else more).extend(found)
    return sorted(base), sorted(base + more)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def findings(text: str) -> tuple[int, int, int, str, str]:
    base, every = spans(text)
    kinds = [k for _, k, _ in base]
    return kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [findings(t) for t in batch.column(1).to_pylist()]
        counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        texts = [pa.array([r[i] for r in rows], pa.string()) for i in (3, 4)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *texts], names=["blob", *NAMES])


NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table of the ledger; empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, folder: str, rules: str = RULES) -> DataFrame:
    """Scanned blobs of a rule version with their findings, a row per blob; empty if there is no ledger yet."""
    return _stored(spark, f"{folder}/rules={rules}", f"blob string, {FOUND}").dropDuplicates(["blob"])


def history(spark: SparkSession, folder: str, path_type: str = "long", rules: str = RULES) -> DataFrame:
    """(doc_id, blob, findings) of every path and version that scans with this ledger have seen, as
    far as they were scanned under the rule version."""
    seen = _stored(spark, f"{folder}/versions", f"doc_id {path_type}, blob string").distinct()
    return seen.join(ledger(spark, folder, rules), "blob").select("doc_id", "blob", *NAMES)


def scan(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the findings of its text; scanned blobs are added to the ledger at ``folder``, and
    the versions to its table of paths (by default a new ledger in the shared folder, without that table)."""
    spark = docs.sparkSession
    lasting = folder is not None
    folder = folder or new_folder(spark, "ledger")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    known = ledger(spark, folder)
    # one copy per blob comes first, so that copies meet in each task before any row is shuffled
    once = rows.groupBy("blob").agg(F.first("text").alias("text"))
    unseen = once.join(known.select("blob"), "blob", "left_anti").select("blob", "text")
    unseen.mapInArrow(_scan, f"blob string, {FOUND}").write.mode("append").parquet(f"{folder}/rules={RULES}")
    if lasting:
        paths = rows.select("doc_id", "blob").distinct()
        old = _stored(spark, f"{folder}/versions", paths.schema.simpleString()[7:-1].replace(":", " "))
        new = paths.join(old, paths["doc_id"].eqNullSafe(old["doc_id"]) & (paths["blob"] == old["blob"]), "left_anti")
        new.write.mode("append").parquet(f"{folder}/versions")
    return rows.select("doc_id", "blob").join(ledger(spark, folder), "blob").select("doc_id", *NAMES)
