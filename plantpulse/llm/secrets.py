"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.arrow import map_rows
from plantpulse.session import pin

#: Kinds in the order of ties, with pattern, the group whose length counts, and the least length. Raise the version of
#: a rule when it changes: blobs are then scanned again for that rule alone.
BASE_RULES = (
    ("assign", 1, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", 1, r"[0-9a-f]+", 0, 32),
)
ADDED_RULES = (
    ("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("web_token", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    ("host_token", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE_RULES + ADDED_RULES
BASE_KINDS = tuple(r[0] for r in BASE_RULES)
FINDING = "array<struct<kind:string,rule_version:int,start:int,end:int>>"

#: What a text must hold for a rule to match at all; a search for it is cheaper than the rule.
NEEDS = {"access": "AKIA", "private_key": "-----BEGIN ", "web_token": "eyJ"}
#: A run of 32 hex digits or more is what the hex rule keeps; shorter runs need not be matched one by one.
FAST = {"hex": r"[0-9a-f]{32,}"}


def scan(text: str, rules=RULES) -> list[tuple[str, int, int, int]]:
    """(kind, rule version, start, end) by start, then kind as listed; positions are code points, the end is exclusive."""
    found = []
    for order, (kind, version, pattern, group, least) in enumerate(rules):
        if NEEDS.get(kind, "") not in text:
            continue
        for m in re.finditer(FAST.get(kind, pattern), text, re.ASCII):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, version, m.end()))
    return [(kind, version, start, end) for start, _, kind, version, end in sorted(found)]


def blobs(docs: DataFrame, path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """`path, blob` per row, and one `blob, text` per distinct content; a null text is the empty blob."""
    text = F.coalesce("text", F.lit(""))
    versions = docs.select(F.col(path).alias("path"), F.sha2(text, 256).alias("blob"))
    contents = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    return versions, contents


def unseen(contents: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """`blob, text, rules`: distinct blobs, each with the indexes of the rules it has not been scanned for.

    `ledger` holds `blob, kind, rule_version` of all finished scans. Copies of a text meet by blob, and of each blob
    only one text is moved on.
    """
    first = contents.groupBy("blob").agg(F.first("text").alias("text"))
    current = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("rule_version")) for k, v, *_ in rules])
    if ledger is None:
        return first.withColumn("rules", F.sequence(F.lit(0), F.lit(len(rules) - 1)))
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "rule_version")).alias("_done"))
    open_rules = F.filter(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda i: ~F.array_contains(F.coalesce("_done", F.array()), F.get(current, i)))
    return first.join(done, "blob", "left").select("blob", "text", open_rules.alias("rules")).filter("size(rules) > 0")


def scan_blobs(rows: DataFrame, rules=RULES) -> DataFrame:
    """`blob, scanned, found` for rows of `unseen`: what was scanned for, and the findings."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"blob": batch.column("blob"), "scanned": [], "found": []}
        for text, chosen in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
            own = [rules[i] for i in chosen]
            out["scanned"].append([{"kind": r[0], "rule_version": r[1]} for r in own])
            out["found"].append([dict(zip(("kind", "rule_version", "start", "end"), x, strict=True)) for x in scan(text, own)])
        return out

    return map_rows(rows, f"blob string, scanned array<struct<kind:string,rule_version:int>>, found {FINDING}", run)


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules=RULES):
    """(ledger, findings) after a scan of what is new in `docs`.

    `ledger`: `blob, kind, rule_version` of everything scanned; `findings`: `blob, kind, rule_version, start, end`.
    Handing in the tables of earlier runs scans only blobs or rule versions that are new. Both tables are written
    before they are returned, so the scan happens once.
    """
    _, contents = blobs(docs)
    done = pin(scan_blobs(unseen(contents, ledger, rules), rules))
    scanned = done.select("blob", F.inline("scanned"))
    found = done.select("blob", F.inline("found"))
    return (scanned if ledger is None else ledger.unionByName(scanned)), (found if findings is None else findings.unionByName(found))


def findings_by_path(docs: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """`path, spans`: the current findings of every row's blob, in order.

    Every row gets a result, an empty one without findings. Null texts are empty, repeated rows give repeated results
    and an empty table gives an empty result; other columns are not looked at.
    """
    versions, _ = blobs(docs)
    current = F.array(*[F.lit(f"{k}:{v}") for k, v, *_ in rules])
    kinds = F.array(*[F.lit(k) for k, *_ in rules])
    rows = findings.filter(F.array_contains(current, F.concat_ws(":", "kind", "rule_version")))
    per = rows.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", F.array_position(kinds, F.col("kind")).alias("order"), "kind", "end"))).alias("spans"))
    return versions.join(per, "blob", "left").select("path", F.coalesce("spans", F.array()).alias("spans"))


def joined(spans: str) -> str:
    """SQL text for kind:start:end of an array of spans, comma-joined."""
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def digest(kinds: tuple[str, ...]) -> list:
    """Columns n_<kind>, base_sha256 and spans from an ordered array column `spans`."""
    names = ", ".join(f"'{k}'" for k in kinds)
    counts = [F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("bigint").alias(f"n_{k}") for k in kinds]
    base = F.sha2(F.expr(joined(f"filter(spans, x -> x.kind in ({names}))")), 256).alias("base_sha256")
    return [*counts, base, F.expr(joined("spans")).alias("spans")]

