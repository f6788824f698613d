import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import personal, secrets

from .conftest import result


def secret_spans(text):
    out = []
    for o, (kind, _, pattern, group, least) in enumerate(secrets.RULES):
        out += [(m.start(), o, kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def digests(spans, kinds):
    text = lambda x: ",".join(f"{k}:{s}:{e}" for k, s, e in x)
    base = [x for x in spans if x[0] in kinds]
    return (*[sum(x[0] == k for x in spans) for k in kinds], hashlib.sha256(text(base).encode()).hexdigest(), text(spans))


def test_secrets_of_all_rows(spark, docs, doc_rows, nothing, clashing):
    def found(table):
        _, findings = secrets.update_ledger(table)
        return secrets.findings_by_path(table, findings).select("path", *secrets.digest(secrets.BASE_KINDS))

    want = sorted(((r[0], *digests(secret_spans(r[1] or ""), secrets.BASE_KINDS)) for r in doc_rows), key=repr)
    assert result(found(docs)) == want and result(found(clashing)) == want and found(nothing).count() == 0


def test_only_new_blobs_and_rule_versions_are_scanned(spark):
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(1, "token: abcdefgh1"), (2, "nothing"), (3, "token: abcdefgh1")], schema)
    ledger, findings = secrets.update_ledger(first)
    assert ledger.select("blob").distinct().count() == 2 and ledger.count() == 2 * len(secrets.RULES)
    more = spark.createDataFrame([(1, "token: abcdefgh1"), (4, "AKIA" + "A" * 12)], schema)
    _, contents = secrets.blobs(more)
    assert [r.text for r in secrets.unseen(contents, ledger).collect()] == ["AKIA" + "A" * 12]
    ledger, findings = secrets.update_ledger(more, ledger, findings)
    assert result(secrets.findings_by_path(more, findings).selectExpr("path", "transform(spans, x -> x.kind) k")) == [(1, ["assign"]), (4, ["access"])]
    raised = tuple((k, v + (k == "assign"), *rest) for k, v, *rest in secrets.RULES)
    assert {tuple(r.rules) for r in secrets.unseen(contents, ledger, raised).collect()} == {(0,)}
    ledger, findings = secrets.update_ledger(more, ledger, findings, raised)
    assert result(secrets.findings_by_path(more, findings, raised).selectExpr("path", "size(spans) n")) == [(1, 1), (4, 1)]


def personal_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and personal.luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+%1234 ()\né", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert sorted(personal.base_spans(text)) == personal_base(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="tokenABCDEFf0123456789 =:\"'_-AKI\nſK", max_size=80))
def test_secret_scan_is_that_of_the_patterns(text):
    assert [(k, s, e) for k, _, s, e in secrets.scan(text)] == secret_spans(text)


def test_luhn():
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")


def test_base_spans_stay_and_more_are_added(spark, docs, doc_rows, nothing, clashing):
    out = result(personal.personal_spans(docs).select("doc_id", *secrets.digest(personal.BASE_KINDS)))
    base = lambda t: digests(sorted(personal_base(t or ""), key=lambda x: (x[1], personal.BASE_KINDS.index(x[0]))), personal.BASE_KINDS)
    assert [x[:6] for x in out] == sorted(((r[0], *base(r[1])[:5]) for r in doc_rows), key=repr)
    assert result(personal.personal_spans(clashing)) == result(personal.personal_spans(docs))
    assert personal.personal_spans(nothing).count() == 0
    texts = [(i, f"please call my phone (555) 321-{1000 + i} or write to a{i}@example.org today") for i in range(40)]
    texts += [(100 + i, f"order no 666-00-{1000 + i} x+1 555 222 33{i % 10}4 then") for i in range(40)]
    found = personal.personal_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    kinds = {k for r in found if r.doc_id < 100 for k in [x.kind for x in r.spans]}
    assert "phone_local" in kinds and not any(x.kind == "national_id" for r in found for x in r.spans)


def test_reliable_labelers_are_found():
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(3000):
        y = rng.random() < 0.5
        vote = "".join("-0+"[1 if rng.random() < 0.2 else (2 if (rng.random() < p) == y else 0)] for p in (0.95, 0.9, 0.85, 0.5))
        counts["email", vote] = counts.get(("email", vote), 0) + 1
    belief = personal.reliabilities([(*k, n) for k, n in sorted(counts.items())])
    assert belief["email", "+++-"] > 0.95 and belief["email", "---+"] < 0.05
