"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.arrow import map_rows
from plantpulse.session import pin

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the labelers and the classifier can add.
ADDED_KINDS = ("email_words", "phone_local", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS
#: The labelers of one span: its format, gazetteers of domains, issuers and dialling codes, words before it, and its edges.
LABELERS = ("format", "gazetteer", "context", "edges")

# A run of digits begins where no digit stands before it: a match that failed there fails further right as well, and
# a match never ends inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
EMAIL_WORDS = re.compile(r"[A-Za-z0-9._-]{2,40} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,40} ?[(\[]dot[)\]] ?[A-Za-z]{2,10}", re.I)
PHONE_LOCAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Gazetteers: fixed values.
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info example".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
DIAL_CODES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "7", "81", "86", "91", "55", "61")
CUES = {
    "email": "mail email e-mail contact write", "email_words": "mail email e-mail contact write", "ip": "ip address host server from",
    "card": "card visa credit payment pay", "phone": "phone tel call mobile fax", "phone_local": "phone tel call mobile fax",
    "national_id": "ssn social security id",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("version isbn order page vol no chapter build".split())
CONTEXT_CHARS = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches: the run of local-part characters before an at sign starts the match, if a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *x) for x in _emails(text)] if "@" in text else []
    if HAS_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


HAS_DIGIT = re.compile(r"[0-9]")


def added_candidates(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "(at)" in text.lower() or "[at]" in text.lower():
        found += [("email_words", m.start(), m.end()) for m in EMAIL_WORDS.finditer(text)]
    if HAS_DIGIT.search(text):
        found += [("phone_local", m.start(), m.end()) for m in PHONE_LOCAL.finditer(text)]
        found += [("national_id", m.start(), m.end()) for m in NATIONAL_ID.finditer(text)]
    return found


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One character per labeler: + for personal data, - against, 0 for no opinion."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    form = "+" if kind in BASE_KINDS else "0"
    if kind in ("email", "email_words"):
        known = "+" if re.split(r"[^A-Za-z]+", span.lower())[-1] in DOMAINS else "-"
    elif kind == "ip":
        known = "-" if int(span.split(".")[0]) in (0, 127) or int(span.split(".")[0]) >= 240 else "+"
    elif kind == "card":
        known = "+" if digits.startswith(ISSUERS) else "-"
    elif kind == "phone":
        known = "+" if digits.startswith(DIAL_CODES) else "-"
    elif kind == "phone_local":
        known = "+" if digits[0] not in "01" and digits[3] not in "01" else "-"
    else:
        known = "-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+"
    before = re.findall(r"[a-z-]+", text[max(0, start - CONTEXT_CHARS) : start].lower())[-5:]
    context = "+" if CUES[kind].intersection(before) else "-" if AGAINST.intersection(before) else "0"
    clear = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return form + known + context + ("+" if clear else "-")


def _near(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else "mark"


def features(text: str, kind: str, start: int, end: int) -> str:
    """The classifier's view of a span, as name=value parts: a bounded number of different texts."""
    span = text[start:end]
    marks = "".join(m for m in " -.()" if m in span)
    return "|".join((f"kind={kind}", f"length={min(9, (end - start) // 4)}", f"digits={min(9, sum(map(str.isdigit, span)) // 2)}",
                     f"before={_near(text, start - 1)}", f"after={_near(text, end)}", f"marks={marks}"))


def find_candidates(docs: DataFrame) -> DataFrame:
    """`doc_id, found` per row: base spans and further candidates with their votes and features."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = [*base_spans(text), *added_candidates(text)]
            spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            found.append([{"kind": k, "start": s, "end": e, "votes": votes(text, k, s, e), "features": features(text, k, s, e)} for k, s, e in spans])
        return {"doc_id": batch.column("doc_id"), "found": found}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,votes:string,features:string>>", run)


def reliabilities(counts: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that a span is personal data, for every (kind, votes), by expectation-maximisation.

    `counts` has a row per kind and vote pattern, at most kinds times 3 to the number of labelers. A labeler is
    described by how often it gives each vote for personal data and for the rest; all spans of the table count.
    """
    if not counts:
        return {}
    signs = np.array([[("-0+".index(v)) for v in pattern] for _, pattern, _ in counts])
    kinds, n = np.array([k for k, _, _ in counts]), np.array([c for _, _, c in counts], dtype=float)
    weight = {k: n[kinds == k].sum() for k in set(kinds)}
    p = np.clip(0.5 + (signs - 1).sum(axis=1) / (2 * signs.shape[1]), 0.05, 0.95)
    for _ in range(rounds):
        log = np.zeros((len(n), 2))
        for y, own in enumerate((1 - p, p)):
            for j in range(signs.shape[1]):
                # One count for every vote keeps rare votes possible, a further one expects labelers to be better than chance.
                seen = np.array([1.0 + (v == 2 * y) + (n * own)[signs[:, j] == v].sum() for v in range(3)])
                log[:, y] += np.log(seen / seen.sum())[signs[:, j]]
            for k in weight:
                log[kinds == k, y] += np.log((1 + (n * own)[kinds == k].sum()) / (2 + weight[k]))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return {(k, v): float(x) for (k, v, _), x in zip(counts, p, strict=True)}


def train(rows: list[tuple[str, float, int]], rounds: int = 200) -> dict[str, float]:
    """Logistic weights by feature part from (features, summed probability, count); a row per different features text."""
    names = sorted({part for f, _, _ in rows for part in f.split("|")})
    at = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, (f, _, _) in enumerate(rows):
        x[i, [at[part] for part in f.split("|")]] = 1
    total, n = np.array([s for _, s, _ in rows]), np.array([c for _, _, c in rows], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(rows) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (total - n * p) / n.sum() - 1e-4 * w
        w += 2.0 * grad
    return dict(zip([*names, ""], map(float, w), strict=True))


def score(weights: dict[str, float], features: str) -> float:
    z = weights.get("", 0.0) + sum(weights.get(part, 0.0) for part in features.split("|"))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def personal_spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`doc_id, spans` for every row of `docs`; spans are `kind, start, end` by start, then kind as listed.

    Base spans always stay; a further candidate stays when the classifier gives it at least `threshold`. Labelers'
    reliabilities and the classifier come from the candidates of all rows, through counts by vote pattern and by
    features, whose number does not grow with the rows. Null and empty texts have no spans, repeated rows give repeated
    results, an empty table gives an empty result, and other columns are not looked at.
    """
    rows = pin(find_candidates(docs))
    spans = rows.select(F.inline("found"))
    counts = spans.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()
    belief = reliabilities([tuple(r) for r in counts])
    by_features = spans.groupBy("kind", "features", "votes").count().collect()
    sums: dict[str, list[float]] = {}
    for r in by_features:
        own = sums.setdefault(r["features"], [0.0, 0])
        own[0] += belief[r["kind"], r["votes"]] * r["count"]
        own[1] += r["count"]
    weights = train([(f, s, c) for f, (s, c) in sorted(sums.items())])
    good = sorted(f for f in sums if score(weights, f) >= threshold and f.split("|")[0][5:] in ADDED_KINDS)
    # The texts of features are bounded in number, so their list is as well.
    kept = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS) | (x["features"].isin(*good) if good else F.lit(False)))
    return rows.select("doc_id", F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
