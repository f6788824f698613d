"""CSV records and JSON arrays over many splits, against plain readers of the whole text."""

import json
import os
import random

import pytest

from plantpulse.sources import readers as S
from plantpulse.sources import splits


@pytest.fixture(params=["64", "300", "134217728"])
def split_size(spark, request):
    """Bytes of a split: from a few lines to the whole file."""
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield int(request.param)
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


def plain_csv(text):
    """Records as lists of cells, read one character after another; None at the first fault. Blank records are left out."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    records, record, cell, i, n = [], [], "", 0, len(text)

    def end_record():
        nonlocal record
        if not (len(record) == 1 and not record[0].strip()):
            records.append([c.strip() for c in record])
        record = []

    while i < n:
        while i < n and text[i] in " \t":
            i += 1
        cell = ""
        if i < n and text[i] == '"':
            i += 1
            while True:
                if i >= n:
                    return None
                if text[i] == '"' and text[i + 1 : i + 2] == '"':
                    cell, i = cell + '"', i + 2
                elif text[i] == '"':
                    i += 1
                    break
                else:
                    cell, i = cell + text[i], i + 1
            if i < n and text[i] not in ",\n":
                return None
        else:
            while i < n and text[i] not in ",\n":
                if text[i] == '"':
                    return None
                cell, i = cell + text[i], i + 1
        record.append(cell)
        if i >= n or text[i] == "\n":
            end_record()
            i += 1
        else:
            i += 1
            if i >= n:
                record.append("")
                end_record()
    return records


def make_csv(rng, n):
    cell = lambda: rng.choice(["a", "b c", "", "12", '"q"', '"x, y"', '"two\nlines"', '"a ""quoted"" word"', ' "lead"', '"\n\n"', '""', "é", '"say ""hi""\n, you"'])
    lines = ["one,two , three"]
    for _ in range(n):
        lines.append(rng.choice(["", "  "]) if rng.random() < 0.1 else ",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))))
    return rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


def found_csv(df):
    rows = sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return [tuple(c or "" for c in r[1:]) for r in rows]


@pytest.mark.parametrize("seed", range(3))
def test_csv_records_are_those_of_a_plain_reading(spark, tmp_path, split_size, seed):
    rng = random.Random(seed)
    text = ("\ufeff" if seed == 1 else "") + make_csv(rng, 150)
    path = write(tmp_path, "a.csv", text)
    df = S.read_csv(spark, path)
    assert df.columns == ["row_no", "one", "two", "three"]
    assert split_size > 1000 or spark.read.text(path).rdd.getNumPartitions() > 3
    header, *want = plain_csv(text)
    assert found_csv(df) == [tuple((*r, "", "", "")[:3]) for r in want]


def test_csv_of_several_files(spark, tmp_path, split_size):
    rng = random.Random(9)
    texts = [make_csv(rng, 40) for _ in range(3)]
    for i, text in enumerate(texts):
        write(tmp_path, f"p{i}.csv", text)
    want = [tuple((*r, "", "", "")[:3]) for text in texts for r in plain_csv(text)[1:]]
    assert found_csv(S.read_csv(spark, str(tmp_path))) == want


@pytest.mark.parametrize("bad, line", [('a "b",2,3', 52), ('"a" b,2,3', 52), ('1,"a""b"c,3', 52), ('"open,2,3', 52), ('"two\nlines" x,2,3', 53)])
def test_csv_faults_name_their_line(spark, tmp_path, split_size, bad, line):
    good = '1,"two, parts",3\n' * 50
    text = "one,two,three\n" + good + bad + "\n" + good
    assert plain_csv(text) is None and plain_csv("one,two,three\n" + good) is not None
    with pytest.raises(S.BadFile, match=f"line {line}"):
        S.read_csv(spark, write(tmp_path, "bad.csv", text))


def test_random_csv_is_refused_when_a_plain_reading_refuses_it(spark, tmp_path):
    rng = random.Random(3)
    outcomes = set()
    for k in range(14):
        text = "one,two,three\n" + "".join(rng.choice(['"', '"', ",", "\n", "a", " "]) for _ in range(rng.randint(5, 25)))
        want = plain_csv(text)
        outcomes.add(want is None)
        path = write(tmp_path, f"{k}.csv", text)
        if want is None:
            assert splits.CsvRecords(spark, path).error
        else:
            assert found_csv(S.read_csv(spark, path)) == [tuple((*r, "", "", "")[:3]) for r in want[1:]]
    assert outcomes == {True, False}


def make_items(rng, n):
    values = ["a", "}{", '"', "\\", '\\"}', "[", "é\n", 1.5, None, True, {"in": {"er": ["}", {}]}}, [], ["]", "{"], ""]
    return [{f"k{j}": rng.choice(values) for j in range(rng.randint(0, 4))} for _ in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
def test_array_elements_are_those_of_a_plain_reading(spark, tmp_path, split_size, indent):
    rng = random.Random(5)
    parts = [make_items(rng, n) for n in (60, 0, 7)]
    for i, items in enumerate(parts):
        write(tmp_path, f"p{i}.json", ("\ufeff" if i == 2 else " ") + json.dumps(items, indent=indent) + "\n")
    found = sorted((r["row_no"], json.loads(r["raw"])) for r in S.read_json_array(spark, str(tmp_path)).collect())
    want = [x for items in parts for x in items]
    assert [n for n, _ in found] == list(range(1, len(want) + 1)) and [x for _, x in found] == want


@pytest.mark.parametrize(
    "text, message",
    [("5", "item 31 is"), ('"a}b"', "item 31 is"), ("null", "item 31 is"), ("[{}]", "item 31 is"), ("{]}", "item 31 is"), ('{"a":1} {"b":2}', "item 32 is")],
)
def test_array_faults_name_their_item(spark, tmp_path, split_size, text, message):
    good = ",".join(['{"a": "x}", "b": {"c": [1]}}'] * 30)
    with pytest.raises(S.BadFile, match=message):
        S.read_json_array(spark, write(tmp_path, "bad.json", f"[{good},{text},{good}]"))
    for tail, place in (("", "item 3[01] is"), (",", "not a valid JSON array: item 31"), (",5]", "item 31"), ("] x", "item 31"), (',{"a', "item 31")):
        with pytest.raises(S.BadFile, match=place):
            S.read_json_array(spark, write(tmp_path, f"tail{len(tail)}.json", f"[{good}{tail}"))
