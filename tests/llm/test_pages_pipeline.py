import os
import re

import pytest

import corpus_pipeline
from plantpulse.llm import decontaminate, jaccard, pages, quality
from plantpulse.llm.queries import QUERIES, SQL

from .conftest import CLASHES, result

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href='/b'>B > C</a></ul></nav><!-- no > -->
<div class="cookie-notice">We use cookies</div><article><h1>Title {0}</h1><p>First &amp; <b>bo</b>ld<br>line&nbsp;two {0}
 x &lt; y<p>Second <span class="ad-slot">buy</span>part {0}<ul><li>one<li>two</ul>
<aside>aside</aside><form><input><button>go</button></form><section class="comments"><p>nice {0}</p></section></article>
<div class="sidebar">side</div><footer>&copy; 2024</footer></body></html>"""
MAIN = "Title {0}\nFirst & bold line two {0} x < y\nSecond part {0}\none\ntwo"


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text_of_articles(spark):
    rows = [(i, f"https://Host.example/{i}", PAGE.format(i)) for i in range(5)]
    rows += [(10, None, None), (11, "x", ""), (12, "https://a.b", "<p>open <b>text"), (13, "https://a.b", "no markup & more &am"), (0, "https://Host.example/0", PAGE.format(0))]
    out = result(pages.main_text(table(spark, rows)), "page_id", "text", "n_chars")
    want = [(i, MAIN.format(i)) for i in (0, *range(5))] + [(10, ""), (11, ""), (12, "open text"), (13, "no markup & more &am")]
    assert out == sorted(((i, t, len(t)) for i, t in want), key=repr)


def test_branches_that_all_pages_of_a_site_share_go(spark):
    body = "<html><body><div id=top>Same for all</div><div class=story2><p>Own text {0}</p><p>More {1}</p></div><div class=end>Links <a>a</a></div></body></html>"
    rows = [(i, f"http://one.example/{i}", body.format(i, i * i)) for i in range(12)] + [(99, "http://two.example/", body.format(1, 2))]
    out = {r.page_id: r.text for r in pages.main_text(table(spark, rows)).collect()}
    assert all(out[i] == f"Own text {i}\nMore {i * i}" for i in range(12))
    assert out[99] == "Same for all\nOwn text 1\nMore 2\nLinks a"
    tree = {(r.host, r.path): r for r in pages.style_tree(pages.parsed_pages(table(spark, rows))).collect()}
    assert tree["one.example", "body/div.top"].importance == 0 and tree["one.example", "body/div.story-"].content == pytest.approx(1)
    assert tree["two.example", "body/div.top"].importance == 1


def test_copies_count_once_and_main_text_outlives_its_wrapper(spark):
    body = "<body><div class=wrap><p>Text {0}</p></div></body>"
    held = "<body><div class=wrap>Same<article><p>Text {0}</p></article></div></body>"
    rows = [(i, "http://copied.example/", body.format(max(i, 60))) for i in range(100)]
    # The wrapper has one text for all pages but three, whose articles stay all the same.
    rows += [(100 + i, "http://held.example/", held.format(max(i, 27)) + f"<p id=n>{i}</p>") for i in range(30)]
    out = {r.page_id: r.text for r in pages.main_text(table(spark, rows)).collect()}
    assert all(out[i] == f"Text {max(i, 60)}" for i in range(100))
    assert all(out[100 + i].split("\n") == [f"Text {max(i, 27)}", str(i)] for i in range(30))


def test_role_words_weigh_and_do_not_decide(spark):
    body = "<p>Text {0}</p>"
    page = {
        "body": f"<body class='search has-sidebar'>{body}</body>",
        "article": f"<body><article class='post with-comments'>{body}</article></body>",
        "main": f"<body><div class='page sidebar'><main>{body}</main></div></body>",
        "right": f"<body><div id=content>{body}<div class=col-right>Same</div></div></body>",
        "inner": f"<body><article>{body}<div class=col-right>Same <b>box</b></div><ul><li>one</ul></article></body>",
        "top": f"<div class=hello>Same</div>{body}",
        "word": f"<body><div class=sidebar><article>{body}</article></div><p>Open {{0}}</p></body>",
    }
    rows = [(10 * k + i, f"http://{name}.example/", html.format(i)) for k, (name, html) in enumerate(page.items()) for i in range(6)]
    rows += [(900, "http://alone.example/", "<div class=sidebar>side</div><p>Text</p>")]
    out = {r.page_id: r.text for r in pages.main_text(table(spark, rows)).collect()}
    want = {"inner": "Text {0}\none", "word": "Open {0}"}
    assert out == {10 * k + i: want.get(name, "Text {0}").format(i) for k, name in enumerate(page) for i in range(6)} | {900: "Text"}
    # What differs throughout stays in spite of its name.
    varied = [(i, "http://varied.example/", "<div class=story-search>" + "".join(f"<{'h2 p ul dl pre'.split()[i * j % 5]}>Text {i}.{j}" for j in range(1, 9)) + "</div>") for i in range(5)]
    texts = {r.page_id: r.text for r in pages.main_text(table(spark, varied)).collect()}
    assert all(f"Text {i}.8" in texts[i] for i in range(5))


def test_pages_take_empty_tables_and_clashing_columns(spark):
    df = table(spark, [(1, "http://a.b/", PAGE.format(1))])
    assert pages.main_text(df.limit(0)).count() == 0
    assert result(pages.main_text(df.selectExpr("*", "'x' text", "'y' host", "'z' pieces"))) == result(pages.main_text(df))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not there")
def test_pages_of_the_driver_tables(spark):
    df = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    own = {r.page_id: r.html for r in df.collect()}
    for r in pages.main_text(df).collect():
        inside = re.search("<article>(.*)</article>", own[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", pages.html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>|<br>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not there")
def test_pipeline_stages_build_on_each_other(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(corpus_pipeline.pin(stage(spark, tables[-1], SF_DIR)))
        assert tables[-1].columns == docs.columns and 0 < tables[-1].count()
    raw, clean, single, free, mixed = tables
    kept = {r.doc_id for r in quality.quality_rules(raw).filter("kept").select("doc_id").collect()}
    assert {r.doc_id for r in clean.collect()} == kept
    near = result(jaccard.near_duplicates(clean), "doc_id", "component_id")
    assert {r.doc_id for r in single.collect()} == {c for _, c in near} and single.count() == len({c for _, c in near})
    leaks = {r.doc_id for r in decontaminate.leaks(single, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
    assert leaks and {r.doc_id for r in free.collect()} == {r.doc_id for r in single.collect()} - leaks
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in free.collect()}
    last = corpus_pipeline.run(spark, SF_DIR)
    assert last.filter("whole").count() == last.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not there")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert result(df, *columns) == sorted(cursor.fetchall(), key=repr)


def test_registered_names():
    assert [n for n in QUERIES if n != "pipeline"] and {n.split("_")[0] for n in QUERIES if n != "pipeline"} == {f"op{i}" for i in range(1, 14)}
    assert CLASHES
