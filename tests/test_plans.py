"""Search plans, page selectors, streaming, the sink and the package without its training-data part."""

import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from kotonami.functions import web
from kotonami.operators import search
from kotonami.plans import endpoints, fixtures
from kotonami.plans import queries as plans
from kotonami.sources import html, payloads
from kotonami.streaming import terms

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_search_is_an_equi_join_and_equals_the_nested_loop(spark):
    words, lexicon = plans._terms(spark), plans.lexicon(spark, SF)
    fast = search.search(words, lexicon)
    assert "NestedLoop" not in plan_of(fast)
    slow = search.search_nested_loop(words, lexicon)
    key = lambda r: (r.request_id, r.row)
    assert sorted(map(key, fast.collect())) == sorted(map(key, slow.collect()))


def test_literal_term_reaches_the_scan(spark, tmp_path):
    plans.lexicon(spark, SF).write.parquet(str(tmp_path / "lexicon"))
    found = spark.read.parquet(str(tmp_path / "lexicon")).where(search.matches_term("widget", "romaji")).select("id")
    assert "StringEndsWith" in plan_of(found) or "EndsWith" in plan_of(found)


def test_validity_drops_zero_and_empty(spark):
    rows = [(1, "h", "w", "y", "r", 5), (0, "h", "w", "y", "r", 5), (2, "", "w", "y", "r", 5), (3, "h", "w", "y", "r", 0), (4, "h", None, "y", "r", 5), (5, "0", "0", "0", "0", 1)]
    frame = spark.createDataFrame(rows, "id int, headword_id string, headword string, yomi_display string, romaji_display string, freq int")
    assert [r.id for r in frame.where(search.is_valid()).collect()] == [1, 5]


def test_two_breaks_before_one_sentence_give_it_twice():
    blocks = html._example_blocks(html.parse(fixtures._BLOCKS))
    assert len(blocks[0]["lines"]) == 2 and blocks[0]["lines"][0] == blocks[0]["lines"][1]


def test_selectors_on_broken_markup():
    page = html.parse('<div class="a b"><b>x<p>y</div><br/><!-- c --><span>z')
    assert [n.text("|") for n in page.find("div", "b")] == ["x|y"]
    assert page.comments() == [" c "]
    assert [n.text() for n in page.direct("span")] == ["z"]


def test_pages_that_break_give_null(spark):
    pages = ["<![foo[ x ]]>", '<a href="srchres.py">99999999999999999999</a>', None, "", '<a href="srchres.py">1_0</a>', "<br>" * 20_000 + "<font>x</font>"]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, page string")
    got = {r.i: r for r in frame.select("i", html.entry("page").alias("e"), html.example_blocks("page").alias("b")).collect()}
    assert got[0].e is None and got[0].b is None and got[1].e is None and got[2].e is None
    assert got[3].e.id == 0 and got[4].e.id == 10 and got[5].b == []


def test_links_with_other_attributes_first(spark):
    page = '<a class="x" href="one">1</a><A\nHREF = "two"><abbr href="no"><a title="href=" id="q" href="three"><a name="n">'
    frame = spark.createDataFrame([(page,)], "page string")
    assert frame.select(web.links(F.col("page"))).first()[0] == ["one", "two", "three"]


def test_no_requests_give_no_answers(spark):
    none = payloads.table(spark, "requests_word", [])
    assert endpoints.headwords(none, plans.lexicon(spark, SF)).count() == 0


def test_links_keep_order_and_status(spark):
    requests = payloads.table(spark, "requests_word", [(1, "widget", "NLB", 0), (2, "zzz", "NLT", 0), (3, "", "NLB", 0)])
    got = {r.request_id: r.envelope for r in endpoints.headword_links(requests, plans.lexicon(spark, SF)).collect()}
    assert got[1].status == 200 and got[1].result[0].url.startswith("https://nlb.ninjal.ac.jp/headword/")
    assert (got[2].status, got[2].error.code, got[2].result) == (404, 404, None)
    assert got[3].status == 500


def test_answers_are_written_as_json(spark, tmp_path):
    requests = payloads.table(spark, "requests_word", fixtures.SENTENCE_REQUESTS)
    answers = endpoints.example_sentences(requests, payloads.table(spark, "sentence_page", fixtures.SENTENCE_PAGES))
    payloads.write_answers(answers, str(tmp_path / "answers"))
    lines = spark.read.json(str(tmp_path / "answers"))
    assert lines.count() == len(fixtures.SENTENCE_REQUESTS)
    assert lines.where(F.contains("answer", F.lit('"status":404'))).count() == 2


def test_stream_of_terms_equals_the_batch(spark, tmp_path):
    requests = payloads.table(spark, "requests_word", [(1, "widget", "NLB", 0), (2, "ふうしくおて", "NLT", 0)])
    requests.write.json(str(tmp_path / "requests_word"))
    lexicon = plans.lexicon(spark, SF)
    stream = terms.headword_urls(payloads.stream(spark, str(tmp_path), "requests_word"), lexicon)
    terms.write_each_once(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("request_id", "word", "url").collect()
    batch = search.search(requests, lexicon).join(requests.select("request_id", "site"), "request_id")
    want = search.headword_urls(batch, F.col("site")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_package_does_not_need_the_training_data_part():
    code = (
        "import sys; sys.modules['kotonami.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert 'headword_urls' in e.queries(); assert 'pipeline' not in e.queries(); e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_links_of_long_tags_and_many_open_ones(spark):
    pages = [
        "<a " + 'x="y" ' * 20_000 + 'href="long">',
        "<a b " * 20_000 + '<a c="1" href="last">',
        '<a x="<a href=\'no\'" HREF = "one"><abbr href="no"><a\nhref=""><a data-x href="two" href="three">',
        '<a x="foo <a href="inner">',
        '<a title="a > b" href="sign"> <a name="n"> <a xhref="no"> href="no"',
        '<a "' * 20_000,
        None,
    ]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    began = time.time()
    got = {r.i: r.l for r in frame.select("i", web.links(F.col("html")).alias("l")).collect()}
    assert time.time() - began < 5
    assert got == {0: ["long"], 1: ["last"], 2: ["one", "", "two"], 3: ["inner"], 4: ["sign"], 5: [], 6: None}
