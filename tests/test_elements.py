"""Elements, attributes and the detail pages they lead to, on values."""

from pyspark.sql import functions as F

from siftbase.operators import elements as EL

PAGE = "https://site.example.com/board/list.aspx?p=1"
RULES = [
    EL.Rule("path", r"(/board/view\d*\.aspx\?[^'\"\s)]+)"),
    EL.assigned("event", ["funcidx"], "/event/view.aspx?funcidx={}", r"\d+"),
    EL.assigned("idx", ["idx", "seq", "id"], "/board/view.aspx?idx={}"),
    EL.in_query("query", ["idx", "seq", "id"], "/board/view.aspx?idx={}"),
    EL.posted_back("postback", ["Select", "View"], "/event/view.aspx?funcidx={}"),
    EL.called("board call", ["goView", "detail"], "/board/view.aspx?idx={}", page="/board/"),
    EL.called("event call", ["schedule"], "/event/view.aspx?funcidx={}", said="행사"),
]
DETAIL = r"/(?:board|event)/view\d*\.aspx\?"


def pages(spark, *htmls, url=PAGE):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "i int, url string, html string")


def targets(spark, html, url=PAGE):
    found = EL.detail_candidates(pages(spark, html, url=url), ["i"], RULES, DETAIL).orderBy("pos").collect()
    return [(r.element, r.rule, r.target.removeprefix("https://site.example.com")) for r in found]


def test_elements_in_document_order(spark):
    html = """<!DOCTYPE html><p>1 < 2 <b>x</b><!-- <a href="/c">no</a> --><A HREF='/x?a=1&amp;b=2' title="a > b" title="later" data-x>t</A>
    <script type=text/javascript>if (a<b) go("<i>");</script><input disabled value=5 type="button"/><br>"""
    rows = EL.elements(pages(spark, html), ["i"]).orderBy("pos").collect()
    assert [r.element for r in rows] == ["p", "b", "a", "script", "input", "br"]
    assert [(a.name, a.value) for a in rows[2].attrs] == [("href", "/x?a=1&b=2"), ("title", "a > b"), ("title", "later"), ("data-x", "")]
    assert rows[3].body == 'if (a<b) go("<i>");' and rows[0].body is None
    assert [(a.name, a.value) for a in rows[4].attrs if a.name != "/"] == [("disabled", ""), ("value", "5"), ("type", "button")]
    flat = EL.element_attributes(EL.elements(pages(spark, html), ["i"]), ["i"]).where("element = 'a'").orderBy("place").collect()
    assert [r.name for r in flat] == ["href", "title", "title", "data-x"]


def test_candidates_of_each_kind(spark):
    assert targets(spark, '<a href="/board/view.aspx?idx=7">x</a>') == [("a", "link", "/board/view.aspx?idx=7")]
    assert targets(spark, "<button onclick=\"location='/board/view2.aspx?idx=8'\">x</button>") == [("button", "path", "/board/view2.aspx?idx=8")]
    assert targets(spark, "<div data-funcidx=12>x</div><tr data-seq='34'><td data-id=\"56\">") == [("div", "event", "/event/view.aspx?funcidx=12"), ("tr", "idx", "/board/view.aspx?idx=34"), ("td", "idx", "/board/view.aspx?idx=56")]
    assert targets(spark, "<script>load({idx: '90'})</script>") == [("script", "idx", "/board/view.aspx?idx=90")]
    assert targets(spark, "<a href=\"javascript:__doPostBack('g$Select','123')\">x</a>") == [("a", "postback", "/event/view.aspx?funcidx=123")]
    assert targets(spark, '<span class="btn-view" onclick="goView(45)">x</span>') == [("span", "board call", "/board/view.aspx?idx=45")]
    assert targets(spark, '<span onclick="schedule(45)" aria-label="행사 보기">x</span><span onclick="schedule(46)">y</span>') == [("span", "event call", "/event/view.aspx?funcidx=45")]


def test_page_rules_own_host_and_first_of_a_target(spark):
    assert targets(spark, '<b onclick="goView(45)">', url="https://site.example.com/other/list.aspx") == []
    assert targets(spark, '<a href="https://other.example.com/board/view.aspx?idx=7">x</a>') == []
    assert targets(spark, "<script>open('https://other.example.com/x?idx=77'); n = 1</script>") == []
    assert targets(spark, '<i data-idx="21"></i><a href="/board/view.aspx?idx=21#x">x</a>') == [("i", "idx", "/board/view.aspx?idx=21")]
    itself = targets(spark, '<i data-idx="3300">', url="https://site.example.com/board/view.aspx?idx=5")
    assert itself == [("page", "page", "/board/view.aspx?idx=5"), ("i", "idx", "/board/view.aspx?idx=3300")]


def test_awkward_pages(spark):
    assert EL.elements(pages(spark, None, "", "no tags < here", "<" + "a" * 20_000, "<p " + "x " * 20_000 + ">"), ["i"]).select("i").distinct().collect() == [(4,)]
    assert targets(spark, "<p>x</p>") == []
    assert EL.detail_candidates(pages(spark, "<p>").where(F.lit(False)), ["i"], RULES, DETAIL).count() == 0
