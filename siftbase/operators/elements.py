"""Elements of a page and their attributes in document order, and the detail pages they lead to.

One pass of a pattern finds start tags and whole scripts; comments and what
stands inside quotes are no tags.  Candidates for detail pages come from every
element a visitor could press: links, buttons, scripts, event handlers and data
attributes.  What an element says is one text, and an ordered list of rules
turns the first argument that it finds there into a target; the rules of a site
are arguments.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftbase.functions import text as T, urls as U
from siftbase.operators.html import unescape_entities
from siftbase.session import computed_once

#: A comment, a script with its text, or a start tag; quotes may hold angle brackets.
TAG = r"""(?is)(<!--.*?-->|<script\b(?:"[^"]*"|'[^']*'|[^'">]++)*+>.*?</script\s*>|<[a-z][a-z0-9:-]*(?=[\s/>])(?:"[^"]*"|'[^']*'|[^'">]++)*+>)"""
START = r"""(?is)^<([a-z][a-z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>"""
ATTRIBUTE = r"""(?is)([^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)"""

#: Elements that can be pressed, by name, by attribute and by a part of their class.
PRESSED = ("script", "button")
INPUT_TYPES = ("button", "submit")
HANDLERS = ("onclick", "data-url", "data-href", "data-funcidx", "data-func-idx", "data-idx", "data-id", "data-seq")
CLASS_PARTS = ("btn", "more", "detail", "view")

#: Attributes whose value is an id, and the argument it stands for.
DATA_IDS = {"data-idx": "idx", "data-id": "idx", "data-seq": "idx", "data-funcidx": "funcidx", "data-func-idx": "funcidx"}


def attributes(tag: Column) -> Column:
    """``name`` (lower case) and ``value`` (entities resolved) of every attribute of a start tag, in order; the first of a name counts."""
    parts = F.regexp_extract_all(F.regexp_extract(tag, START, 2), F.lit(ATTRIBUTE), F.lit(1))
    raw = lambda p: F.regexp_extract(p, r"(?s)^[^=]*=\s*(.*)$", 1)
    bare = lambda p: F.regexp_replace(raw(p), r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.transform(parts, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1)).alias("name"), unescape_entities(bare(p)).alias("value")))


def attribute(attrs: Column | str, name: str) -> Column:
    """Value of one attribute, null if the element has none."""
    return F.get(F.filter(T.col(attrs), lambda a: a["name"] == name), F.lit(0))["value"]


def elements(pages: DataFrame, keep: Sequence[str]) -> DataFrame:
    """O-16, O-56: ``pos``, ``element``, ``attrs`` and ``body`` (a script's text, else null) of every element of ``html``, in document order."""
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(1))).alias("pos", "tag")).where(~F.startswith("tag", F.lit("<!--")))
    name = F.lower(F.regexp_extract("tag", START, 1))
    body = F.when(name == "script", F.regexp_extract("tag", r"""(?is)^<script\b(?:"[^"]*"|'[^']*'|[^'">]++)*+>(.*?)</script\s*>$""", 1))
    return computed_once(rows, {"element": name, "attrs": attributes(F.col("tag")), "body": body}, [*keep, "pos"])


def element_attributes(elements_: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per attribute: ``pos``, ``element``, ``place``, ``name``, ``value``."""
    return elements_.select(*keep, "pos", "element", F.posexplode("attrs").alias("place", "a")).select(*keep, "pos", "element", "place", "a.name", "a.value")


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds an argument (its first group); ``template`` with ``{}`` for it is the target, ``{}`` alone the argument itself.

    ``page`` must match the page's URL and ``said`` the element's text, where given.
    """

    name: str
    pattern: str
    template: str = "{}"
    page: str | None = None
    said: str | None = None


def assigned(name: str, names: Sequence[str], template: str, digits: str = r"\d{2,10}", page: str | None = None) -> Rule:
    """``name=12``, ``name: '12'``, ``name, 12``."""
    return Rule(name, rf"""(?i)(?:{"|".join(names)})\s*[=:,]\s*['"]?({digits})['"]?""", template, page)


def in_query(name: str, names: Sequence[str], template: str, digits: str = r"\d{1,10}", page: str | None = None) -> Rule:
    """``?name=12`` or ``&name=12``."""
    return Rule(name, rf"(?i)[?&](?:{'|'.join(names)})=({digits})", template, page)


def called(name: str, functions: Sequence[str], template: str, page: str | None = None, said: str | None = None) -> Rule:
    """``name...(12`` or ``name...('12'``."""
    return Rule(name, rf"""(?i)(?:{"|".join(functions)})\w*\s*\(\s*['"]?(\d{{2,10}})['"]?""", template, page, said)


def posted_back(name: str, words: Sequence[str], template: str) -> Rule:
    """``__doPostBack(...)`` whose arguments hold one of the words and a number behind it."""
    return Rule(name, rf"(?i)__doPostBack\s*\([^)]*(?:{'|'.join(words)})[^)]*?(\d{{2,10}})", template)


def _foreign(host: Column) -> Column:
    """Pattern of absolute links to other hosts, whose ids mean nothing here."""
    return F.concat(F.lit(r"(?i)https?://(?!\Q"), host, F.lit(r"""\E(?:[:/?#\s'")]|$))[^\s'"<>)]*"""))


#: Attributes that tell what an element leads to; each becomes a column ``a_name``.
READ = ("href", "value", "aria-label", "type", "role", "class", *HANDLERS)


def _said(base: str) -> Column:
    """What an element says beside a link of its own: script text, label, handler, data; links to other hosts are cut out."""
    href = F.col("a_href")
    parts = [F.when(~href.rlike(r"(?i)^https?://"), href), F.col("body"), *[F.col(f"`a_{a}`") for a in ("value", "aria-label", "onclick", "data-url", "data-href")]]
    parts += [F.concat(F.lit(f"{argument}="), F.col(f"`a_{a}`")) for a, argument in DATA_IDS.items()]
    return F.regexp_replace(F.concat_ws(" ", *parts), _foreign(U.host(base)), F.lit(""))


def _pressed() -> Column:
    has = lambda name: F.col(f"`a_{name}`").isNotNull()
    tests = [F.col("element").isin(*PRESSED), (F.col("element") == "a") & has("href"), (F.col("element") == "input") & F.lower("a_type").isin(*INPUT_TYPES)]
    tests += [F.col("a_role") == "button", F.col("a_class").rlike("|".join(CLASS_PARTS)), *[has(a) for a in HANDLERS]]
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


def detail_candidates(pages: DataFrame, keep: Sequence[str], rules: Sequence[Rule], detail: str) -> DataFrame:
    """O-56: detail pages that the elements of each page lead to: ``target``, ``pos`` (-1: the page itself), ``element``, ``rule``, ``argument``.

    ``detail`` is a pattern of the URLs that count as details, on the page's own
    host.  An element's own link to one comes first; else the first rule that finds an argument in what
    the element says.  The first element of a target stands for it.
    """
    # each step reads values that are computed once, since later ones read them many times
    place = [*keep, "url", "pos", "element"]
    named = computed_once(elements(pages, [*keep, "url"]), {f"a_{a}": attribute("attrs", a) for a in READ}, [*place, "body"]).where(_pressed())
    known = computed_once(named, {"said": _said("url"), "href": F.coalesce("a_href", F.lit(""))}, place).withColumn("link", U.canonical(U.resolve("href", "url")))
    own = F.when((F.col("href") != "") & F.col("link").rlike(detail) & (U.host("link") == U.host("url")), F.struct(F.lit("link").alias("rule"), F.lit(None).cast("string").alias("argument"), F.col("link").alias("href")))

    def found(rule: Rule) -> Column:
        argument = F.regexp_extract("said", rule.pattern, 1)
        fits = argument != ""
        for pattern, column in ((rule.page, "url"), (rule.said, "said")):
            fits = fits & F.col(column).rlike(pattern) if pattern else fits
        head, _, tail = rule.template.partition("{}")
        return F.when(fits, F.struct(F.lit(rule.name).alias("rule"), argument.alias("argument"), F.concat(F.lit(head), argument, F.lit(tail)).alias("href")))

    told = computed_once(known, {"c": F.coalesce(own, *[found(r) for r in rules])}, place).where("c IS NOT NULL").select(*place, "c.*")
    told = told.withColumn("target", U.canonical(U.resolve("href", "url")))
    itself = pages.select(*keep, "url", F.lit(-1).alias("pos"), F.lit("page").alias("element"), F.lit("page").alias("rule"), F.lit(None).cast("string").alias("argument"), F.col("url").alias("href"), U.canonical("url").alias("target"))
    every = told.unionByName(itself.where(F.col("target").rlike(detail))).where("target IS NOT NULL")
    first = every.groupBy(*keep, "target").agg(F.min(F.struct("pos", "element", "rule", "argument")).alias("f"))
    return first.select(*keep, "target", "f.*")
