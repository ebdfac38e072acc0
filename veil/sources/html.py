"""Stored pages to flat node tables. The parser is the only Python stage in batch; it emits flat rows and
everything else (labels, roles, contexts, ids, page text order) is DataFrame code over them."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from veil import rules
from veil.functions.text import one_space, sub, trimmed

# Workers need no installed copy of this package: the parser travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = (
    "struct<pos:int,last:int,path:array<int>,tag:string,attrs:map<string,string>,text:string,own:string,hidden:boolean>"
)
PARSED_AT_ONCE = 1 << 18
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript", "template"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table",
          "td", "th", "tr", "ul", "option", "select", "textarea", "button"}
_REFERENCE = re.compile(r"&(?!#(?:[0-9]+|[xX][0-9A-Fa-f]+);)([A-Za-z][A-Za-z0-9]*;)?")
_SELF_CLOSING = {"p", "li", "option", "tr", "td", "th", "dt", "dd"}


class _Flat(HTMLParser):
    """Open-tag stack to flat nodes; text is kept once, nodes refer to it by range."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes, self.stack, self.chunks = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in _SELF_CLOSING and self.stack and self.nodes[self.stack[-1]]["tag"] == tag:
            self._close(tag)
        if tag in _BLOCK:
            self.chunks.append((None, "\n"))
        given = {k: (v or "") for k, v in attrs}
        parent = self.nodes[self.stack[-1]] if self.stack else None
        hidden = bool(parent and parent["hidden"]) or given.get("aria-hidden") == "true" or "hidden" in given
        node = {"pos": len(self.nodes), "path": list(self.stack), "tag": tag, "attrs": given, "hidden": hidden,
                "from": len(self.chunks), "to": len(self.chunks), "last": len(self.nodes)}
        self.nodes.append(node)
        if tag not in _VOID:
            self.stack.append(node["pos"])

    def handle_endtag(self, tag):
        if any(self.nodes[i]["tag"] == tag for i in self.stack):
            while self._close(tag) != tag:
                pass
        if tag in _BLOCK:
            self.chunks.append((None, "\n"))

    def _close(self, _tag):
        node = self.nodes[self.stack.pop()]
        node["to"], node["last"] = len(self.chunks), len(self.nodes) - 1
        return node["tag"]

    def handle_data(self, data):
        if not any(self.nodes[i]["tag"] in _SILENT for i in self.stack):
            self.chunks.append((self.stack[-1] if self.stack else None, data))

    def finish(self):
        self.close()
        while self.stack:
            self._close("")


def _squeeze(pieces) -> str:
    lines = (" ".join(line.split()) for line in "".join(pieces).split("\n"))
    return "\n".join(line for line in lines if line)


def _open_kept(html: str) -> str:
    """The page with every reference that its semicolon does not close escaped, so that it is read as it is written."""
    return _REFERENCE.sub(lambda m: m.group() if m.group(1) in html5 else "&amp;" + (m.group(1) or ""), html)


def _flatten(html: str) -> tuple[str, list]:
    page = _Flat()
    page.feed(html or "")
    page.finish()
    own: dict[int, list] = {}
    for owner, text in page.chunks:
        own.setdefault(owner, []).append(text)
    rows = []
    for n in page.nodes:
        pieces = [t for _o, t in page.chunks[n["from"]:n["to"]]]
        text = "" if n["tag"] in ("html", "head") else _squeeze(pieces)
        rows.append({"pos": n["pos"], "last": n["last"], "path": n["path"], "tag": n["tag"],
                     "attrs": n["attrs"], "text": text, "own": _squeeze(own.get(n["pos"], [])),
                     "hidden": n["hidden"]})
    title = next((r["text"] for r in rows if r["tag"] == "title"), "")
    return title, rows


def parse_pages(pages: DataFrame, keys: list[str], html: str = "html", open_references: bool = True) -> DataFrame:
    """Adds ``title`` and ``nodes`` (document order, with subtree ranges) to the key columns.

    A reference without its semicolon (``&amp`` of a text cut short) is resolved as browsers do, or kept as written without ``open_references``.
    """
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + f", title string, nodes array<{NODE}>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Nodes take many times a page's bytes, so only those of PARSED_AT_ONCE characters are held.
            for _, some in batch.groupby(batch[html].str.len().fillna(0).cumsum() // PARSED_AT_ONCE, sort=False):
                out = some[keys].copy()
                parsed = [_flatten(h if open_references else _open_kept(h or "")) for h in some[html]]
                out["title"] = [t for t, _ in parsed]
                out["nodes"] = [n for _, n in parsed]
                yield out

    return pages.select(*keys, html).mapInPandas(run, schema)


def attr(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def _has_attr(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], F.lit(name))


def _within(node: Column, outer: Column) -> Column:
    return (node["pos"] > outer["pos"]) & (node["pos"] <= outer["last"])


def is_editable(node: Column) -> Column:
    return _has_attr(node, "contenteditable") & (F.lower(attr(node, "contenteditable")) != "false")


def is_interactive(node: Column) -> Column:
    return (
        node["tag"].isin("button", "select", "textarea") | ((node["tag"] == "a") & _has_attr(node, "href"))
        | ((node["tag"] == "input") & (F.lower(attr(node, "type")) != "hidden"))
        | attr(node, "role").isin("button", "link") | is_editable(node)
    )


def input_type(node: Column) -> Column:
    return F.lower(attr(node, "type"))


def role_of(node: Column) -> Column:
    kind = input_type(node)
    as_input = (F.when(kind.isin("checkbox", "radio"), kind).when(kind.isin("submit", "button"), "button").otherwise("textbox"))
    return (
        F.when(_has_attr(node, "role"), attr(node, "role")).when(node["tag"] == "button", "button")
        .when(node["tag"] == "a", "link").when(node["tag"] == "select", "combobox").when(node["tag"] == "textarea", "textbox")
        .when(node["tag"] == "input", as_input).when(is_editable(node), "textbox").otherwise("")
    )


def _by_ids(nodes: Column, ids: Column) -> Column:
    """Texts of the nodes an id list points at, in list order, joined by blanks."""
    parts = F.transform(F.filter(F.split(trimmed(ids), r"\s+"), lambda i: i != ""), lambda i: F.get(
        F.filter(nodes, lambda n: attr(n, "id") == i), 0)["text"])
    return F.array_join(F.filter(F.transform(parts, one_space), lambda t: t != ""), " ")


def glyph_hint(text: Column) -> Column:
    """A symbol-only label with the word a person reads it as."""
    glyph = sub(text, r"\s+", "")
    word = F.coalesce(*[F.when((F.char_length(glyph) == 1) & F.contains(F.lit(marks), glyph), F.lit(name))
                        for marks, name in rules.GLYPH_WORDS])
    plain = text.rlike(r"[\p{L}\p{N}]") | word.isNull()
    return F.when(plain, text).otherwise(F.concat(text, F.lit(" (icon: "), word, F.lit(")")))


def accessible_label(node: Column, nodes: Column) -> Column:
    """First non-empty of: aria-label, labelled-by text, field value or placeholder, selected option, own text, title, image alt, wrapper."""
    inside = F.filter(nodes, lambda n: _within(n, node))
    options = F.filter(inside, lambda n: n["tag"] == "option")
    chosen = F.get(F.filter(options, lambda o: _has_attr(o, "selected")), 0)["text"]
    picked = F.coalesce(chosen, F.get(options, 0)["text"], F.lit(""))
    alt = F.get(F.filter(inside, lambda n: (n["tag"] == "img") & (trimmed(attr(n, "alt")) != "")), 0)["attrs"]["alt"]
    wrappers = F.slice(F.reverse(node["path"]), 1, rules.WRAPPER_DEPTH)
    around = F.filter(F.transform(wrappers, lambda p: F.get(nodes, p)), lambda w: (w["text"] != "") | (
        F.size(F.filter(nodes, lambda n: _within(n, w) & is_interactive(n))) > 1))
    wrapper = F.get(around, 0)
    crowded = F.size(F.filter(nodes, lambda n: _within(n, wrapper) & is_interactive(n))) > 1
    drawn = F.when(crowded | (F.length(one_space(wrapper["text"])) > rules.WRAPPER_LABEL_MAX), "").otherwise(one_space(wrapper["text"]))
    value = F.coalesce(F.nullif(attr(node, "value"), F.lit("")), attr(node, "placeholder"))
    is_input = node["tag"] == "input"
    blank = F.lit("")
    labelled = F.when(attr(node, "aria-labelledby") != "", _by_ids(nodes, attr(node, "aria-labelledby"))).otherwise(blank)
    return (
        F.when(attr(node, "aria-label") != "", trimmed(attr(node, "aria-label"))).when(labelled != "", labelled)
        .when(is_input & (value != ""), trimmed(value)).when(node["tag"] == "select", trimmed(picked))
        .when(~is_input & (node["text"] != ""), glyph_hint(node["text"]))
        .when(attr(node, "title") != "", trimmed(attr(node, "title"))).when(alt.isNotNull(), trimmed(alt))
        .when(is_input & input_type(node).isin("submit", "button", "reset", "image"), F.coalesce(drawn, blank)).otherwise(blank)
    )


def select_options(node: Column, nodes: Column) -> Column:
    """Enabled options of a select: single-spaced, 60 characters each, the first 30."""
    options = F.filter(nodes, lambda n: _within(n, node) & (n["tag"] == "option") & ~_has_attr(n, "disabled"))
    texts = F.filter(F.transform(options, lambda o: F.left(one_space(o["text"]), F.lit(rules.MAX_OPTION))), lambda t: t != "")
    return F.when(node["tag"] == "select", F.slice(texts, 1, rules.MAX_OPTIONS))


def select_values(node: Column, nodes: Column) -> Column:
    """Values of the enabled options of a select, for those that have one of their own."""
    options = F.filter(nodes, lambda n: _within(n, node) & (n["tag"] == "option") & ~_has_attr(n, "disabled") & (attr(n, "value") != ""))
    return F.when(node["tag"] == "select", F.slice(F.transform(options, lambda o: attr(o, "value")), 1, rules.MAX_OPTIONS))


def card_context(node: Column, nodes: Column, label: Column) -> Column:
    """Title (and first price) of the nearest ancestor that reads like a card; empty when there is none."""
    def titles(outer: Column) -> Column:
        inner = F.filter(nodes, lambda n: _within(n, outer) & (n["pos"] != node["pos"]) & (n["text"] != "")
                         & ~_within(node, n))
        heads = F.filter(inner, lambda n: n["tag"].rlike("^h[1-6]$") | (attr(n, "role") == "heading"))
        links = F.filter(inner, lambda n: (n["tag"] == "a") & _has_attr(n, "href") & (F.length(one_space(n["text"])) >= rules.CARD_LINK_MIN))
        return F.transform(F.when(F.size(heads) > 0, heads).otherwise(links), lambda n: one_space(n["text"]))

    levels = F.transform(F.slice(F.reverse(node["path"]), 1, rules.CARD_DEPTH), lambda p: F.get(nodes, p))

    def step(acc: Column, outer: Column) -> Column:
        found = titles(outer)
        price = F.nullif(one_space(F.regexp_extract(outer["text"], rules.CARD_PRICE, 0)), F.lit(""))
        return (
            F.when(acc.isNotNull(), acc)
            .when(outer["tag"].isin("body", "html") | (F.length(outer["text"]) > rules.CARD_TEXT_MAX) | (F.size(found) > 1), "")
            .when(F.size(found) == 1, F.concat_ws(" | ", F.get(found, 0), price)).otherwise(F.lit(None))
        )

    context = F.coalesce(F.aggregate(levels, F.lit(None).cast("string"), step), F.lit(""))
    short = F.when(F.length(context) > rules.CARD_CONTEXT_MAX, F.concat(
        F.left(context, F.lit(rules.CARD_CONTEXT_MAX - 1)), F.lit("…"))).otherwise(context)
    return F.when(F.length(trimmed(label)) > rules.CARD_LABEL_MAX, "").otherwise(short)


def page_elements(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per visible interactive element in document order, with its label, role and options."""
    shown = F.filter("nodes", lambda n: is_interactive(n) & ~n["hidden"])
    label = F.left(accessible_label(F.col("node"), F.col("nodes")), F.lit(rules.MAX_LABEL))
    rows = parsed.select(*keys, "nodes", F.posexplode(shown).alias("pos", "node")).withColumn("label", label)
    return rows.withColumn("tag", F.col("node.tag")).withColumn("role", role_of(F.col("node"))).withColumn(
        "options", select_options(F.col("node"), F.col("nodes")))


def form_fields(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Fields that hold user values, with label, nearby text, naming attributes and context."""
    node, nodes = F.col("node"), F.col("nodes")
    tag = F.col("tag")
    kind = F.when(F.map_contains_key(node["attrs"], F.lit("type")), input_type(node)).otherwise("text")
    holds = (tag == "textarea") | ((tag == "input") & ~kind.isin(rules.BUTTON_INPUT_TYPES))
    named = F.filter(nodes, lambda n: (n["tag"] == "label") & (attr(n, "for") != "") & (attr(n, "for") == attr(node, "id")))
    wrapping = F.filter(nodes, lambda n: (n["tag"] == "label") & _within(node, n))
    texts = F.concat(F.transform(F.concat(named, wrapping), lambda n: n["text"]),
                     F.array(F.when(attr(node, "aria-labelledby") != "", _by_ids(nodes, attr(node, "aria-labelledby"))).otherwise("")))
    label = trimmed(F.array_join(F.filter(texts, lambda t: t != ""), " "))
    parent = F.get(nodes, F.get(node["path"], F.size(node["path"]) - 1))
    before = F.filter(nodes, lambda n: (n["pos"] < node["pos"]) & (F.size(n["path"]) == F.size(node["path"])) & _within(n, parent))
    sibling = F.coalesce(F.get(before, F.size(before) - 1)["text"], F.lit(""))
    near_parent = F.when(F.length(parent["own"]) <= rules.NEARBY_MAX, parent["own"]).otherwise("")
    nearby = F.when((sibling != "") & (F.length(sibling) <= rules.NEARBY_MAX), sibling).otherwise(near_parent)
    parts = F.filter(F.array(F.col("field_label"), F.col("name"), F.col("placeholder"), F.col("aria_label")), lambda p: trimmed(p) != "")
    context = F.array_join(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "[_-]+", " "))), " ")
    return (
        elements.filter(holds)
        .select(*keys, "pos", F.col("tag"), input_type(node).alias("input_type"), F.lower(attr(node, "autocomplete")).alias("autocomplete"),
                attr(node, "name").alias("name"), attr(node, "id").alias("id"), attr(node, "class").alias("class"),
                attr(node, "placeholder").alias("placeholder"), attr(node, "aria-label").alias("aria_label"),
                label.alias("field_label"), F.coalesce(nearby, F.lit("")).alias("nearby"),
                trimmed(F.when(tag == "textarea", node["text"]).otherwise(attr(node, "value"))).alias("value"))
        .withColumn("context", context)
    )


def page_text(parsed: DataFrame, main_tags: list[str] = rules.MAIN_TAGS, cap: int = rules.MAX_PAGE_TEXT) -> Column:
    """Page text with main landmarks first, then the rest of the body, then site chrome; the cap trims chrome first."""
    nodes = F.col("nodes")

    def is_main(n: Column) -> Column:
        return n["tag"].isin(main_tags) | attr(n, "role").isin(rules.MAIN_ROLES)

    def is_chrome(n: Column) -> Column:
        return n["tag"].isin(rules.CHROME_TAGS) | attr(n, "role").isin(rules.CHROME_ROLES)

    mains_all = F.filter(nodes, is_main)
    mains = F.filter(F.transform(mains_all, lambda n: n["text"]), lambda t: F.length(t) >= rules.MIN_MAIN_TEXT)
    chromes = F.filter(F.transform(F.filter(nodes, lambda n: is_chrome(n) & ~F.exists(
        mains_all, lambda m: (n["pos"] == m["pos"]) | _within(n, m))), lambda n: n["text"]), lambda t: t != "")
    body = F.coalesce(F.get(F.filter(nodes, lambda n: n["tag"] == "body"), 0)["text"], F.lit(""))

    def cut(acc: Column, part: Column) -> Column:
        at = F.instr(acc, part)
        return F.when(at == 0, acc).otherwise(F.concat(F.substring(acc, F.lit(1), at - 1), F.substring(acc, at + F.length(part), F.length(acc))))

    rest = trimmed(F.aggregate(F.concat(mains, chromes), body, cut))
    ordered = F.array_join(F.filter(F.concat(mains, F.array(rest), chromes), lambda t: t != ""), "\n")
    return F.left(ordered, F.lit(cap))
