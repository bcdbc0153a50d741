"""Upload fields of HTML pages, and the texts near them that may state rules.

One kernel turns a page into nodes, numbered in document order, each with the number of the last node inside
it. So "inside" is a comparison of numbers, and everything else is joins and windows over nodes: which elements
are around a field and how far, where a climb ends, which elements stand beside one another, how many
fields an element holds, and the text of an element.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitgate.operators import rules_text
from fitgate.session import shared_folder

# How much a text counts by where it stands, and how far to look.
DESCRIBED, LABELLED, TITLE, LABEL, SIBLING, BARE_NUMBER, WORDED = 0.97, 0.95, 0.90, 0.95, 0.86, 0.88, 0.90
LEVELS = (0.93, 0.90, 0.86, 0.72)
STEPS, FIELD_CHARS, SIBLING_CHARS, LEAST_BYTES = 8, 1_500, 300, 1_024
STOPS, STOP_ROLES = {"body", "html", "form", "main", "dialog"}, {"main", "dialog"}
SKIPPED = {"script", "style", "template", "noscript", "svg", "canvas", "video", "audio", "iframe", "select"}
SIZE_ATTRIBUTES = ("data-max-size", "data-max-file-size", "data-maxsize", "data-max-filesize")
SIBLING_TAGS = {"p", "small", "span", "div", "label", "ul", "li"}
FIELD_TEXTS = "field_no int, accept string, multiple boolean, ord int, source string, confidence double, text string"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
TEXT = "#text"
NODES = "node int, last int, parent int, depth int, tag string, attrs map<string,string>, text string, hidden int, chars int"


class _Numbered(HTMLParser):
    """Nodes of a page in document order as [last, parent, depth, tag, attrs, text]; node -1 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []  # elements that are open

    def _add(self, tag: str, attrs: dict | None, text: str | None) -> int:
        self.rows.append([len(self.rows), self.open[-1] if self.open else -1, len(self.open), tag, attrs, text])
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        node = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in attrs}, None)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][3] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if piece := data.strip():
            self._add(TEXT, None, piece)


def nodes_of(html: str | None) -> Iterator[tuple]:
    """Rows of NODES: hidden counts the elements around a node, itself included, whose text is not seen; chars is the size of the text
    that is seen inside an element, with one more for each piece."""
    parser = _Numbered()
    parser.feed(html or "")
    parser.close()
    rows = parser.rows
    hidden = []
    for _, parent, _, tag, attrs, _ in rows:
        hidden.append((hidden[parent] if parent >= 0 else 0) + (tag in SKIPPED or (attrs or {}).get("aria-hidden") == "true"))
    chars = [len(r[5]) + 1 if r[5] else 0 for r in rows]
    for k in range(len(rows) - 1, -1, -1):
        parent = rows[k][1]
        if parent >= 0:
            rows[parent][0] = max(rows[parent][0], rows[k][0])
            chars[parent] += chars[k] if hidden[k] == hidden[parent] else 0
    for k, (last, parent, depth, tag, attrs, text) in enumerate(rows):
        yield k, last, parent, depth, tag, attrs, text, hidden[k], chars[k]


def html_nodes(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """The nodes of all pages, NODES behind the key. A NULL page has none."""
    kind = dict(pages.dtypes)[key]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in NODES.split(", "))]
        for batch in batches:
            for k, h in batch.itertuples(index=False):  # a page at a time: pages have many nodes
                yield pd.DataFrame([(k, *r) for r in nodes_of(h)], columns=names)

    return pages.select(key, html_col).mapInPandas(read, f"{key} {kind}, {NODES}")


def _attr(name: str, attrs: str = "attrs") -> Column:
    return F.coalesce(F.try_element_at(F.col(attrs), F.lit(name)), F.lit(""))


def _fields(nodes: DataFrame, key: str) -> DataFrame:
    """(key, field_no, f, f_depth, f_attrs): the upload fields of each page, in order."""
    found = nodes.where((F.col("tag") == "input") & (F.lower(_attr("type")) == "file"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("node")) - 1
    return found.select(key, number.alias("field_no"), F.col("node").alias("f"), F.col("depth").alias("f_depth"), F.col("attrs").alias("f_attrs"))


def _named(nodes: DataFrame, fields: DataFrame, key: str, attribute: str, place: int, confidence: float) -> DataFrame:
    """Elements that an attribute of a field names by their id; of several with one id the first."""
    ids = nodes.where(_attr("id") != "").groupBy(key, _attr("id").alias("id")).agg(F.min("node").alias("node"))
    asked = fields.select(key, "f", F.posexplode(F.split(F.trim(_attr(attribute, "f_attrs")), r"\s+")).alias("pos", "id"))
    return asked.join(ids, [key, "id"]).select(key, "f", F.lit(place).alias("place"), "pos", F.lit(attribute).alias("source"), F.lit(confidence).alias("confidence"), "node")


def _around(elements: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """(field and element columns, step): the elements around each field, the first eight at most, up to the first one that stops a climb."""
    inside = (F.col("f") > F.col("node")) & (F.col("f") <= F.col("last"))
    step = F.col("f_depth") - F.col("depth")
    up = fields.drop("f_attrs").join(elements, key).where(inside).withColumn("step", step).where(F.col("step") <= STEPS)
    stops = F.col("tag").isin(*STOPS) | _attr("role").isin(*STOP_ROLES)
    climb = Window.partitionBy(key, "f").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    marked = up.withColumn("stop", stops)
    return marked.withColumn("over", F.coalesce(F.max("stop").over(climb), F.lit(False))).where("not over").drop("over")


def html_fields(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per upload field, with NULL text, and one per field and text near it, its own statements first; pages without fields give none.

    An element counts once for a field. Rows: the key and FIELD_TEXTS.
    """
    # a cheap native test first: most pages hold no upload field
    some = pages.where(F.lower(html_col).rlike(r"<input\b[^>]*\btype\s*=\s*[\"']?file"))
    nodes = _written(html_nodes(some, key, html_col))
    fields = _written(_fields(nodes, key))
    elements = nodes.where(F.col("tag") != TEXT)
    inner = nodes.groupBy(key, F.col("parent").alias("node")).agg(F.count_if(F.col("tag") != TEXT).alias("children"), F.count_if(F.col("tag") == TEXT).alias("own"))
    held = fields.select(key, F.col("f").alias("other"))

    # elements that a field names, and labels: around it or for it
    label = elements.where("tag = 'label'").select(key, "node", "last", _attr("for").alias("for"))
    mine = (F.col("f") > F.col("node")) & (F.col("f") <= F.col("last")) | (F.col("for") != "") & (F.col("for") == _attr("id", "f_attrs"))
    labels = fields.join(label, key).where(mine).select(key, "f", F.lit(4).alias("place"), F.col("node").alias("pos"), F.lit("label").alias("source"), F.lit(LABEL).alias("confidence"), "node")
    own = _named(nodes, fields, key, "aria-describedby", 0, DESCRIBED).unionByName(_named(nodes, fields, key, "aria-labelledby", 1, LABELLED)).unionByName(labels)
    first = Window.partitionBy(key, "f", "node").orderBy("place", "pos")
    own = _written(own.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"))

    # the climb: levels are the elements around a field that are more than a wrapper of one other
    around = _around(elements, fields, key).join(inner, [key, "node"], "left")
    alone = around.join(held, key).where("other >= node and other <= last and other <> f").groupBy(key, "f", "node").agg(F.lit(True).alias("shared"))
    known = own.select(key, "f", "node", F.lit(True).alias("known"))
    around = around.join(alone, [key, "f", "node"], "left").join(known, [key, "f", "node"], "left")
    wraps = (F.coalesce("own", F.lit(0)) == 0) & (F.coalesce("children", F.lit(0)) <= 1)
    bad = ~F.col("stop") & ~wraps & F.col("known").isNull() & (F.col("shared").isNotNull() | (F.col("chars") > FIELD_CHARS))
    upward = Window.partitionBy(key, "f").orderBy("step")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    around = around.withColumn("level", F.coalesce(F.count_if(~F.col("stop") & ~wraps).over(before), F.lit(0)))
    around = around.withColumn("ended", F.coalesce(F.max(bad).over(before), F.lit(False)) | (F.col("level") >= len(LEVELS)))
    around = around.withColumn("below", F.coalesce(F.lag("node").over(upward), F.col("f"))).where(~F.col("ended"))
    around = _written(around.withColumns({"wraps": wraps, "bad": bad}))
    confidence = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("level").cast("int"))
    levels = around.where(~F.col("stop") & ~F.col("wraps") & ~F.col("bad") & F.col("known").isNull())
    levels = levels.select(key, "f", F.lit(6).alias("place"), F.col("step").alias("pos"), F.when(F.col("level") == 0, "parent").otherwise("ancestor").alias("source"), confidence.alias("confidence"), "node")

    # the climb came to a form of this field alone: what stands beside its part of the form
    forms = around.where(F.col("stop") & (F.col("tag") == "form") & F.col("shared").isNull()).select(key, "f", F.col("below").alias("node"))
    row = Window.partitionBy(key, "parent").orderBy("node")
    beside = elements.select(key, "node", F.array(F.lag("node").over(row), F.lead("node").over(row)).alias("beside"))
    beside = forms.join(beside, [key, "node"]).select(key, "f", F.posexplode("beside").alias("pos", "node")).where("node is not null")
    siblings = beside.select(key, "f", F.lit(7).alias("place"), "pos", F.lit("sibling").alias("source"), F.lit(SIBLING).alias("confidence"), "node")

    # texts: of elements that are about this field alone, and of siblings
    asked = _written(own.unionByName(levels).unionByName(siblings)).join(elements.select(key, "node", "last", "tag", "hidden", "chars"), [key, "node"])
    shared = asked.where("place < 7").join(held, key).where("other >= node and other <= last and other <> f").select(key, "f", "node").distinct()
    fits = F.when(F.col("place") < 7, F.col("chars") <= FIELD_CHARS).otherwise((F.col("chars") <= SIBLING_CHARS + 1) & F.col("tag").isin(*SIBLING_TAGS))
    asked = asked.where(fits & (F.col("chars") > 0)).join(shared, [key, "f", "node"], "left_anti")
    pieces = nodes.where(F.col("tag") == TEXT).select(key, F.col("node").alias("t"), F.col("hidden").alias("t_hidden"), "text")
    wanted = asked.select(key, "node", "last", "hidden").distinct()
    texts = wanted.join(pieces, key).where("t > node and t <= last and t_hidden = hidden").groupBy(key, "node").agg(F.array_sort(F.collect_list(F.struct("t", "text"))).alias("p"))
    texts = texts.select(key, "node", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    worded = asked.join(texts, [key, "node"]).where((F.col("place") < 7) | (F.length("text") <= SIBLING_CHARS)).select(key, "f", "place", "pos", "source", "confidence", "text")

    said = _said(fields, key)
    ranked = reduce(DataFrame.unionByName, [worded, *said])
    ranked = ranked.withColumn("ord", F.row_number().over(Window.partitionBy(key, "f").orderBy("place", "pos")) - 1)
    common = fields.select(key, "f", "field_no", _attr("accept", "f_attrs").alias("accept"), F.map_contains_key("f_attrs", "multiple").alias("multiple"))
    out = common.join(ranked.drop("place", "pos"), [key, "f"]).unionByName(common, allowMissingColumns=True)
    return out.select(key, *[c.split()[0] for c in FIELD_TEXTS.split(", ")])


def _said(fields: DataFrame, key: str) -> list[DataFrame]:
    """What attributes of a field say themselves."""
    rows = lambda place, name, confidence, text: fields.select(key, "f", F.lit(place).alias("place"), F.lit(0).alias("pos"), F.lit(name).alias("source"), F.lit(confidence).alias("confidence"), text.alias("text")).where(F.col("text") != "")
    out = [rows(2, "aria-label", LABELLED, _attr("aria-label", "f_attrs")), rows(3, "title", TITLE, _attr("title", "f_attrs"))]
    for k, name in enumerate(SIZE_ATTRIBUTES):
        value = F.trim(_attr(name, "f_attrs"))
        bare = value.rlike("^[0-9]+$")
        enough = F.coalesce(value.try_cast("decimal(38,0)") >= LEAST_BYTES, F.lit(True))
        out.append(rows(5, name, BARE_NUMBER, F.when(bare & enough, value)).withColumn("pos", F.lit(k)))
        out.append(rows(5, name, WORDED, F.when(~bare & (value != ""), F.concat(F.lit("max "), value))).withColumn("pos", F.lit(k)))
    return out


def _written(rows: DataFrame) -> DataFrame:
    """Rows as a table, where several joins need them: made once, and plans stay short."""
    path = shared_folder(rows.sparkSession, "nodes")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def html_rules(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per upload field: rules from the texts near it; types from prose only if ``accept`` names none."""
    texts = html_fields(pages, key, html_col).withColumn("field", F.concat_ws(":", key, "field_no"))
    carry = (key, "field_no", "accept")
    joined = rules_text.resolve(rules_text.evidence(texts, "field", carry=carry), "field", carry).withColumn("a", rules_text.parse_accept(F.col("accept")))
    specific = (F.size("a.exts") > 0) | F.exists("a.mimes", lambda m: ~m.endswith("/*"))
    none = F.array().cast("array<string>")
    worded = F.when(F.size("accepted_mimes") > 0, F.col("accepted_mimes"))
    return joined.select(
        key, "field_no", F.when(specific, F.col("a.mimes")).otherwise(F.coalesce(worded, "a.mimes", none)).alias("accepted_mimes"), F.col("a.exts").alias("accepted_exts"),
        *rules_text.NUMERIC_RULES, F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
