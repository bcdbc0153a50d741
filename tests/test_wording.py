"""Rules in our own wordings, with values worked out by hand, from a sentence to the resolved row."""

import pytest

from fitgate.operators import headers, html_fields, rules_text, wording

KB, MB = 1_000, 1_000_000
JPG, PNG, GIF, WEBP, TIFF, PDF = "image/jpeg", "image/png", "image/gif", "image/webp", "image/tiff", "application/pdf"

CASES = [
    # the most bytes
    ("Attachments may be no bigger than 7 MB", {"max_bytes": 7 * MB}), ("keep scans within 900 KB", {"max_bytes": 900 * KB}), ("≤ 3 MB", {"max_bytes": 3 * MB}), ("<= 3 MB", {"max_bytes": 3 * MB}),
    ("The scan must never exceed 3 MB", {"max_bytes": 3 * MB}), ("It cannot exceed 3 MB", {"max_bytes": 3 * MB}), ("not over 6 MB", {"max_bytes": 6 * MB}), ("6 MB or smaller", {"max_bytes": 6 * MB}),
    ("Anything over 9 MB will be refused", {"max_bytes": 9 * MB}), ("Pictures bigger than 4 MB won't be accepted", {"max_bytes": 4 * MB}), ("Files above the limit of 1,500 KB are rejected", {"max_bytes": 1500 * KB}),
    ("upto 3 gigabytes", {"max_bytes": 3000 * MB}), ("Limited to 5 MiB", {"max_bytes": 5 * 2**20}), ("at most 1,5 MB", {"max_bytes": 1_500_000}), ("0.5 MB max", {"max_bytes": 500 * KB}),
    # the least bytes, and ranges
    ("no smaller than 30 KB", {"min_bytes": 30 * KB}), ("30 KB or more", {"min_bytes": 30 * KB}), (">= 30 KB", {"min_bytes": 30 * KB}), ("Scans over 30 KB are made smaller", {}),
    ("between 30 and 90 KB", {"min_bytes": 30 * KB, "max_bytes": 90 * KB}), ("30 KB – 1 MB", {"min_bytes": 30 * KB, "max_bytes": MB}), ("from 30 KB to 1 MB", {"min_bytes": 30 * KB, "max_bytes": MB}),
    ("30 and 90 KB", {}), ("at least 30 KB, at most 90 KB", {"min_bytes": 30 * KB, "max_bytes": 90 * KB}),
    # all files together
    ("combined size at most 30 MB", {}), ("max 30 MB in total", {}), ("at most 30 MB per message", {}), ("All photos: max 30 MB", {}),
    # pixels
    ("a banner of 900 x 300", {"exact_width": 900, "exact_height": 300}), ("900px by 300px or larger", {"min_width": 900, "min_height": 300}), ("no bigger than 900 × 300", {"max_width": 900, "max_height": 300}),
    ("(up to 3 MB, 900*300 minimum)", {"max_bytes": 3 * MB, "min_width": 900, "min_height": 300}), ("between 300 and 900 px tall", {"min_height": 300, "max_height": 900}), ("300-900 pixels wide", {"min_width": 300, "max_width": 900}),
    ("300 and 900 px wide", {}), ("max. height 900 px", {"max_height": 900}), ("width of at least 300 px", {"min_width": 300}), ("width 300, height 400", {"exact_width": 300, "exact_height": 400}), ("width 300 px", {}),
    ("not over 48px high", {"max_height": 48}), ("exactly 300 px wide", {"exact_width": 300}), ("300 px wide", {}), ("at most 700 px on each side", {"max_width": 700, "max_height": 700}),
    ("at least 700 pixels along the shorter edge", {"min_width": 700, "min_height": 700}), ("800 px on the longest side", {}), ("max 1500 px", {"max_width": 1500, "max_height": 1500}), ("no larger than 900 px", {"max_width": 900, "max_height": 900}),
    # print
    ("40 x 50 mm", {"print_width": 40, "print_height": 50, "aspect_ratio": 0.8}), ("40 x 50 millimetres", {"print_width": 40, "print_height": 50, "aspect_ratio": 0.8}), ('3" × 4"', {"print_width": 76.2, "print_height": 101.6, "aspect_ratio": 0.75}),
    ("4 cm by 5 cm at 254 d.p.i.", {"print_width": 40, "print_height": 50, "dpi": 254, "exact_width": 400, "exact_height": 500, "aspect_ratio": 0.8}), ("save it at 250 pixels per inch", {"dpi": 250}),
    ("4 cm x 4.7 cm, 90 dpi", {"print_width": 40, "print_height": 47, "dpi": 90, "exact_width": 142, "exact_height": 167, "aspect_ratio": 142 / 167}),
    ("250 to 300 ppi", {"dpi": 250}), ("2000 dpi", {}), ("print it 4 x 5 in black", {}), ("900 x 900 mm", {}),
    # shapes
    ("use 5:4", {"aspect_ratio": 1.25}), ("1:2 banner", {"aspect_ratio": 0.5}), ("16:10", {}), ("ratio of 16:10", {"aspect_ratio": 1.6}), ("open until 10:30", {}), ("a square thumbnail", {"aspect_ratio": 1}),
    ("Your logo should be square", {"aspect_ratio": 1}), ("A square photo is fine but it need not be square", {}), ("It does not have to be square", {}), ("squares", {}),
    # formats
    ("TIFF, GIF", {"accepted_mimes": [TIFF, GIF]}), ("send it as jpeg", {"accepted_mimes": [JPG]}), ("image/webp or image/png only", {"accepted_mimes": [WEBP, PNG]}), ("PNGs only, except GIF", {"accepted_mimes": [PNG]}),
    ("TIFF isn't allowed", {}), ("GIF is not accepted", {}), ("TIFF or PNG. GIF files are not supported", {"accepted_mimes": [TIFF, PNG]}), ("see my-photo.png", {}), ("holiday/webp-scans/y", {}), ("A PNG would be nice", {}),
    ("convert your scan to PDF", {"accepted_mimes": [PDF]}), ("(PDF, 90 KB)", {"accepted_mimes": [PDF]}), ("JPEG XL or jpg", {"accepted_mimes": ["image/jxl", JPG]}), (".tif", {"accepted_mimes": [TIFF]}),
    # no rules
    ("We suggest 900 x 300 pixels", {}), ("Preferably under 3 MB", {}), ("We'll resize anything over 3000 px wide", {}), ("Photos are automatically cropped to 900 x 300", {}), ("For example 900 x 300", {}),
    ("Step 3 of 4", {}), ("0049-30-901820", {}), ("4x faster", {}), ("", {}), ("at most 5 at least", {}), ("1.2.3 MB", {}), ("Max. 2 MB. jpg only", {"max_bytes": 2 * MB, "accepted_mimes": [JPG]}),
    ("at most 2 MB; at most 3 MB", {}), ("x" * 2_100 + " max 2 MB", {}),
]


def test_wordings(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(-1, None)], "k long, text string")
    got = {r.k: {n: v for n, v in r.asDict().items() if n not in ("k", "confidence") and v} for r in rules_text.resolve(rules_text.evidence(texts, "k"), "k").collect()}
    near = lambda d: {n: round(v, 9) if isinstance(v, float) else v for n, v in d.items()}
    wrong = {t: got.get(i, {}) for i, (t, want) in enumerate(CASES) if near(got.get(i, {})) != near(want)}
    assert wrong == {} and -1 not in got


def test_only_clauses_that_can_state_something_are_read(spark):
    texts = spark.createDataFrame([(1, "Nothing here. A square icon. Or image/png! 7 of them | plain")], "k long, text string")
    clauses = texts.select(rules_text.clauses(texts.text).alias("c")).first().c
    assert clauses == ["Nothing here", "A square icon", "Or image/png! 7 of them", "plain"]
    assert {r.rule for r in rules_text.evidence(texts, "k").collect()} == {"aspect_ratio", "accepted_mimes"}


NEAR = "<form><p>up to 3 MB</p><h2>no</h2><div><input type=file></div><div>png</div></form>"
DEEP = "x<div>y<div>z<div>w<div>v<input type=file></div></div></div></div>"
#: Pages, and the texts of their first field.
PAGES = [
    (NEAR, [("sibling", 0.86, "png")]),
    (NEAR.replace("</form>", "<input type=file></form>"), []),
    ("<main role=x><div>a <b>b</b><input type=file><video>no</video></div></main>", [("parent", 0.93, "a\nb")]),
    ("<section role=dialog>no<span><input type=file></span></section>", []),
    ("<input type=file data-max-filesize=2048 data-max-size=20>", [("data-max-filesize", 0.88, "2048")]),
    ("<label>CV <input type=file></label>", [("label", 0.95, "CV")]),
    (f"<p></p><article>{DEEP}</article>", [("parent", 0.93, "v"), ("ancestor", 0.90, "w\nv"), ("ancestor", 0.86, "z\nw\nv"), ("ancestor", 0.72, "y\nz\nw\nv")]),
    (f"<div>{'long ' * 400}<input type=file></div>", []),
    ("<p id=a>one</p><p id=b>two <i aria-hidden=true>no</i></p><input type=file aria-describedby='b  a none' aria-labelledby=a aria-label=L title=T>", [("aria-describedby", 0.97, "two"), ("aria-describedby", 0.97, "one"), ("aria-label", 0.95, "L"), ("title", 0.90, "T")]),
    ("<div><label for=x>for</label><input type=FILE id=x data-maxsize='2 MB'></div>", [("label", 0.95, "for"), ("data-maxsize", 0.90, "max 2 MB"), ("parent", 0.93, "for")]),
    ("<form><ul><li>before</ul><span><div><input type=file></div></span><h3>no</h3><p>far</p></form>", [("sibling", 0.86, "before")]),
    ("<div>both <p>a<input type=file></p><p>b<input type=file></p></div>", [("parent", 0.93, "a")]),
    ("<label>two <input type=file><input type=file></label>", []),
    ("<div hidden><b>x</b><script>no</script><p>y<input type=file></p></div></div></p>", [("parent", 0.93, "y"), ("ancestor", 0.90, "x\ny")]),
    ("<p>unclosed <div>t<input type=file>", [("parent", 0.93, "t"), ("ancestor", 0.90, "unclosed\nt")]),
    ("<p>no field</p>", []), (None, []), ("", []), ("<input type=text>", []), ("<input type=file data-max-size='99999999999999999999999999999999999999999999'>", [("data-max-size", 0.88, "9" * 44)]),
]


def test_texts_near_a_field(spark):
    pages = spark.createDataFrame([(k, html, "x") for k, (html, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {}
    for r in html_fields.html_fields(pages).orderBy("page_id", "field_no", "ord").collect():
        if r.field_no == 0 and r.text is not None:
            got.setdefault(r.page_id, []).append((r.source, r.confidence, r.text))
    wrong = {html: got.get(k, []) for k, (html, want) in enumerate(PAGES) if got.get(k, []) != want}
    assert wrong == {}


def test_nodes():
    rows = [(k, last, parent, tag) for k, last, parent, _, tag, *_ in html_fields.nodes_of("<p>a<br><b>c</p>d<i></b></i>")]
    assert rows == [(0, 4, -1, "p"), (1, 1, 0, "#text"), (2, 2, 0, "br"), (3, 4, 0, "b"), (4, 4, 3, "#text"), (5, 5, -1, "#text"), (6, 6, -1, "i")]
    assert [r[7:] for r in html_fields.nodes_of("<div>ab<svg>no<p>no</p></svg><p>c</p></div>")][:2] == [(0, 5), (0, 3)]


def test_bare_numbers_of_an_attribute_are_bytes(spark):
    pages = spark.createDataFrame([(1, "<input type=file data-max-size=1001>"), (2, "<input type=file data-max-size=4097>"), (3, "<p>no field</p>"), (4, None)], "page_id long, html string")
    got = {r.page_id: r.max_bytes for r in html_fields.html_rules(pages).collect()}
    assert got == {1: None, 2: 4097}


@pytest.mark.parametrize(
    ("svg", "size"),
    [
        ("<svg width='100' viewBox='0 0 400 200'>", (100, 50)), ("<svg height='1in' viewBox='0,0,400,200'/>", (192, 96)), ("<svg viewBox='0 0 40.6 20'>", (41, 20)), ("<svg width='5em' height='5ex'>", (300, 150)),
        ("<svg width='100%' height='10'>", (300, 10)), ("<?xml version='1.0'?><!-- a --><svg width=\"2cm\" height='12pt'>", (76, 16)), ("<svg width='1.2.3'>", (300, 150)), ("<svg>", (300, 150)),
    ],
)
def test_size_of_a_drawing(svg, size):
    out = headers.read_header("svg", svg.encode(), True)
    assert (out["width"], out["height"]) == size


def test_growing_files():
    jpeg = b"\xff\xd8\xff\xe0\x00\x06JFIF\xff\xdb\x00\x02\xff\xd9"
    for more in (1, 3, 4, 5, 65_537, 65_538, 65_541, 200_000):
        out = headers.pad_to(jpeg, "jpeg", len(jpeg) + more)
        assert len(jpeg) + more <= len(out) <= len(jpeg) + more + 3
        assert out.startswith(jpeg[:10]) and out.endswith(jpeg[10:]) and out[10:12] == b"\xff\xfe"
    assert headers.pad_to(jpeg, "jpeg", 3) == jpeg and headers.pad_to(jpeg, "gif", 10**6) is None


def test_icons_are_told_by_their_directory(spark):
    rows = [b"\0\0\1\0\1\0" + bytes(16), b"\0\0\2\0\1\0" + bytes(16), b"\0\0\1\0\0\0" + bytes(16), b"\0\0\1\0\1\0" + bytes(3) + b"\1" + bytes(12), b"\0\0\1\0\1\0"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, b binary")
    out = {r.i: r.f for r in df.select("i", headers.detect(df.b).alias("f")).collect()}
    assert out == {0: "ico", 1: "ico", 2: "unknown", 3: "unknown", 4: "unknown"}
    numbers = spark.createDataFrame([("1,500",), ("1,5",), ("1.2.3",), ("12,345,678",)], "t string")
    assert [r.v for r in numbers.select(wording.number(numbers.t).alias("v")).collect()] == [1500, 1.5, None, 12345678]
