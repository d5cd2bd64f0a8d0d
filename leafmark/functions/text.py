"""Scalar expressions over text columns. All are built from SQL functions, so they stay in generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TokenProfile:
    """How text becomes terms: a pattern on lower-cased text, a least length, and words left out.

    The default takes runs of letters and digits. Without a vocabulary a run of CJK characters is one
    term; with one, see functions.segment for the longest match.
    """

    pattern: str = r"[\p{L}\p{N}]+"
    least: int = 1
    stopwords: tuple[str, ...] = ()


@dataclass(frozen=True)
class SentenceProfile:
    """Characters that end a sentence."""

    ends: str = "。！？；"


LATIN = SentenceProfile(".!?;")

# Patterns of headings, marks and captions.
CHAPTER = r"^第\s*[0-9一二三四五六七八九十百]+\s*[章节篇]"
NUM3, NUM2 = r"^\d+\.\d+\.\d+(?![\d.\s])", r"^\d+\.\d+(?![\d.\s])"
LIST_NUM = r"^\d{1,2}\s*[.、]\s*[一-鿿]"
HEADING_STOPS = "[。，；：！？]"
PAGE_NO = r"^[·•.\-—\s]*(\d{1,4})[·•.\-—\s]*$"
PAGE_MARK = r"^<!--\s*page\s+(\d+)\s*-->$"
MD_HEADING = r"^(#{1,6})\s+(.*)$"
MD_IMAGE = r"^!\[(.*?)\]\((.*?)\)\s*$"
MD_TABLE_ROW = r"^\|.*\|$"
CAPTION = r"^图\s*\d+\s*[-–—]\s*\d+"
LEAD_CHAPTER = r"^(\d{1,2})\s*[.．]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def tokens(c: Column, profile: TokenProfile = TokenProfile()) -> Column:
    """Terms of a text, in order, with repeats; null gives an empty array."""
    out = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(profile.pattern), F.lit(0))
    if profile.least > 1:
        out = F.filter(out, lambda w: F.length(w) >= profile.least)
    if profile.stopwords:
        out = F.filter(out, lambda w: ~w.isin(*profile.stopwords))
    return out


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\r\n|\r|\n")


def sentences(c: Column, profile: SentenceProfile = SentenceProfile()) -> Column:
    """array<struct<s, first>>: trimmed sentences; first marks the first one of a line."""
    e = profile.ends
    per_line = F.transform(lines(c), lambda p: F.filter(
        F.transform(F.regexp_extract_all(strip(p), F.lit(f"[^{e}]*[{e}]|[^{e}]+"), F.lit(0)), strip), lambda s: s != ""))
    return F.flatten(F.transform(per_line, lambda ss: F.transform(ss, lambda s, k: F.struct(s.alias("s"), (k == 0).alias("first")))))


def heading_level(c: Column) -> Column:
    """1 chapter, 2 section, 3 subsection, 4 numbered item, null for text."""
    s = strip(c)
    return (F.when((s == "") | (F.length(s) > 60) | s.rlike(HEADING_STOPS), F.lit(None).cast("int"))
            .when(s.rlike(CHAPTER), 1).when(s.rlike(NUM3), 3).when(s.rlike(NUM2), 2)
            .when((F.length(s) <= 30) & s.rlike(LIST_NUM), 4))


def is_pdf_heading(c: Column) -> Column:
    return (F.length(c) <= 60) & (c.rlike(r"^第[0-9一二三四五六七八九十百]+[章节部分篇]")
                                  | (~c.rlike(r"^\d{4}\s*年") & c.rlike(r"^\d+(\.\d+){0,3}\s+[一-鿿A-Za-z]")))


def slide_heading_level(c: Column) -> Column:
    """Level of a real slide heading by the depth of its number (at most 4), null for other text."""
    s = strip(c)
    num = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\s*(.*)$", 1)
    rest = strip(F.regexp_extract(s, r"^(\d+(?:\.\d+)*)\s*(.*)$", 2))
    dots = F.length(num) - F.length(F.replace(num, F.lit("."), F.lit("")))
    return F.when((s != "") & (F.length(s) <= 60), F.when(s.rlike(r"^第\s*[0-9一二三四五六七八九十]+\s*章"), 1).when((dots > 0) & (rest != ""), F.least(dots + 1, F.lit(4))))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def infer_chapter(c: Column) -> Column:
    n = F.regexp_extract(F.coalesce(c, F.lit("")), LEAD_CHAPTER, 1)
    return F.when(n != "", F.concat(F.lit("第"), n, F.lit("章"))).otherwise("")


def page_number(c: Column) -> Column:
    """Printed page number of a footer, within 1 to 1999, else null."""
    n = F.regexp_extract(c, PAGE_NO, 1)
    v = F.when(n != "", n.cast("int"))
    return F.when((v > 0) & (v < 2000), v)


def is_caption(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(CAPTION)


def path_parts(c: Column, sep: str = "[>＞]") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), strip), lambda p: p != "")


def split_path(c: Column) -> tuple[Column, Column]:
    """(book, rest of the path joined by ' > ')."""
    p = path_parts(c)
    return F.coalesce(F.get(p, F.lit(0)), F.lit("")), F.when(F.size(p) > 1, F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(1))), " > ")).otherwise("")


def section_title(c: Column) -> Column:
    p = path_parts(c, " > ")
    return F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(""))


def escape_html(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Styles of marked words and page badges; callers may give their own.
MARK_STYLE = "background:#ffe58a"
PAGE_STYLE = "color:#777;font-size:80%"


def highlight(c: Column, keys: Column, style: str = MARK_STYLE) -> Column:
    """Escaped text with the keys (longer than one character, longest first, any case) in marks."""
    from pyspark.sql.functions import lit

    words = F.array_sort(F.filter(F.array_distinct(keys), lambda k: F.length(k) > 1), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(words, lambda k: F.regexp_replace(k, r"([\\\[\](){}.*+?^$|&])", r"\\$1"))
    marked = F.regexp_replace(escape_html(c), F.concat(lit("(?i)("), F.array_join(quoted, "|"), lit(")")), lit(f'<span style="{style}">$1</span>'))
    return F.when(F.size(words) > 0, marked).otherwise(escape_html(c))


def preview(c: Column, keys: Column, limit: int = 160) -> Column:
    """The first `limit` characters, highlighted, on one line, with an ellipsis if the text is longer."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(F.replace(highlight(F.substring(c, 1, limit), keys), F.lit("\n"), F.lit(" ")), F.when(F.length(c) > limit, "…").otherwise(""))


def page_badge(page: Column, style: str = PAGE_STYLE) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(f'<span style="{style}">&nbsp;P'), page.cast("string"), F.lit("&nbsp;</span>&nbsp;"))).otherwise("")


def table_rows(c: Column) -> Column:
    """Cells of a Markdown table, without separator rows: array<array<string>>."""
    rows = F.filter(F.transform(lines(c), strip), lambda r: r.startswith("|"))
    # a bar after a backslash is a cell's own
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\|+|(?<!\\)\|+$", ""), r"(?<!\\)\|"), lambda x: F.replace(strip(x), F.lit("\\|"), F.lit("|"))))
    return F.filter(cells, lambda cs: ~F.forall(cs, lambda x: x.rlike(r"^[-: ]*$")))


def table_html(c: Column) -> Column:
    rows = table_rows(c)

    def row(cs, tag):
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cs, lambda x: F.concat(F.lit(f"<{tag}>"), escape_html(x), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.transform(rows, lambda cs, k: F.when(k == 0, row(cs, "th")).otherwise(row(cs, "td")))
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table>"), F.array_join(body, ""), F.lit("</table>"))).otherwise("")


def table_markdown(rows: Column) -> Column:
    """array<array<string>> -> Markdown; short rows are padded, bars escaped."""
    n = F.array_max(F.transform(rows, F.size))

    def row(cs):
        padded = F.concat(cs, F.array_repeat(F.lit(""), n - F.size(cs)))
        return F.concat(F.lit("| "), F.array_join(F.transform(padded, lambda x: F.replace(strip(x), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    made = F.transform(rows, row)
    return F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, 2, 1_000_000)), "\n")


def normal_answer(c: Column) -> Column:
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def question_key(course: Column, kind: Column, no: Column) -> Column:
    return F.concat_ws(":", course, kind, no.cast("string"))


def numbers_in(c: Column, missing: int = 9999) -> Column:
    """Sort key of a title: all integers in it, or one large number."""
    got = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(got) > 0, F.transform(got, lambda x: x.cast("long"))).otherwise(F.array(F.lit(missing).cast("long")))


def classify_course(name: Column, courses: dict[str, list[str]]) -> Column:
    """The first course whose name is in the file name, else the first with an alias in it, else ''."""
    out = [F.when(name.contains(c), c) for c in courses]
    low = F.lower(name)
    for c, aliases in courses.items():
        out += [F.when(low.contains(a), c) for a in aliases]
    return F.coalesce(*out, F.lit(""))


# Chinese digits that a chapter's number may be written with; they are added up.
DIGITS_ZH = "一二三四五六七八九"


def section_order(c: Column) -> Column:
    """Sort key of a section's title, array<int> of two: 8.1 is (8, 1), chapter N is (N, 0), any other title (999, 0)."""
    s = strip(F.coalesce(c, F.lit("")))
    a, b = F.regexp_extract(s, r"^(\d+)(?:\.(\d+))?", 1), F.regexp_extract(s, r"^(\d+)(?:\.(\d+))?", 2)
    zh = F.regexp_extract(s, r"^第([一二三四五六七八九十百0-9]+)章", 1)
    added = F.aggregate(F.split(zh, ""), F.lit(0), lambda n, d: n + F.when(d == "", 0).otherwise(F.instr(F.lit(DIGITS_ZH), d)))
    number = F.when(zh.rlike(r"^\d+$"), zh.cast("int")).when(added > 0, added).otherwise(99)
    pair = lambda x, y: F.array(x.cast("int"), y.cast("int"))
    return F.when(a != "", pair(a, F.when(b != "", b).otherwise("0"))).when(zh != "", pair(number, F.lit(0))).otherwise(pair(F.lit(999), F.lit(0)))


def figure_url(folder: Column, url: Column) -> Column:
    """An image's address, relative ones under the folder of their book."""
    absolute = url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|/)")
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(absolute, url).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), F.regexp_replace(url, r"^(?:\./)+", "")))


def book_label(c: Column, labels: dict[str, str]) -> Column:
    """What a book is shown as: the label of the first name that it holds, else its own name."""
    return F.coalesce(*[F.when(c.contains(k), v) for k, v in labels.items()], c)


def block_html(kind: Column, level: Column, text: Column, url: Column, page: Column, keys: Column) -> Column:
    """One block of a section as HTML: headings of two sizes, figures linked to themselves, tables, captions, marked paragraphs."""
    lines_ = lambda c: F.replace(c, F.lit("\n"), F.lit("<br>"))
    badge = page_badge(page)
    heading = F.concat(F.when(F.coalesce(level, F.lit(9)) <= 4, F.lit('<h4>')).otherwise('<h5>'), escape_html(text), F.when(F.coalesce(level, F.lit(9)) <= 4, F.lit('</h4>')).otherwise('</h5>'))
    figure = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit('<p class="figure"><a href="'), url, F.lit('"><img src="'), url, F.lit('"></a></p>'))).otherwise("")
    para = F.when(is_caption(text), F.concat(F.lit('<p class="caption">'), badge, lines_(escape_html(text)), F.lit("</p>"))).otherwise(
        F.concat(F.lit("<p>"), badge, lines_(highlight(text, keys)), F.lit("</p>")))
    return F.when(kind == "heading", heading).when(kind == "figure", figure).when(kind == "table", table_html(text)).otherwise(para)
