"""Removing markup and reading infobox types.

Native regular-expression stages, not a parser. Templates and links go from the inside outwards, to
any depth; marks without a partner are left as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

from digitscope.functions.labels import SPACE, domain_of_type
from digitscope.functions.lets import escape, let, literal_map

# An infobox template with a name; behind the second pattern a comment or a nowiki span is skipped as a
# whole, so that templates in it do not count.
INFOBOX = rf"\{{\{{\s*(?i:infobox){SPACE}*([^|{{}}\s\x1c-\x1f\x85\p{{Z}}][^|{{}}]*)"
SKIPPED = r"(?s)<!--.*?-->|<nowiki>.*?</nowiki>|"

# Templates of species, which stand for an infobox without its name.
TAXON_BOXES = ("taxobox", "speciesbox", "automatic taxobox", "subspeciesbox")


def infobox_pattern(boxes: Sequence[str] = ()) -> str:
    """Pattern of an infobox template, or of one of the whole template names ``boxes``; its group is the type."""
    if not boxes:
        return INFOBOX
    own = "|".join(escape(box).replace(" ", "[ _]+") for box in boxes)
    start, name = INFOBOX.index("(?i:infobox)"), INFOBOX.index("([^|")
    return rf"{INFOBOX[:start]}(?:{INFOBOX[start:name]}|(?=(?i:{own}){SPACE}*(?:[|{{}}]|\z))){INFOBOX[name:]}"


# Tags whose content is not shown as text.
HIDDEN_TAGS = "categorytree|ce|chem|gallery|graph|hiero|imagemap|inputbox|math|nowiki|pre|score|section|source|syntaxhighlight|templatedata|timeline"

# Spans that are removed with their content: how they open, how they close.
COMMENT = ("<!--", "-->")
NOWIKI = ("<nowiki>", "</nowiki>")
HIDDEN = (rf"<(?:{HIDDEN_TAGS})(?:\s[^<>]*)?>", rf"</(?:{HIDDEN_TAGS})\s*>")
SCRIPT = (r"<script(?:\s[^<>]*)?>", r"</script\s*>")
STYLE = (r"<style(?:\s[^<>]*)?>", r"</style\s*>")

# Innermost templates and links; single brackets, in pairs or alone, may stand inside.
TEMPLATE = (r"\{\{(?!\{)(?:[^{}]|\{[^{}]*+\}|\{(?!\{)|\}(?!\}))*+\}\}", "")
LINK = (r"\[\[(?!\[)(?:(?:[^\[\]|]|\[[^\[\]|]*+\]|\[(?!\[)|\](?!\]))*+\|)?((?:[^\[\]]|\[[^\[\]]*+\]|\[(?!\[)|\](?!\]))*+)\]\]", "$1")

# Stages in order: text without which the pattern cannot occur, pattern, replacement.
WIKI_STAGES = (
    ("{|", r"(?m)^[ \t]*\{\|[^\n]*$", ""),                                # table start
    ("|", r"(?m)^[ \t]*\|[}\-+][^\n|]*", ""),                             # table end, row, caption
    ("||", r"\|\|", "\n|"),                                              # one cell per line
    ("|", r"(?m)^[ \t]*\|(?:[^\n|\[\]]*\|)?", " "),                      # cell start with attributes
    ("!", r"(?m)^[ \t]*!(?:[^\n|\[\]]*\|)?|!!", " "),                     # header cells
    ("//", r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]*\s*([^\[\]]*)\]", "$1"),  # external links
    ("<", r"</?[A-Za-z][^<>]*>", ""),
    ("''", r"'{2,}", ""),
    ("=", r"(?m)^={1,6}([^\n]*?)={1,6}[ \t]*$", "$1"),                    # headings
    ("", r"(?m)^[*#:;]+", ""),                                           # list markers
    ("\n\n\n", r"\n{3,}", "\n\n"),
)
TAG = (r"(?s)<[^<>]*>", " ")

ENTITY = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"


# White space of Unicode texts.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def span_regex(span: tuple[str, str]) -> str:
    """Shortest stretch from an opening to a closing mark."""
    return "(?is)" + ".*?".join(span)


def _with_closed_part(text: Column, closer: str, body, plain: bool = False) -> Column:
    """``body(closed, rest)``: the text up to the last closing mark, empty when there is none, and the rest.

    Every opening mark in the first part is closed. Searching for spans in the rest would run to
    the end of the text from each opening mark in vain, which takes quadratic time on broken pages.
    A ``plain`` mark is no pattern and found faster.
    """
    def split(t: Column) -> Column:
        if plain:
            rest = F.substring_index(t, closer, -1)
            return let(F.struct(t.alias("t"), rest.alias("rest")), lambda b: body(
                F.substring(b["t"], F.lit(1), F.length(b["t"]) - F.length(b["rest"])), b["rest"]))
        closed = F.regexp_extract(t, f"(?is)^.*{closer}", 0)
        return let(F.struct(t.alias("t"), closed.alias("closed")), lambda b: body(
            b["closed"], F.substring(b["t"], F.length(b["closed"]) + 1, F.length(b["t"]))))

    return let(text, split)


def _remove_spans(text: Column, span: tuple[str, str], replacement: str = "") -> Column:
    def remove(closed: Column, rest: Column) -> Column:
        return F.concat(F.regexp_replace(closed, span_regex(span), replacement), rest)

    opener, closer = span
    plain = span == COMMENT
    return let(text, lambda t: F.when(
        F.contains(t, F.lit(opener)) if plain else t.rlike(f"(?i){opener}"),
        _with_closed_part(t, closer, remove, plain)).otherwise(t))


def _drop_unclosed(text: Column, span: tuple[str, str]) -> Column:
    """Text without the opening marks that nothing closes."""
    opener, closer = span

    def drop(closed: Column, rest: Column) -> Column:
        return F.concat(closed, F.replace(rest, F.lit(opener), F.lit("")))

    return let(text, lambda t: F.when(
        F.contains(t, F.lit(opener)), _with_closed_part(t, closer, drop, plain=True)).otherwise(t))


def infobox_type(wikitext: Column, boxes: Sequence[str] = ()) -> Column:
    """Type named by the first infobox template that names one, trimmed and lower-cased, else null.

    ``boxes`` lists names of other templates, such as ``TAXON_BOXES``, that count as an infobox whose type is the template's name.

    Usually nothing before that template is commented out and the search ends there; only otherwise
    the whole text is searched with comments skipped.
    """
    pattern = infobox_pattern(boxes)

    def outside(t: Column) -> Column:
        whole = _drop_unclosed(_drop_unclosed(t, COMMENT), NOWIKI)
        names = F.regexp_extract_all(whole, F.lit(SKIPPED + pattern), F.lit(1))
        return F.get(F.filter(names, lambda name: name != ""), F.lit(0))

    def first(b: Column) -> Column:
        t, before = b["t"], b["before"]
        hidden = F.contains(before, F.lit(COMMENT[0])) | F.contains(before, F.lit(NOWIKI[0]))
        name = F.when(hidden, outside(t)).otherwise(F.regexp_extract(t, pattern, 1))
        name = F.lower(F.btrim(name, F.lit(BLANKS)))
        spaced = F.regexp_replace(name, "[ _]+", " ")
        return F.when(spaced.isin(*[box.lower() for box in boxes]), spaced).otherwise(name) if boxes else name

    return let(wikitext, lambda t: F.when(t.rlike(pattern), let(
        F.struct(t.alias("t"), F.regexp_extract(t, "(?s)^(.*?)" + pattern, 1).alias("before")), first)))


def domain_of_text(wikitext: Column, boxes: Sequence[str] = ()) -> Column:
    """Subject domain of an article from its infobox, or from one of the templates ``boxes``."""
    return let(infobox_type(wikitext, boxes), domain_of_type)


def decode_entities(text: Column) -> Column:
    """Replace named and numeric character references; unknown ones stay as they are."""
    names = literal_map({name.removesuffix(";"): text for name, text in html5.items() if name.endswith(";")})

    def decode(entity: Column) -> Column:
        body = F.substring(entity, F.lit(2), F.length(entity) - 2)
        code = (F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10))
                .when(F.startswith(body, F.lit("#")), F.substring(body, F.lit(2), F.length(body)))
                .try_cast("bigint"))
        scalar = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.when(scalar, character), F.element_at(names, body), entity)

    def merge(cut: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(
            cut["gaps"], F.transform(cut["entities"], decode),
            lambda gap, ch: F.array(gap, F.coalesce(ch, F.lit(""))),
        )), "")

    cut = F.struct(
        F.split(text, ENTITY, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)).alias("entities"),
    )
    return F.when(F.contains(text, F.lit("&")), let(cut, merge)).otherwise(text)


def _inside_out(text: Column, opener: str, closer: str, stage: tuple[str, str]) -> Column:
    """Apply a replacement of innermost spans until nothing changes: one round per level of nesting, and one."""
    def rounds(t: Column) -> Column:
        openers = (F.length(t) - F.length(F.replace(t, F.lit(opener), F.lit("")))) / len(opener)
        start = F.struct(t.alias("text"), F.lit(True).alias("more"))

        def once(acc: Column, _: Column) -> Column:
            new = F.regexp_replace(acc["text"], *stage)
            return F.when(acc["more"], let(new, lambda n: F.struct(n.alias("text"), (n != acc["text"]).alias("more")))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), openers.cast("int")), start, once, lambda acc: acc["text"])

    return let(text, lambda t: F.when(F.contains(t, F.lit(opener)) & F.contains(t, F.lit(closer)), rounds(t)).otherwise(t))


def _stage(text: Column, needle: str, pattern: str, replacement: str) -> Column:
    """One replacement, skipped when ``needle`` is not in the text."""
    if not needle:
        return F.regexp_replace(text, pattern, replacement)
    return let(text, lambda t: F.when(
        F.contains(t, F.lit(needle)), F.regexp_replace(t, pattern, replacement)).otherwise(t))


def strip_wikitext(wikitext: Column) -> Column:
    """Visible text of an article: templates and comments go, links leave their label, tags their content."""
    text = _remove_spans(wikitext, COMMENT)
    text = _inside_out(text, "{{", "}}", TEMPLATE)
    text = _inside_out(text, "[[", "]]", LINK)
    text = _remove_spans(text, HIDDEN)
    for needle, pattern, replacement in WIKI_STAGES:
        text = _stage(text, needle, pattern, replacement)
    return F.btrim(let(text, decode_entities), F.lit("\n"))


def strip_html(html: Column) -> Column:
    """Visible text of a web page; removed tags leave a space so that neighbours stay apart."""
    text = html
    for span in (SCRIPT, STYLE, COMMENT):
        text = _remove_spans(text, span, " ")
    return let(F.regexp_replace(text, *TAG), decode_entities)


DIALECTS = {"wikitext": strip_wikitext, "html": strip_html}


def strip_markup(text: Column, dialect: str) -> Column:
    """Visible text of ``text`` in the given dialect."""
    return DIALECTS[dialect](text)
