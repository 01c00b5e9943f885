"""Text and time expressions; built-in functions but for the full entity table and the Markdown renderer."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns, marks and formats that the results depend on.
CODE_BLOCK = r"(?s)<pre[^>]*>.*?</pre>"
INLINE_CODE = r"(?s)<code[^>]*>.*?</code>"
CODE_MARK = " [CODE] "
LINE_ENDS = r"<br>|<br/>|<br />|</p>|</li>"
ANY_TAG = r"<[^>]+>"
BLANKS = r"[ \t]+"
EMPTY_LINES = r"\n{3,}"
FENCE = r"(?s)```.*?```"
CODE_LINE = r"(^|\n)[ \t]*\[CODE\][ \t]*(\n|$)"
PROSE_LEAST = 40
ENTITY = r"&(amp|lt|gt|quot|apos|nbsp|#\d+);"
SENTENCE_END = r"(?<=[.!?])\s+"
FENCED_CODE = r"(?is)<pre[^>]*>\s*<code([^>]*)>(.*?)</code>\s*</pre>"
CLASS_LIST = r'class="([^"]+)"'
CODE_SPAN = r"(?is)<code[^>]*>(.*?)</code>"
BREAKS = r"<br ?/?>"
PARAGRAPH = r"</?p[^>]*>"
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))  # ampersand last
LAST_SECOND = 253402300800  # the year 10000


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Decode every HTML entity."""
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def unescape_common(c: Column) -> Column:
    """Decode :data:`COMMON_ENTITIES` only, without leaving the JVM."""
    for entity, char in COMMON_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_html(body: Column, *, every_entity: bool = True) -> Column:
    """Plain text of an HTML body: code becomes a mark, block ends line ends, tags go, entities are decoded, blanks squeezed.  Null gives ''."""
    t = F.coalesce(body, F.lit(""))
    t = F.regexp_replace(t, CODE_BLOCK, CODE_MARK)
    t = F.regexp_replace(t, INLINE_CODE, CODE_MARK)
    t = F.regexp_replace(t, LINE_ENDS, "\n")
    t = F.regexp_replace(t, ANY_TAG, "")
    t = unescape(t) if every_entity else unescape_common(t)
    t = F.regexp_replace(t, BLANKS, " ")
    t = F.regexp_replace(t, EMPTY_LINES, "\n\n")
    return F.regexp_replace(t, "^[\\s ]+|[\\s ]+$", "")


def evidence_type(body: Column) -> Column:
    """'prose' without a code block, 'code' if under 40 characters of prose remain beside it, else 'both'."""
    t = F.coalesce(body, F.lit(""))
    rest = F.replace(F.regexp_replace(F.regexp_replace(t, FENCE, " "), CODE_LINE, " "), F.lit("[CODE]"), F.lit(" "))
    left = F.length(F.trim(F.regexp_replace(rest, r"\s+", " ")))
    return F.when(~(t.rlike(FENCE) | t.rlike(CODE_LINE)), "prose").when(left < PROSE_LEAST, "code").otherwise("both")


def first_entity(c: Column) -> Column:
    """The first undecoded entity, or null."""
    return F.nullif(F.regexp_extract(c, ENTITY, 0), F.lit(""))


def sentences(c: Column, most: int = 2) -> Column:
    """The first ``most`` non-blank sentences; a sentence ends at . ! or ? before white space."""
    return F.slice(F.filter(F.split(c, SENTENCE_END), lambda s: F.trim(s) != ""), 1, most)


def query_text(c: Column) -> Column:
    """Trimmed text in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def parse_epoch(c: Column) -> Column:
    """Epoch seconds from a number, a digit string or one of :data:`DATE_FORMATS`; null from anything else."""
    s = F.trim(c.cast("string"))
    number = F.when(s.rlike(r"^-?\d+$"), s.try_cast("bigint"))
    dates = [F.unix_timestamp(F.try_to_timestamp(s, F.lit(f))) for f in DATE_FORMATS]
    return F.coalesce(number, *dates)


def _day(epoch: Column) -> Column:
    near = F.when(F.abs(epoch) < LAST_SECOND, epoch)
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(near / F.lit(86400)).cast("int"))


def year_of(epoch: Column, *, zero_is_null: bool = False) -> Column:
    """UTC year of epoch seconds, null beyond the year 9999; the document contract treats epoch 0 as unknown."""
    e = F.nullif(epoch, F.lit(0)) if zero_is_null else epoch
    return F.year(_day(e))


def month_of(epoch: Column) -> Column:
    """'YYYY-MM' of epoch seconds in UTC, null beyond the year 9999."""
    return F.date_format(_day(epoch), "yyyy-MM")


def one_hot(tags: Column, tracked: tuple[str, ...], forced: str | None = None) -> list[Column]:
    """One 0/1 column per tracked tag; ``forced`` is always set."""
    return [(F.lit(True) if t == forced else F.coalesce(F.array_contains(tags, t), F.lit(False))).cast("int").alias(re.sub(r"\W+", "_", t)) for t in tracked]


def shorten(c: Column, most: int) -> Column:
    """``c`` on one line, cut to ``most`` characters with an ellipsis."""
    one = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("..."))).otherwise(one)


def _language(classes: str | None) -> str:
    """The language that a class list names by 'language-' or 'lang-'."""
    for word in (classes or "").split():
        for mark in ("language-", "lang-"):
            if word.startswith(mark):
                return word[len(mark) :]
    return ""


class _Markdown(HTMLParser):
    """Renders elements to Markdown as they close; each open element holds the pieces of its content.

    An item outside a list is plain content, text of a list outside its items is
    dropped, and an element left open closes with the one around it.
    """

    EMPTY = {"br": "  \n", "hr": "\n---\n", "img": "", "input": "", "wbr": ""}
    AROUND = {"b": "**", "strong": "**", "i": "*", "em": "*"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = [("", {}, [])]
        self.raw = 0  # depth of code, whose content is kept as it is

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.EMPTY:
            self.open[-1][2].append("" if self.raw else self.EMPTY[tag])
            return
        at = dict(attrs)
        if tag == "code" and self.raw and (language := _language(at.get("class"))):
            self.open[-1][1].setdefault("language", language)
        self.raw += tag in ("pre", "code")
        self.open.append((tag, at, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in (o[0] for o in self.open[1:]):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, at, parts = self.open.pop()
        self.raw -= tag in ("pre", "code")
        self.open[-1][2].append("".join(parts) if self.raw else self._render(tag, at, parts))
        return tag

    def _render(self, tag: str, at: dict, parts: list[str]) -> str:
        inner = "".join(parts)
        trimmed = inner.strip()
        if tag == "pre":
            code = inner.rstrip("\n")
            return f"\n```{at.get('language', '')}\n{code}\n```\n"
        if tag == "code":
            return f"`{inner}`"
        if tag in self.AROUND:
            return self.AROUND[tag] + inner + self.AROUND[tag]
        if tag == "a":
            return f"[{trimmed}]({at['href']})" if at.get("href") else trimmed
        if tag == "p":
            return f"\n{inner}\n"
        if tag == "blockquote":
            return "\n" + "\n".join("> " + line for line in trimmed.splitlines()) + "\n"
        if tag == "li" and self.open[-1][0] in ("ul", "ol"):
            self.open[-1][1].setdefault("items", []).append(trimmed)
            return ""
        if tag in ("ul", "ol"):
            marks = (f"{i}." if tag == "ol" else "-" for i in range(1, 10**9))
            return "\n" + "\n".join(f"{m} {item}" for m, item in zip(marks, at.get("items", []))) + "\n"
        if re.fullmatch("h[1-6]", tag):
            return "\n" + "#" * int(tag[1]) + f" {trimmed}\n"
        return inner

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)

    def result(self) -> str:
        while len(self.open) > 1:
            self._close()
        return "".join(self.open[0][2])


def html_to_markdown(text: str | None) -> str:
    """Markdown of one HTML body; '' for null."""
    if not text:
        return ""
    p = _Markdown()
    p.feed(text)
    p.close()
    return re.sub(EMPTY_LINES, "\n\n", p.result()).strip()


def markdown_by_pattern(text: str | None) -> str:
    """Markdown by patterns alone: code, line ends and paragraphs; other tags go, tags that code shows go with them.

    Entities of code are decoded before the tags go and once more at the end, as
    the collectors' fallback does; '' for null.
    """
    if not text:
        return ""
    fence = lambda m: f"\n```{_language((re.search(CLASS_LIST, m[1]) or [None, None])[1])}\n{html.unescape(m[2]).rstrip(chr(10))}\n```\n"
    t = re.sub(FENCED_CODE, fence, text)
    t = re.sub(CODE_SPAN, lambda m: f"`{html.unescape(m[1])}`", t)
    t = re.sub(BREAKS, "  \n", t)
    t = re.sub(ANY_TAG, "", re.sub(PARAGRAPH, "\n", t))
    return re.sub(EMPTY_LINES, "\n\n", html.unescape(t)).strip()


@F.pandas_udf(T.StringType())
def pattern_markdown(s: pd.Series) -> pd.Series:
    """Markdown of HTML bodies by patterns alone."""
    return s.map(markdown_by_pattern)


def fenced_text(body: Column) -> Column:
    """Plain text of an HTML body that keeps code: blocks fenced, spans in back quotes; tags go, common entities are decoded.  Null gives ''."""
    t = F.coalesce(body, F.lit(""))
    t = F.regexp_replace(t, r"(?s)<pre[^>]*>\s*<code[^>]*>(.*?)</code>\s*</pre>", "\n```\n$1\n```\n")
    t = F.regexp_replace(t, r"(?s)<code[^>]*>(.*?)</code>", "`$1`")
    t = F.regexp_replace(F.regexp_replace(t, LINE_ENDS, "\n"), ANY_TAG, "")
    return F.trim(F.regexp_replace(unescape_common(t), EMPTY_LINES, "\n\n"))


@F.pandas_udf(T.StringType())
def markdown(s: pd.Series) -> pd.Series:
    """Markdown of HTML bodies."""
    return s.map(html_to_markdown)


def markdown_to_html(text: str | None) -> str:
    """HTML of Markdown: everything is escaped first, then fences, inline code, links, emphasis, headings and lists are recognised."""
    if not text:
        return ""
    held: list[str] = []

    def keep(body: str) -> str:
        held.append(body)
        return f"\0{len(held) - 1}\0"

    t = html.escape(text, quote=False)
    t = re.sub(r"```(\w*)\n(.*?)```", lambda m: keep(f"<pre><code>{m[2]}</code></pre>"), t, flags=re.S)
    t = re.sub(r"`([^`\n]+)`", lambda m: keep(f"<code>{m[1]}</code>"), t)
    t = re.sub(r"\[([^\]]+)\]\((https?://[^\s)]+)\)", lambda m: keep(f'<a href="{html.escape(m[2])}">{m[1]}</a>'), t)
    t = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", t)
    t = re.sub(r"\*([^*\n]+)\*", r"<em>\1</em>", t)
    blocks = []
    for block in re.split(r"\n\s*\n", t.strip()):
        lines = block.split("\n")
        if all(re.match(r"[-*] ", x) for x in lines):
            blocks.append("<ul>" + "".join(f"<li>{x[2:]}</li>" for x in lines) + "</ul>")
        elif all(re.match(r"\d+\. ", x) for x in lines):
            blocks.append("<ol>" + "".join(f"<li>{x.split('. ', 1)[1]}</li>" for x in lines) + "</ol>")
        elif m := re.fullmatch(r"(#{1,6}) (.*)", block):
            blocks.append(f"<h{len(m[1])}>{m[2]}</h{len(m[1])}>")
        elif re.fullmatch("\0\\d+\0", block):
            blocks.append(block)
        else:
            blocks.append("<p>" + "<br>".join(lines) + "</p>")
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], "".join(blocks))


@F.pandas_udf(T.StringType())
def to_html(s: pd.Series) -> pd.Series:
    """HTML of Markdown texts."""
    return s.map(markdown_to_html)
