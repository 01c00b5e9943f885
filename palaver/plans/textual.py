"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.text import clean_html, evidence_type, fenced_text, first_entity, markdown, parse_epoch, pattern_markdown, shorten, to_html
from palaver.plans.registry import Registry
from palaver.plans.relational import answers, questions
from palaver.plans.sqltext import Q
from palaver.sources.tables import table

REGISTRY = Registry()
_BLANK = "[\\s\\x{00a0}]+"
_UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
_CODE = "regexp_replace(regexp_replace(coalesce(body, ''), '<pre[^>]*>.*?</pre>', ' [CODE] ', 'gs'), '<code[^>]*>.*?</code>', ' [CODE] ', 'gs')"
_TAGLESS = f"regexp_replace(regexp_replace({_CODE}, '<br>|<br/>|<br />|</p>|</li>', chr(10), 'g'), '<[^>]+>', '', 'g')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_UNESCAPED.format(_TAGLESS)}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_BLANK}|{_BLANK}$', '', 'g')"


@REGISTRY.query("html_clean", f"WITH {Q} SELECT question_id, {_CLEAN} AS text FROM q")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    """Plain text of question bodies, common entities decoded in the JVM."""
    return questions(spark, d, "body").select("question_id", clean_html(F.col("body"), every_entity=False).alias("text"))


@REGISTRY.query("html_clean_every_entity")
def html_clean_every_entity(spark: SparkSession, d: str) -> DataFrame:
    """The same with the full entity table, by Arrow batches."""
    return questions(spark, d, "body").select("question_id", clean_html(F.col("body")).alias("text"))


@REGISTRY.query("html_markdown")
def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of answer bodies."""
    return answers(spark, d, "body").select("answer_id", markdown(F.coalesce("body", F.lit(""))).alias("markdown"))


_REST = "replace(regexp_replace(regexp_replace(coalesce(text, ''), '```.*?```', ' ', 'gs'), '(^|\\n)[ \\t]*\\[CODE\\][ \\t]*(\\n|$)', ' ', 'g'), '[CODE]', ' ')"


EVIDENCE = f"""CASE WHEN NOT (regexp_matches(coalesce(text, ''), '```.*?```', 's') OR regexp_matches(coalesce(text, ''), '(^|\\n)[ \\t]*\\[CODE\\][ \\t]*(\\n|$)')) THEN 'prose'
 WHEN length(trim(regexp_replace({_REST}, '\\s+', ' ', 'g'))) < 40 THEN 'code' ELSE 'both' END"""  # of a column ``text``


@REGISTRY.query("evidence_type", f"SELECT doc_id, {EVIDENCE} AS evidence FROM documents")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", evidence_type(F.col("text")).alias("evidence"))


@REGISTRY.query("entity_dirty_rate", f"WITH {Q} SELECT nullif(regexp_extract(body_text, '&(amp|lt|gt|quot|apos|nbsp|#\\d+);', 0), '') AS entity, count(*) AS n FROM q GROUP BY 1")
def entity_dirty_rate(spark: SparkSession, d: str) -> DataFrame:
    """Questions by the first entity left in their text; null where it is clean."""
    return questions(spark, d, "body_text").groupBy(first_entity(F.col("body_text")).alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("epoch_parse", f"WITH {Q} SELECT question_id, form, CASE WHEN form = 'day' THEN creation_date - ((creation_date % 86400) + 86400) % 86400 WHEN form <> 'junk' THEN creation_date END AS epoch FROM q, (VALUES ('digits'), ('stamp'), ('iso'), ('day'), ('junk')) f(form) WHERE abs(creation_date) < 100000000000 OR creation_date IS NULL")
def epoch_parse(spark: SparkSession, d: str) -> DataFrame:
    """Times written as digits, in the three date forms and with something after them, read back."""
    t = F.col("creation_date").cast("timestamp")
    forms = {
        "digits": F.concat(F.lit(" "), F.col("creation_date").cast("string")), "stamp": F.date_format(t, "yyyy-MM-dd HH:mm:ss"), "iso": F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
        "day": F.date_format(t, "yyyy-MM-dd"), "junk": F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit(" about noon")),
    }
    q = questions(spark, d, "creation_date").where("abs(creation_date) < 100000000000 OR creation_date IS NULL")  # years of four digits
    each = q.select("question_id", F.explode(F.array(*[F.struct(F.lit(f).alias("form"), c.alias("text")) for f, c in forms.items()])).alias("x"))
    return each.select("question_id", "x.form", parse_epoch(F.col("x.text")).alias("epoch"))


@REGISTRY.query("title_prefix", f"WITH {Q} SELECT question_id, CASE WHEN length(replace(title, chr(10), ' ')) > 40 THEN substr(replace(title, chr(10), ' '), 1, 40) || '...' ELSE replace(title, chr(10), ' ') END AS short FROM q")
def title_prefix(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d, "title").select("question_id", shorten(F.col("title"), 40).alias("short"))


@REGISTRY.query("markdown_by_pattern")
def markdown_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Markdown of answer bodies by patterns alone; checked on small texts in the tests."""
    return answers(spark, d, "body").select("answer_id", pattern_markdown(F.coalesce("body", F.lit(""))).alias("markdown"))


@REGISTRY.query("markdown_to_html")
def markdown_html(spark: SparkSession, d: str) -> DataFrame:
    """HTML of documents taken as Markdown; checked on small texts in the tests."""
    return table(spark, d, "documents").select("doc_id", to_html(F.coalesce("text", F.lit(""))).alias("html"))


_FENCED = f"""regexp_replace(regexp_replace(coalesce(body, ''), '<pre[^>]*>\\s*<code[^>]*>(.*?)</code>\\s*</pre>', chr(10) || '```' || chr(10) || '\\1' || chr(10) || '```' || chr(10), 'gs'), '<code[^>]*>(.*?)</code>', '`\\1`', 'gs')"""
_FENCED_TEXT = _UNESCAPED.format(f"regexp_replace(regexp_replace({_FENCED}, '<br>|<br/>|<br />|</p>|</li>', chr(10), 'g'), '<[^>]+>', '', 'g')")


@REGISTRY.query("fenced_text", f"WITH {Q} SELECT question_id, trim(regexp_replace({_FENCED_TEXT}, '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM q")
def fenced(spark: SparkSession, d: str) -> DataFrame:
    """Plain text of question bodies with their code kept."""
    return questions(spark, d, "body").select("question_id", fenced_text(F.col("body")).alias("text"))
