"""Filing text, filing indexes and insider forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import ACCEPTED_FORMS, PHRASES

# Fixed patterns: section headings of periodic reports.
_END = r"\s*[.:\-—]?\s"
ITEM_1A = rf"\bItem\s*1\s*A{_END}"
AFTER_1A = rf"\bItem\s*(?:1\s*B|2|7){_END}"
ITEM_7 = rf"\bItem\s*7{_END}"
AFTER_7 = rf"\bItem\s*(?:7\s*A|8){_END}"
ITEM_2 = rf"\bItem\s*2{_END}"
AFTER_2 = rf"\bItem\s*3{_END}"
ANNUAL = ("10-K", "20-F", "10-K/A", "20-F/A")
QUARTERLY = ("10-Q", "10-Q/A")


def phrase_count(text: Column, phrase: str) -> Column:
    """Case-insensitive, non-overlapping occurrences of a literal phrase."""
    return F.regexp_count(text, F.lit("(?iu)\\Q" + phrase + "\\E"))


def phrase_counts(
    docs: DataFrame, phrases: tuple[str, ...] = PHRASES, text_col: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, phrase, n) with zero counts kept.

    All phrases are counted in one pass over a text; only the counts are exploded, so the
    text is never copied or shuffled.
    """
    counts = F.array(
        *[F.struct(F.lit(p).alias("phrase"), phrase_count(F.col(text_col), p).alias("n")) for p in phrases]
    )
    return docs.select(key, F.explode(counts).alias("c")).select(
        key, "c.phrase", "c.n", F.concat(F.replace("c.phrase", F.lit(" "), F.lit("_")), F.lit("_mentions")).alias("signal_name")
    )


def _between(text: Column, begin: str, end: str) -> Column:
    return F.regexp_extract(text, rf"(?isU){begin}(.*?)(?={end}|\z)", 1)


def extract_sections(docs: DataFrame, form_col: str = "form", text_col: str = "text") -> DataFrame:
    """Risk section plus management discussion, by form.

    Current reports and texts without a risk heading count whole.
    """
    text, form = F.col(text_col), F.col(form_col)
    whole = (form == "8-K") | ~text.rlike(rf"(?isU){ITEM_1A}")
    discussion = F.when(form.isin(*ANNUAL), _between(text, ITEM_7, AFTER_7)).when(
        form.isin(*QUARTERLY), _between(text, ITEM_2, AFTER_2)
    )
    sections = F.concat(_between(text, ITEM_1A, AFTER_1A), F.lit(" "), F.coalesce(discussion, F.lit("")))
    return docs.withColumn("section_text", F.when(whole, text).otherwise(sections)).withColumn("is_full_text", whole)


# The entities that occur in ordinary pages.
ENTITIES = [
    ("&nbsp;", " "),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
]


def text_of_html(html: Column) -> Column:
    """Visible text with single spaces; comments, scripts and styles are dropped."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[!/?]?[A-Za-z][^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_html(docs: DataFrame, html_col: str = "html") -> DataFrame:
    return docs.withColumn("text", text_of_html(F.col(html_col)))


def accepted_filings(
    index: DataFrame, start: dt.date, end: dt.date, forms: tuple[str, ...] = ACCEPTED_FORMS
) -> DataFrame:
    """Rows of the parallel-array filing index with a wanted form and date.

    The shortest array ends the zip, as pairing the arrays does.
    """
    n = F.least(F.size("form"), F.size("accessionNumber"), F.size("filingDate"))
    rows = index.select(
        "entity",
        F.explode(
            F.slice(F.arrays_zip("form", "accessionNumber", "filingDate"), F.lit(1), F.greatest(n, F.lit(0)))
        ).alias("r"),
    )
    filed = F.when(F.col("r.filingDate").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("r.filingDate").try_cast("date"))
    return (
        rows.select("entity", F.col("r.form").alias("form"), F.col("r.accessionNumber").alias("accession"), filed.alias("filed"))
        .filter(F.col("form").isin(*forms) & F.col("filed").between(F.lit(start), F.lit(end)))
    )


_TX = (
    "array<struct<transactionCode string, transactionCoding struct<transactionCode string>,"
    " transactionDate struct<_VALUE string, value string>>>"
)
FORM_SCHEMA = f"""
    reportingOwner struct<reportingOwnerId struct<rptOwnerCik string>>,
    reportingPerson struct<reportingPersonId struct<rptOwnerCik string>>,
    nonDerivativeTransaction {_TX},
    nonDerivativeTable struct<nonDerivativeTransaction {_TX}>
"""


def _filled(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def form_transactions(xml_docs: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Insider id and every coded, dated non-derivative transaction, in form order.

    Both schema variants are read: code and date directly, or nested one level down.
    """
    form = xml_docs.withColumn("_f", F.from_xml(F.col(xml_col), FORM_SCHEMA))
    insider = F.coalesce(
        _filled(F.col("_f.reportingOwner.reportingOwnerId.rptOwnerCik")),
        _filled(F.col("_f.reportingPerson.reportingPersonId.rptOwnerCik")),
        F.lit("unknown"),
    )
    empty = F.array().cast(_TX)
    rows = F.concat(
        F.coalesce("_f.nonDerivativeTransaction", empty),
        F.coalesce("_f.nonDerivativeTable.nonDerivativeTransaction", empty),
    )
    flat = F.transform(
        rows,
        lambda t: F.struct(
            F.coalesce(_filled(t["transactionCode"]), _filled(t["transactionCoding"]["transactionCode"])).alias("code"),
            F.coalesce(_filled(t["transactionDate"]["_VALUE"]), _filled(t["transactionDate"]["value"])).alias("tx_date"),
        ),
    )
    usable = F.filter(flat, lambda t: t["code"].isNotNull() & t["tx_date"].isNotNull())
    return form.withColumn("insider", insider).withColumn("transactions", usable).drop("_f", xml_col)


def parse_insider_forms(xml_docs: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The first usable transaction of each form; forms without one give no row."""
    return (
        form_transactions(xml_docs, xml_col)
        .filter(F.size("transactions") > 0)
        .withColumn("code", F.col("transactions")[0]["code"])
        .withColumn("tx_date", F.col("transactions")[0]["tx_date"].try_cast("date"))
        .drop("transactions")
    )


def all_transactions(xml_docs: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Every usable transaction, one row each."""
    return (
        form_transactions(xml_docs, xml_col)
        .withColumn("t", F.explode("transactions"))
        .withColumn("code", F.col("t.code"))
        .withColumn("tx_date", F.col("t.tx_date").try_cast("date"))
        .drop("t", "transactions")
    )
