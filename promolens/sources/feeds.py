"""JSON feeds, API dumps and row batches to staged promotion records.

A feed document is one JSON text per row (column ``payload``). Item lists are
read as raw JSON texts first, so an odd item never voids its whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens import schemas
from promolens.functions import periods, text
from promolens.functions.rows import computed_once, posexploded
from promolens.vocabulary import (
    LEGACY_CATEGORY_DEFAULT, LEGACY_CATEGORY_RULES, LEGACY_THREAT_RULES, NO_INFO, SEE_DETAIL, THREAT_DEFAULT,
    Vocabulary,
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON files, one document per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.input_file_name().alias("document")
    )


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines, one document per line."""
    return spark.read.text(path).select(F.col("value").alias("payload"))


def _items(documents: DataFrame, lists: Column, item_schema: str) -> DataFrame:
    """One row per JSON object in the lists, with its place in the document."""
    keep = [c for c in documents.columns if c != "payload"]
    raw = posexploded(documents, keep, lists, "item_no", "raw")
    objects = raw.where(F.col("raw").startswith("{"))
    return objects.withColumn("item", F.from_json("raw", item_schema))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def feed_a_items(documents: DataFrame) -> DataFrame:
    """Union of the five item lists of a feed A document, in fixed order."""
    doc = F.from_json("payload", schemas.FEED_A_DOCUMENT)
    parsed = documents.withColumn("_d", doc)
    lists = F.concat(*[_list(F.col(f"_d.{path}")) for path in schemas.FEED_A_LISTS])
    return _items(parsed.drop("payload"), lists, schemas.FEED_A_ITEM).drop("_d")


def feed_a_records(items: DataFrame, company: str | Column, base_url: str, vocab: Vocabulary) -> DataFrame:
    """Feed A items to staged records: first filled title, address and period."""
    i = lambda k: F.col(f"item.{k}")
    staged = computed_once(
        items,
        {
            "title": text.clean_title(
                text.first_filled(i("mobWbEvtNm"), i("evtImgSlTilNm"), i("evtImgRplNm")), vocab
            ),
            "url": text.first_filled(i("hpgEvtDlPgeUrlAr"), i("evtDtlUrl"), i("evtUrlAr")),
            "period": text.first_filled(
                periods.period_from_compact(i("mobWbEvtStd"), i("mobWbEvtEdd")),
                periods.canonical_period(text.first_filled(i("evtTermTxt"), i("eventPeriod"))),
            ),
        },
    )
    parts = [
        F.col("title"), text.clean_text(i("hpgEvtSmrTt")), text.clean_text(i("evtImgSlTilNm")),
        text.clean_text(i("evtImgRplNm")), F.col("period"),
    ]
    return _with_home(staged, company, base_url).withColumn(
        "raw_text", F.concat_ws(" | ", *[text.blank_to_null(p) for p in parts])
    ).drop("item", "raw")


def feed_b_items(documents: DataFrame) -> DataFrame:
    parsed = documents.withColumn("_d", F.from_json("payload", schemas.FEED_B_DOCUMENT))
    return _items(parsed.drop("payload"), _list(F.col("_d.bdy.eventList")), schemas.FEED_B_ITEM).drop("_d")


def feed_b_records(
    items: DataFrame, company: str | Column, base_url: str, detail_path: str, vocab: Vocabulary,
    search_word: str = "",
) -> DataFrame:
    """Feed B items to staged records; items without code or title are dropped."""
    i = lambda k: text.clean_text(F.col(f"item.{k}"))
    coded = computed_once(
        items, {"_code": i("bnftWebEvntCd"), "title": text.clean_title(F.col("item.bnftEvntNm"), vocab), "item": F.col("item")}
    ).where((F.col("_code") != "") & (F.col("title") != ""))
    staged = coded.withColumns(
        {
            "url": F.concat(
                F.lit(f"{detail_path}?bnftWebEvntCd="), F.col("_code"), F.lit(f"&searchWord={search_word}")
            ),
            "period": periods.canonical_period(F.concat(i("srtDttm"), F.lit("~"), i("endDttm"))),
            "raw_text": F.concat_ws(
                " | ", text.blank_to_null(F.col("title")),
                *[text.blank_to_null(i(k)) for k in ("srtDttm", "endDttm", "bnftEvntSmrCn")],
            ),
        }
    )
    return _with_home(staged, company, base_url).drop("item", "raw", "_code")


def list_row_records(rows: DataFrame, company: str | Column, base_url: str) -> DataFrame:
    """Rows of a rendered list page (href, title, period, raw_text) to staged records."""
    kept = rows.where((F.coalesce("href", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    return _with_home(kept.withColumnRenamed("href", "url"), company, base_url)


def dump_items(documents: DataFrame) -> DataFrame:
    parsed = documents.withColumn("_d", F.from_json("payload", schemas.DUMP_DOCUMENT))
    return _items(parsed.drop("payload"), _list(F.col("_d.listPeiHPPPrgEvnInqrDVO")), schemas.DUMP_ITEM).drop("_d")


def dump_records(items: DataFrame, company: str | Column, by_content_id: str, by_event_id: str) -> DataFrame:
    """API dump items to finished records; the address depends on the id at hand."""
    i = lambda k: F.coalesce(F.col(f"item.{k}"), F.lit(""))
    dotted = lambda c: F.when(
        F.length(c) == 8,
        F.concat_ws(".", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)),
    )
    titled = items.withColumn("title", text.ustrip(i("cmpTitNm"))).where(F.col("title") != "")
    period = F.concat(dotted(i("cmsCmpStrtdt")), F.lit("~"), dotted(i("cmsCmpEnddt")))
    company_col = F.lit(company) if isinstance(company, str) else company
    return titled.select(
        *[c for c in titled.columns if c not in ("item", "raw", "title")],
        F.when(i("cmsId") != "", F.concat(F.lit(by_content_id), i("cmsId")))
        .otherwise(F.concat(F.lit(by_event_id), i("cmpId"))).alias("url"),
        company_col.alias("company"),
        text.first_rule(F.col("title"), LEGACY_CATEGORY_RULES, LEGACY_CATEGORY_DEFAULT).alias("category"),
        F.col("title"),
        F.coalesce(period, F.lit(NO_INFO)).alias("period"),
        F.lit(NO_INFO).alias("benefit_type"),
        F.lit(SEE_DETAIL).alias("benefit_value"),
        F.lit(SEE_DETAIL).alias("conditions"),
        F.lit("일반").alias("target_segment"),
        text.first_rule(F.col("title"), LEGACY_THREAT_RULES, THREAT_DEFAULT).alias("threat_level"),
        F.col("title").alias("one_line_summary"),
        F.col("raw").alias("raw_text"),
    )


def direct_entries(spark: SparkSession, rows, schema: str | None = None) -> DataFrame:
    """Hand-entered records; they take the same path as collected ones."""
    fields = ", ".join(f"{f} STRING" for f in schemas.RAW_FIELDS)
    return spark.createDataFrame(rows, schema or fields)


def _with_home(staged: DataFrame, company: str | Column, base_url: str) -> DataFrame:
    company_col = F.lit(company) if isinstance(company, str) else company
    return staged.withColumns({"company": company_col, "base_url": F.lit(base_url)})
